"""Line, preview and display helpers, as SQL expressions over one text."""

from __future__ import annotations

from veilframe.functions.arrays import lit, running_sum, var

# Characters that end a line besides the newline itself (fixed values of ``str.splitlines``).
OTHER_BREAKS = "\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"
LABEL = r"\[([A-Z_]+_\d+)\]"
PREVIEW_CHARS = 600
SNIPPET_CHARS = 800
HEADING_CHARS = 60


def normalised(text: str) -> str:
    """Universal newlines: CR LF and CR become LF."""
    return (f"IF(contains({text}, '\\r'), regexp_replace({text}, '\\r\\n?', '\\n'), {text})")


def utf8(content: str) -> str:
    """Bytes to text; invalid bytes become U+FFFD."""
    return f"make_valid_utf8(cast({content} AS string))"


def keepends(text: str) -> str:
    """``array<string>`` of lines that still carry their line break."""
    return f"split({text}, {lit('(?<=[' + chr(10) + OTHER_BREAKS + '])')}, -1)"


def chop(line: str) -> str:
    """The line without its newline."""
    return f"rtrim('\\n', {line})"


def not_blank(text: str) -> str:
    return f"{text} RLIKE r'(?U)\\S'"


def stripped(text: str) -> str:
    """Without white space of any kind at both ends."""
    return f"regexp_replace({text}, r'(?U)^\\s+|\\s+$', '')"


def line_starts(lines: str) -> str:
    """Character offset of each line, with breaks counted."""
    x, e, n = var("x"), var("e"), var("n")
    ends = running_sum(f"transform({lines}, {x} -> length({x}))")
    return f"zip_with({ends}, {lines}, ({e}, {n}) -> {e} - length({n}))"


def joined_lines(text: str, separator: str) -> str:
    """Non-blank lines of a text joined by a separator."""
    x = var("x")
    return (f"array_join(filter(split({text}, '\\n', -1), {x} -> {not_blank(x)}), "
            f"{lit(separator)})")


def preview(text: str) -> str:
    """The first 600 characters of the lines joined by spaces."""
    return f"left({joined_lines(text, ' ')}, {PREVIEW_CHARS})"


def snippet(text: str) -> str:
    """The first 800 characters of the text as it is."""
    return f"left({text}, {SNIPPET_CHARS})"


def masked(value: str) -> str:
    return f"IF(length({value}) > 3, concat(left({value}, 3), '***'), '***')"


def html_escaped(text: str) -> str:
    out = text
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"),
                      ('"', "&quot;"), ("'", "&#x27;")):
        out = f"replace({out}, {lit(raw)}, {lit(safe)})"
    return out


def highlighted(text: str) -> str:
    """Escaped HTML with every label in a ``mark`` element and line breaks kept."""
    marked = (f"regexp_replace({html_escaped(text)}, {lit(LABEL)}, "
              f"'<mark class=\"pii\">[$1]</mark>')")
    return f"replace({marked}, '\\n', '<br>')"


def label_runs(text: str) -> str:
    """``array<struct<text, is_label>>``: the text cut at its labels, empty runs left out."""
    g, m, r = var("g"), var("m"), var("r")
    pairs = (f"zip_with(split({text}, {lit(LABEL)}, -1), "
             f"regexp_extract_all({text}, {lit(LABEL)}, 0), ({g}, {m}) -> array("
             f"named_struct('text', {g}, 'is_label', false), "
             f"named_struct('text', {m}, 'is_label', true)))")
    return f"filter(flatten({pairs}), {r} -> {r}.text IS NOT NULL AND {r}.text != '')"


def is_heading(text: str) -> str:
    """Short, all capitals, no leading digit and no full stop."""
    s = stripped(text)
    return (f"({s} = upper({s}) AND length({s}) > 2 AND length({s}) <= {HEADING_CHARS} "
            f"AND NOT {s} RLIKE r'^\\p{{Nd}}' AND NOT contains({s}, '.'))")
