"""Spans inside one text: find, score, resolve and splice, as SQL expressions.

A span is ``struct(start, end, entity, score, priority, rule)`` with 0-based,
end-exclusive character offsets. All functions take and return SQL text, see ``arrays``;
use them with ``F.expr``.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from veilframe.functions import rules as R
from veilframe.functions.arrays import let, lit, running_max, running_sum, var

SPAN_TYPE = "struct<start:int,end:int,entity:string,score:double,priority:int,rule:string>"
SEGMENT = 64
CONTEXT_BLOCK = 512
NO_SPANS = f"cast(array() AS array<{SPAN_TYPE}>)"


def match_starts(found: str, gaps: str) -> str:
    """Start offsets of matches, from the lengths of the matches and the gaps around them."""
    g, m, e, n = var("g"), var("m"), var("e"), var("n")
    widths = f"zip_with({gaps}, {found}, ({g}, {m}) -> length({g}) + coalesce(length({m}), 0))"
    return (f"zip_with(slice({running_sum(widths)}, 1, size({found})), {found}, "
            f"({e}, {n}) -> {e} - length({n}))")


def matches(text: str, pattern: str) -> str:
    """``array<struct<start int, m string>>`` of all matches of ``pattern``.

    The gaps are only computed for texts with a match.
    """
    s, m = var("s"), var("m")
    rx = lit(pattern)
    return let(f"regexp_extract_all({text}, {rx}, 0)", lambda found: (
        f"IF(size({found}) = 0, cast(array() AS array<struct<start:int,m:string>>), "
        f"zip_with({match_starts(found, f'split({text}, {rx}, -1)')}, {found}, "
        f"({s}, {m}) -> named_struct('start', {s}, 'm', {m})))"))


def context_blocks(text: str) -> str:
    """Blocks of CONTEXT_BLOCK characters of a long line, cut in one walk; NULL for others."""
    rx = lit(f"(?s).{{1,{CONTEXT_BLOCK}}}+")
    return f"IF(length({text}) > {2 * CONTEXT_BLOCK}, regexp_extract_all({text}, {rx}, 0), NULL)"


def context_before(text: str, start: str, blocks: str = "NULL") -> str:
    """The last five tokens before ``start`` in lower case, joined by spaces.

    With the ``context_blocks`` of a long line only the block of ``start`` and the one before it are
    read, as long as five whole tokens lie in them; else the line up to ``start`` is.
    """
    t = var("t")
    n = R.CONTEXT_WINDOW
    lead = f"left({text}, {start})"
    if blocks != "NULL":
        at = f"cast({start} div {CONTEXT_BLOCK} AS int)"
        close = (f"concat(coalesce(get({blocks}, {at} - 1), ''), "
                 f"left(coalesce(get({blocks}, {at}), ''), {start} % {CONTEXT_BLOCK}))")
        # the first token may be cut, the last may be empty
        near = let(close, lambda c: f"IF({at} <= 1 OR size(split({c}, r'\\s+')) > {n + 1}, {c}, {lead})")
        lead = f"IF({blocks} IS NULL, {lead}, {near})"
    tokens = f"filter(split(lower({lead}), r'\\s+'), {t} -> {t} != '')"
    return let(tokens, lambda a: (
        f"array_join(slice({a}, greatest(size({a}) - {n - 1}, 1), {n}), ' ')"))


def boosted(score: str) -> str:
    return f"least(greatest({score} + {R.CONTEXT_BOOST}D, {R.CONTEXT_FLOOR}D), 1.0D)"


def may_match(text: str, rules: Iterable[R.Rule]) -> str:
    """Cheap necessary condition for any hit, in one scan; keeps every text that has one."""
    rules = tuple(rules)
    if not rules:
        return "false"
    if any(r.gate is None and not r.gate_words for r in rules):
        return "true"
    chars = "".join(sorted({r.gate for r in rules if r.gate}))
    tests = [f"[{chars}]"] if chars else []
    for flags, folds in (("", False), ("(?iu)", True)):
        words = sorted({w for r in rules for w in r.gate_words if r.ignore_case is folds})
        if words:
            listed = "|".join(map(re.escape, words))
            head = "" if folds else R.initials(words)
            tests.append(f"{head}(?:{listed})" if not flags else f"(?:{flags}(?:{listed}))")
    return f"{text} RLIKE {lit('|'.join(tests))}"


def _rule_matches(text: str, rule: R.Rule, number: int) -> str:
    """Struct of one rule's matches and gaps, or NULL when there is none."""
    rx = lit(rule.pattern)
    row = let(f"regexp_extract_all({text}, {rx}, 0)", lambda m: (
        f"IF(size({m}) > 0, named_struct('rule', {number}, 'm', {m}, "
        f"'g', split({text}, {rx}, -1)), NULL)"))
    if rule.needs is None:
        return row
    return f"IF({text} RLIKE {lit(rule.flags + rule.needs)}, {row}, NULL)"


def _per_rule(rules: tuple[R.Rule, ...], number: str, value, default: str) -> str:
    """CASE over the rule number; rules with the same value share a branch."""
    branches: dict[str, list[str]] = {}
    for i, rule in enumerate(rules):
        branches.setdefault(value(rule), []).append(str(i))
    branches.pop(default, None)
    if not branches:
        return default
    whens = " ".join(f"WHEN {number} IN ({', '.join(ids)}) THEN {v}"
                     for v, ids in branches.items())
    return f"CASE {whens} ELSE {default} END"


def candidate_spans(text: str, rules: Iterable[R.Rule],
                    threshold: float | str = R.DEFAULT_THRESHOLD) -> str:
    """Scored spans of all rules in one text, at or above the threshold, unresolved.

    Each rule only adds its guarded pattern; offsets, scores and context are worked out by
    one expression for the rules that matched.
    """
    rules = tuple(rules)
    if not rules:
        return NO_SPANS
    a, b, c, d, s, m, w, x, y, z = (var(n) for n in "abcdsmwxyz")
    matched = (f"filter(array({', '.join(_rule_matches(text, r, i) for i, r in enumerate(rules))})"
               f", {a} -> {a} IS NOT NULL)")
    placed = (f"flatten(transform({matched}, {b} -> zip_with({match_starts(f'{b}.m', f'{b}.g')}, "
              f"{b}.m, ({s}, {m}) -> named_struct('rule', {b}.rule, 'start', {s}, 'm', {m}))))")
    base = _per_rule(rules, f"{c}.rule", lambda r: f"{r.score}D", "0D")
    score = _per_rule(rules, f"{d}.rule", lambda r: (
        f"{d}.base" if r.rescore is None
        else r.rescore.replace("{m}", f"{d}.m").replace("{s}", f"{d}.base")), f"{d}.base")
    lead = _per_rule(rules, f"{d}.rule", lambda r: (
        "0" if r.lead is None else f"length(regexp_extract({d}.m, {lit(r.lead)}, 0))"), "0")
    based = (f"transform({placed}, {c} -> named_struct('rule', {c}.rule, 'start', {c}.start, "
             f"'m', {c}.m, 'base', {base}))")
    scored = (f"filter(transform({based}, {d} -> named_struct('rule', {d}.rule, 'start', "
              f"{d}.start + {lead}, 'end', {d}.start + length({d}.m), 'score', {score})), "
              f"{x} -> {x}.score IS NOT NULL)")
    words = _per_rule(rules, f"{y}.rule", lambda r: (
        f"array({', '.join(lit(v) for v in r.context)})" if r.context else "NULL"), "NULL")
    entity = _per_rule(rules, f"{y}.rule", lambda r: lit(r.entity), "''")
    priority = _per_rule(rules, f"{y}.rule", lambda r: str(r.priority), "0")
    name = _per_rule(rules, f"{y}.rule", lambda r: lit(r.name), "''")

    def finished(final: str) -> str:
        return (f"transform({scored}, {y} -> named_struct('start', {y}.start, 'end', {y}.end, "
                f"'entity', {entity}, 'score', round({final}, 2), 'priority', {priority}, "
                f"'rule', {name}))")

    def in_context(blocks: str) -> str:
        near = let(context_before(text, f"{y}.start", blocks), lambda before: (
            f"exists({words}, {w} -> contains({before}, {w}))"))
        return finished(f"IF({words} IS NOT NULL AND {near}, {boosted(f'{y}.score')}, {y}.score)")

    spans = (let(context_blocks(text), in_context) if any(r.context for r in rules)
             else finished(f"{y}.score"))
    return f"filter({spans}, {z} -> {z}.score >= {threshold})"


def dedupe(spans: str) -> str:
    """Drop a span contained in one of the same entity with a better score.

    At equal score the longer span stays, then the lower rule name.
    """
    s, o = var("s"), var("o")
    width, other = f"({s}.end - {s}.start)", f"({o}.end - {o}.start)"
    beats = (f"{o}.entity = {s}.entity AND {o}.start <= {s}.start AND {s}.end <= {o}.end AND "
             f"({o}.score > {s}.score OR ({o}.score = {s}.score AND ({other} > {width} OR "
             f"({other} = {width} AND {o}.rule < {s}.rule))))")
    return let(spans, lambda a: f"filter({a}, {s} -> NOT exists({a}, {o} -> {beats}))")


def claimed(spans: str) -> str:
    """Non-overlapping parts of spans: every place belongs to the best span that covers it.

    The best is decided by score, length, priority, start, entity. A span that loses a place
    keeps the rest, so nothing that any span covers stays in clear.
    """
    s, b, i, r, acc, c = (var(x) for x in "sbirac")
    c = f"c{c}"
    ranked = (f"array_sort(transform({spans}, {s} -> struct(-{s}.score AS a, "
              f"{s}.start - {s}.end AS b, {s}.priority AS c, {s}.start AS d, "
              f"{s}.entity AS e, {s} AS span)))")
    borders = (f"array_sort(array_distinct(flatten(transform({spans}, {b} -> "
               f"array({b}.start, {b}.end)))))")

    def pieces(best: str, at: str) -> str:
        owner = (f"get(filter({best}, {r} -> {r}.span.start <= get({at}, {i}) AND "
                 f"{r}.span.end > get({at}, {i})), 0).span")
        cells = (f"filter(transform({at}, ({b}, {i}) -> named_struct('from', {b}, "
                 f"'to', get({at}, {i} + 1), 'own', {owner})), {b} -> {b}.own IS NOT NULL)")
        last = f"element_at({acc}, -1)"
        piece = (f"named_struct('start', {c}.from, 'end', {c}.to, 'entity', {c}.own.entity, 'score', "
                 f"{c}.own.score, 'priority', {c}.own.priority, 'rule', {c}.own.rule)")
        longer = (f"named_struct('start', {last}.span.start, 'end', {c}.to, 'entity', {c}.own.entity, "
                  f"'score', {c}.own.score, 'priority', {c}.own.priority, 'rule', {c}.own.rule)")
        entry = f"named_struct('own', {c}.own, 'span', {{}})"
        same = f"size({acc}) > 0 AND {last}.own = {c}.own AND {last}.span.end = {c}.from"
        none = f"cast(array() AS array<struct<own:{SPAN_TYPE},span:{SPAN_TYPE}>>)"
        joined = (f"aggregate({cells}, {none}, ({acc}, {c}) -> IF({same}, array_append(slice({acc}, 1, "
                  f"size({acc}) - 1), {entry.format(longer)}), array_append({acc}, {entry.format(piece)})))")
        return f"transform({joined}, {s} -> {s}.span)"

    return let(ranked, lambda best: let(borders, lambda at: pieces(best, at)))


def resolve(spans: str) -> str:
    """Non-overlapping spans in text order; a beaten span keeps what is left of it.

    Spans are first cut into runs that overlap each other, mostly of one or two spans;
    the pairwise comparisons stay inside a run. A run begins where no earlier span reaches.
    """
    s, i, p, j, r = var("s"), var("i"), var("p"), var("j"), var("r")

    def runs(a: str, reach: str) -> str:
        starts = (f"filter(sequence(0, size({a}) - 1), {i} -> {i} = 0 OR "
                  f"get({a}, {i}).start >= get({reach}, {i} - 1))")
        return let(starts, lambda ps: (
            f"transform({ps}, ({p}, {j}) -> slice({a}, {p} + 1, "
            f"coalesce(get({ps}, {j} + 1), size({a})) - {p}))"))

    def several(a: str) -> str:
        cut = let(running_max(f"transform({a}, {s} -> {s}.end)"), lambda reach: runs(a, reach))
        return f"flatten(transform({cut}, {r} -> IF(size({r}) <= 1, {r}, {let(dedupe(r), claimed)})))"

    return let(spans, lambda a: (
        f"IF(size({a}) <= 1, {a}, array_sort({let(f'array_sort({a})', several)}))"))


def find_spans(text: str, rules: Iterable[R.Rule],
               threshold: float | str = R.DEFAULT_THRESHOLD) -> str:
    """Detect and resolve: the non-overlapping spans of one text."""
    return resolve(candidate_spans(text, tuple(rules), threshold))


def span_text(text: str, s: str) -> str:
    return f"substring({text}, {s}.start + 1, {s}.end - {s}.start)"


def texts_before(parts: str, line, same) -> str:
    """``array<string>``: the text between each part and the previous one on its line.

    ``line(p)`` is the line of a part and ``same(p, q)`` tells whether two parts share it.
    A substring walks its text from the start, so long lines are first cut into segments
    of SEGMENT parts.
    """
    b, i, p = var("b"), var("i"), var("p")

    def at(index: str) -> str:
        return f"get({parts}, {index})"

    def end_before(index: str) -> str:
        return f"IF({same(at(f'{index} - 1'), at(index))}, {at(f'{index} - 1')}.end, 0)"

    head = f"({b} * {SEGMENT})"
    last = at(f"least({head} + {SEGMENT - 1}, size({parts}) - 1)")
    start = end_before(head)
    segments = (f"transform(sequence(0, cast((size({parts}) - 1) div {SEGMENT} AS int)), {b} -> "
                f"named_struct('from', {start}, 'text', IF({same(last, at(head))}, "
                f"substring({line(at(head))}, {start} + 1, {last}.end - {start}), "
                f"substring({line(at(head))}, {start} + 1))))")
    block = f"cast({i} div {SEGMENT} AS int)"
    before = end_before(i)

    def cut(segs: str) -> str:
        seg = f"get({segs}, {block})"
        return (f"transform({parts}, ({p}, {i}) -> IF({same(at(f'{block} * {SEGMENT}'), p)}, "
                f"substring({seg}.text, {before} - {seg}.from + 1, {p}.start - {before}), "
                f"substring({line(p)}, {before} + 1, {p}.start - {before})))")

    return let(segments, cut)


def splice(text: str, parts: str) -> str:
    """Replace spans of ``text``; ``parts`` is ``array<struct<start,end,value>>`` in text order."""
    p, i = var("p"), var("i")

    def spliced(a: str) -> str:
        gaps = texts_before(a, lambda _: text, lambda x, y: f"({x} IS NOT NULL)")
        return let(gaps, lambda g: (
            f"concat(array_join(transform({a}, ({p}, {i}) -> "
            f"concat(get({g}, {i}), {p}.value)), ''), "
            f"substring({text}, element_at({a}, -1).end + 1))"))

    return let(parts, lambda a: f"IF(size({a}) = 0, {text}, {spliced(a)})")


def label(entity: str, n: str) -> str:
    return f"concat('[', {entity}, '_', {n}, ']')"
