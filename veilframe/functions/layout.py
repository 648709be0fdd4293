"""A document held in one row: hits per line, label numbers and rebuilding.

Everything here is a narrow projection, so redacting a table of documents needs no
shuffle. ``hits`` is ``array<struct<ord int, text string, spans array<span>>>`` with one
element per line that has spans; ``ord`` counts all lines from 0.
"""

from __future__ import annotations

from collections.abc import Iterable

from veilframe.functions import rules as R
from veilframe.functions import spans as S
from veilframe.functions import text as X
from veilframe.functions.arrays import let, var

CHUNK_TYPE = "struct<ord:int,text:string>"
HIT_TYPE = f"struct<ord:int,text:string,spans:array<{S.SPAN_TYPE}>>"

PARTS_TYPE = "array<struct<ord:int,start:int,end:int,value:string>>"


def chunks_of(text: str) -> str:
    """Lines of a text as ``array<struct<ord, text>>``."""
    line, i = var("l"), var("i")
    return (f"transform({X.keepends(X.normalised(text))}, ({line}, {i}) -> "
            f"named_struct('ord', {i}, 'text', {X.chop(line)}))")


def hits_of_chunks(chunks: str, rules: Iterable[R.Rule],
                   threshold: float | str = R.DEFAULT_THRESHOLD) -> str:
    """Hits of an array of chunks; chunks without a cheap sign of a match are skipped."""
    rules = tuple(rules)
    c, d, h = var("c"), var("d"), var("h")
    likely = f"{S.may_match(f'{c}.text', rules)} AND {X.not_blank(f'{c}.text')}"
    found = (f"transform(filter({chunks}, {c} -> {likely}), {d} -> named_struct("
             f"'ord', {d}.ord, 'text', {d}.text, "
             f"'spans', {S.find_spans(f'{d}.text', rules, threshold)}))")
    return f"filter({found}, {h} -> size({h}.spans) > 0)"


def hits_of_text(text: str, rules: Iterable[R.Rule],
                 threshold: float | str = R.DEFAULT_THRESHOLD) -> str:
    rules = tuple(rules)
    return (f"IF({S.may_match(text, rules)}, "
            f"{hits_of_chunks(chunks_of(text), rules, threshold)}, "
            f"cast(array() AS array<{HIT_TYPE}>))")


def numbered(hits: str, base: str | None = None) -> str:
    """``array<struct<ord, start, end, entity, n>>`` in text order.

    Numbers count per entity over the chunks in order and, inside a chunk, from the last
    span to the first. ``base`` is an optional ``map<entity, offset>`` of numbers already
    used by earlier chunks. Work is linear in the number of spans, per entity.
    """
    h, s, e, t, f, i, g = (var(p) for p in "hsetfig")
    flat = (f"array_sort(flatten(transform({hits}, {h} -> transform({h}.spans, {s} -> "
            f"named_struct('ord', {h}.ord, 'back', -{s}.start, 'back_end', -{s}.end, "
            f"'entity', {s}.entity)))))")
    offset = "0" if base is None else f"coalesce(try_element_at({base}, {t}), 0)"

    def by_entity(a: str) -> str:
        return (f"array_sort(flatten(transform(array_distinct(transform({a}, {e} -> {e}.entity)), "
                f"{t} -> transform(filter({a}, {f} -> {f}.entity = {t}), ({g}, {i}) -> "
                f"named_struct('ord', {g}.ord, 'start', -{g}.back, 'end', -{g}.back_end, "
                f"'entity', {t}, 'n', cast({offset} + {i} + 1 AS int))))))")

    return let(flat, by_entity)


def labelled(numbers: str) -> str:
    """Numbered spans as replacement parts ``struct<ord, start, end, value>``."""
    n = var("n")
    return (f"transform({numbers}, {n} -> named_struct('ord', {n}.ord, 'start', {n}.start, "
            f"'end', {n}.end, 'value', {S.label(f'{n}.entity', f'{n}.n')}))")


def rebuilt(text: str, parts: str) -> str:
    """The text with its parts replaced; other lines and all line breaks stay as they are."""
    p, i, o, x, q = (var(c) for c in "pioxq")

    def pieces(lines: str, a: str) -> str:
        gaps = S.texts_before(a, lambda x: f"get({lines}, {x}.ord)",
                              lambda x, y: f"({x}.ord = {y}.ord)")
        tail = (f"IF(coalesce(get({a}, {i} + 1).ord, -1) = {p}.ord, '', "
                f"substring(get({lines}, {p}.ord), {p}.end + 1))")
        others = (f"transform(array_except(sequence(0, size({lines}) - 1), "
                  f"transform({a}, {q} -> {q}.ord)), {o} -> named_struct('ord', {o}, "
                  f"'start', 0, 'text', get({lines}, {o})))")
        changed = let(gaps, lambda g: (
            f"transform({a}, ({p}, {i}) -> named_struct('ord', {p}.ord, 'start', {p}.start, "
            f"'text', concat(get({g}, {i}), {p}.value, {tail})))"))
        return (f"array_join(transform(array_sort(concat({changed}, {others})), "
                f"{x} -> {x}.text), '')")

    whole = let(X.keepends(X.normalised(text)),
                lambda lines: let(parts, lambda a: pieces(lines, a)))
    return f"IF(size({parts}) = 0, {X.normalised(text)}, {whole})"


def entity_counts(hits: str) -> str:
    """``array<struct<entity, n>>`` sorted by entity."""
    h, s, e, f = (var(c) for c in "hsef")

    def counted(a: str) -> str:
        return (f"transform(array_sort(array_distinct({a})), {e} -> named_struct('entity', {e}, "
                f"'n', cast(size(filter({a}, {f} -> {f} = {e})) AS bigint)))")

    return let(f"flatten(transform({hits}, {h} -> transform({h}.spans, {s} -> {s}.entity)))",
               counted)
