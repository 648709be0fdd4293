"""Detection over tables of documents (one text per row) and of chunks (many rows each)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.functions import layout as L
from veilframe.functions import rules as R
from veilframe.functions import spans as S
from veilframe.functions import text as X
from veilframe.functions.arrays import var


def pick_rules(entities: Iterable[str] | None = None,
               rules: Iterable[R.Rule] | None = None) -> tuple[R.Rule, ...]:
    """Explicit rules, or the defaults; in both cases only those of ``entities``."""
    chosen = R.default_rules() if rules is None else tuple(rules)
    if entities is None:
        return chosen
    wanted = set(entities)
    return tuple(r for r in chosen if r.entity in wanted)


def with_hits(df: DataFrame, text: str = "text", *, entities: Iterable[str] | None = None,
              rules: Iterable[R.Rule] | None = None,
              threshold: float = R.DEFAULT_THRESHOLD) -> DataFrame:
    """Add ``hits``: per line of ``text``, its non-overlapping spans."""
    return df.withColumn("hits", F.expr(
        L.hits_of_text(text, pick_rules(entities, rules), threshold)))


def with_spans(df: DataFrame, text: str = "text", *, entities: Iterable[str] | None = None,
               rules: Iterable[R.Rule] | None = None,
               threshold: float = R.DEFAULT_THRESHOLD) -> DataFrame:
    """Add ``spans`` of ``text`` taken as a single chunk."""
    chosen = pick_rules(entities, rules)
    found = S.find_spans(text, chosen, threshold)
    return df.withColumn("spans", F.expr(
        f"IF({S.may_match(text, chosen)} AND {X.not_blank(text)}, {found}, {S.NO_SPANS})"))


def span_rows(df: DataFrame, *keys: str) -> DataFrame:
    """Explode ``hits`` into one row per span with its chunk number and original text."""
    h, s = var("h"), var("s")
    flat = (f"flatten(transform(hits, {h} -> transform({h}.spans, {s} -> named_struct("
            f"'chunk_ord', {h}.ord, 'entity_type', {s}.entity, 'start', {s}.start, "
            f"'end', {s}.end, 'score', {s}.score, 'rule', {s}.rule, "
            f"'original', {S.span_text(f'{h}.text', s)}))))")
    return df.select(*keys, F.expr(f"inline({flat})"))


def chunk_span_rows(df: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    """Explode ``spans`` of a chunk table into one row per span."""
    s = var("s")
    flat = (f"transform(spans, {s} -> named_struct('entity_type', {s}.entity, "
            f"'start', {s}.start, 'end', {s}.end, 'score', {s}.score, 'rule', {s}.rule, "
            f"'original', {S.span_text(text, s)}))")
    return df.select(*keys, F.expr(f"inline({flat})"))


def line_table(df: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    """One row per line: keys, ``chunk_ord`` and ``text``."""
    return (df.select(*keys, F.expr(f"inline({L.chunks_of(text)})"))
            .withColumnRenamed("ord", "chunk_ord"))


def raw_chunk_spans(chunks: DataFrame, *keys: str, text: str = "text",
                    entities: Iterable[str] | None = None,
                    rules: Iterable[R.Rule] | None = None,
                    threshold: float = R.DEFAULT_THRESHOLD) -> DataFrame:
    """Every rule's spans per chunk, before duplicates and overlaps are removed."""
    chosen = pick_rules(entities, rules)
    likely = chunks.filter(f"{S.may_match(text, chosen)} AND {X.not_blank(text)}")
    found = likely.withColumn("spans", F.expr(S.candidate_spans(text, chosen, threshold)))
    return chunk_span_rows(found, *keys, text=text)


def raw_spans(df: DataFrame, *keys: str, text: str = "text", **options) -> DataFrame:
    """``raw_chunk_spans`` of the lines of a table of documents."""
    return raw_chunk_spans(line_table(df, *keys, text=text), *keys, "chunk_ord", **options)


def resolved_rows(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Span rows of several detectors without overlaps; a group is one chunk's spans."""
    x, y, s = var("x"), var("y"), var("s")
    packed = rows.groupBy(*keys).agg(F.collect_list(F.expr(
        "named_struct('span', named_struct('start', start, 'end', end, 'entity', entity_type, "
        "'score', score, 'priority', IF(startswith(entity_type, 'UK_'), 0, 1), 'rule', rule), "
        "'original', original)")).alias("_all"))
    kept = S.resolve(f"transform(_all, {x} -> {x}.span)")
    flat = (f"transform({kept}, {s} -> named_struct('entity_type', {s}.entity, 'start', {s}.start, "
            f"'end', {s}.end, 'score', {s}.score, 'rule', {s}.rule, "
            f"'original', get(filter(_all, {y} -> {y}.span = {s}), 0).original))")
    return packed.select(*keys, F.expr(f"inline({flat})"))
