"""Redaction: numbered labels instead of the spans."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilframe.functions import layout as L
from veilframe.functions import rules as R
from veilframe.functions import spans as S
from veilframe.functions.arrays import var
from veilframe.operators.detect import pick_rules
from veilframe.session import join_null_safe, join_sparse, materialise

BLOCK = 4096
CHUNK = "_chunk_hash"


def redact_documents(found: DataFrame, text: str = "text") -> DataFrame:
    """Add ``parts`` and ``scrubbed_text`` to a table with ``hits``. No shuffle."""
    parts = found.withColumn("parts", F.expr(L.labelled(L.numbered("hits"))))
    return parts.withColumn("scrubbed_text", F.expr(L.rebuilt(text, "parts")))


def label_rows(found: DataFrame, *keys: str) -> DataFrame:
    """One row per labelled span of a table with ``hits``, with its original text."""
    n, h, s, o = var("n"), var("h"), var("s"), var("o")
    # both arrays hold the same spans in the same order
    originals = (f"array_sort(flatten(transform(hits, {h} -> transform({h}.spans, {s} -> named_struct("
                 f"'ord', {h}.ord, 'start', {s}.start, 'end', {s}.end, "
                 f"'text', {S.span_text(f'{h}.text', s)})))))")
    rows = (f"zip_with(array_sort({L.numbered('hits')}), {originals}, ({n}, {o}) -> named_struct("
            f"'chunk_ord', {n}.ord, 'start', {n}.start, 'end', {n}.end, 'entity_type', {n}.entity, "
            f"'label', {S.label(f'{n}.entity', f'{n}.n')}, 'original', {o}.text))")
    return found.select(*keys, F.expr(f"inline({rows})"))


def text_hash(text: str) -> Column:
    """Third part of a chunk's key, so that repeated keys never mix their spans."""
    return F.xxhash64(text).alias(CHUNK)


def label_bases(spans: DataFrame, doc: str, order: str) -> DataFrame:
    """Per chunk, how many labels of each entity earlier chunks of the document used.

    Chunks are told apart by ``(doc, order, CHUNK)``; null documents are one document.

    A running count over a whole document would put a document with a third of all chunks
    into one task. Chunks are therefore numbered inside blocks of BLOCK positions, block
    totals inside groups of BLOCK blocks, and only group totals are accumulated per document.
    """
    per_entity = L.entity_counts("array(named_struct('spans', spans))")
    counts = (spans.select(doc, order, CHUNK, F.expr(f"inline({per_entity})"))
              .withColumn("block", F.floor(F.col(order) / BLOCK)))
    before = Window.partitionBy(doc, "entity", "block").orderBy(order, CHUNK).rowsBetween(
        Window.unboundedPreceding, -1)
    totals = (counts.groupBy(doc, "entity", "block").agg(F.sum("n").alias("total"))
              .withColumn("group", F.floor(F.col("block") / BLOCK)))
    in_group = Window.partitionBy(doc, "entity", "group").orderBy("block").rowsBetween(
        Window.unboundedPreceding, -1)
    groups_before = Window.partitionBy(doc, "entity").orderBy("group").rowsBetween(
        Window.unboundedPreceding, -1)
    groups = totals.groupBy(doc, "entity", "group").agg(F.sum("total").alias("total")).select(
        doc, "entity", "group", F.coalesce(
            F.sum("total").over(groups_before), F.lit(0)).alias("group_base"))
    in_groups = totals.select(doc, "entity", "block", "group", F.coalesce(
        F.sum("total").over(in_group), F.lit(0)).alias("in_group"))
    starts = join_null_safe(in_groups, groups, [doc, "entity", "group"]).select(
        doc, "entity", "block", (F.col("in_group") + F.col("group_base")).alias("block_base"))
    inside = counts.select(doc, order, CHUNK, "entity", "block", F.coalesce(
        F.sum("n").over(before), F.lit(0)).alias("chunk_base"))
    return (join_null_safe(inside, starts, [doc, "entity", "block"])
            .groupBy(doc, order, CHUNK)
            .agg(F.map_from_entries(F.collect_list(F.struct(
                "entity", (F.col("chunk_base") + F.col("block_base")).cast("int").alias("base"))))
                .alias("bases")))


def redact_chunks(chunks: DataFrame, doc: str, order: str, text: str = "text", *,
                  rules: Iterable[R.Rule] | None = None,
                  entities: Iterable[str] | None = None,
                  threshold: float = R.DEFAULT_THRESHOLD) -> DataFrame:
    """Add ``spans``, ``parts`` and ``scrubbed_text`` to a table with many chunks per document.

    Detection runs once: its spans, which are offsets without any text, are written to the
    checkpoint folder and numbered from there. Labels go to the chunks that have spans; other
    texts are never shuffled, see ``join_sparse``.

    Every row comes out: a null text stays null, rows with a null ``doc`` are one document,
    rows that repeat a key and its text share their labels.
    """
    chosen = pick_rules(entities, rules)
    likely = S.may_match(text, chosen)
    some = var("s")
    found = S.find_spans(text, chosen, threshold)
    spans = chunks.filter(likely).select(doc, order, text_hash(text), F.explode(F.expr(
        f"filter(array({found}), {some} -> size({some}) > 0)")).alias("spans"))
    return label_chunks(chunks, materialise(spans), doc, order, text)


def label_chunks(chunks: DataFrame, found: DataFrame, doc: str, order: str, text: str) -> DataFrame:
    """Label the materialised spans ``found`` per chunk, keyed by ``(doc, order, CHUNK)``."""
    as_hits = "array(named_struct('ord', 0, 'spans', spans))"
    keys = [doc, order, CHUNK]
    spans = found.dropDuplicates(keys)
    labels = (join_null_safe(spans, label_bases(spans, doc, order), keys)
              .select(*keys, "spans",
                      F.expr(L.labelled(L.numbered(as_hits, "bases"))).alias("parts")))
    return (join_sparse(chunks.select("*", text_hash(text)), labels, keys, found, "size(spans)").drop(CHUNK)
            .withColumn("spans", F.expr(f"coalesce(spans, {S.NO_SPANS})"))
            .withColumn("parts", F.expr(f"coalesce(parts, cast(array() AS {L.PARTS_TYPE}))"))
            .withColumn("scrubbed_text", F.expr(S.splice(text, "parts"))))


SPAN_OF_ROW = ("named_struct('start', start, 'end', end, 'entity', entity_type, 'score', score, "
               "'priority', 0, 'rule', rule)")


def redact_chunk_rows(chunks: DataFrame, rows: DataFrame, doc: str, order: str,
                      text: str) -> DataFrame:
    """Label resolved span rows of any detector in a chunk table."""
    spans = rows.groupBy(doc, order, CHUNK).agg(
        F.collect_list(F.expr(SPAN_OF_ROW)).alias("spans"))
    return label_chunks(chunks, materialise(spans), doc, order, text)


def redact_document_rows(docs: DataFrame, rows: DataFrame, doc: str, text: str) -> DataFrame:
    """Label resolved span rows ``(doc, CHUNK, chunk_ord, …)`` of any detector in documents.

    Adds ``hits``, ``parts`` and ``scrubbed_text``; a group is one document's spans.
    """
    hit = f"named_struct('ord', chunk_ord, 'spans', array({SPAN_OF_ROW}))"
    per_doc = rows.groupBy(doc, CHUNK).agg(F.collect_list(F.expr(hit)).alias("hits"))
    keyed = docs.select("*", text_hash(text))
    joined = join_null_safe(keyed, per_doc, [doc, CHUNK]).drop(CHUNK).withColumn("hits", F.expr(
        f"coalesce(hits, cast(array() AS array<struct<ord:int,spans:array<{S.SPAN_TYPE}>>>))"))
    return redact_documents(joined, text)
