"""Exact duplicates by a content sort, with DataFrame operations only.

The rows are range-partitioned by splitters that Spark samples, sorted externally inside
each range, and equal texts then lie next to each other, where a window compares them whole.
The sort key is a prefix of the bytes, a hash and then the whole text: splitters stay short,
and texts that share a long head still go to different ranges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilframe.llm.common import materialise

PREFIX = 32
#: A text with more than this many rows is split over SALTS parts before it is sorted, or over as
#: many as keep a part near PART_ROWS rows. The number of such texts is at most rows / HOT_ROWS,
#: and they are broadcast only up to HOT_MAX.
HOT_ROWS = 500
SALTS = 64
PART_ROWS = 20_000
HOT_MAX = 100_000


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` for every row of ``docs``.

    A null text counts as empty; texts are equal when their bytes are. The row with the
    largest doc_id of a group stays (one of them if that id is repeated; a null id is the
    smallest). An empty table gives an empty result; other columns are not read.

    A text that holds a large share of the rows is first sorted in salted parts; only the
    largest row of each part and its count meet in the second step. Parts are told by doc_id; the
    rows of a text in which one id (or no id) stands very often are numbered instead, and
    written once so that a task that is run again finds the same numbers.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("hash", F.xxhash64("text"))
    hot = (rows.groupBy("hash", "doc_id").agg(F.count("*").alias("same"))
           .groupBy("hash").agg(F.sum("same").alias("n"), F.max("same").alias("most")).filter(F.col("n") > HOT_ROWS)
           .select(F.col("hash").alias("hot_hash"), (F.col("most") > HOT_ROWS).alias("repeats"),
                   F.greatest(F.lit(SALTS), F.ceil(F.col("n") / PART_ROWS)).alias("parts")))
    hot = materialise(hot)
    many = hot.limit(HOT_MAX + 1).count()
    if many:
        rows = rows.join(F.broadcast(hot) if many <= HOT_MAX else hot,
                         F.col("hash") == F.col("hot_hash"), "left")
        rows = _salted(rows, not hot.filter("repeats").isEmpty()).drop("hot_hash", "repeats", "parts")
    else:
        rows = rows.withColumn("salt", F.lit(0))

    rows = rows.withColumn("head", F.substring("text", 1, PREFIX))
    ranged = rows.repartitionByRange("head", "hash", "salt")
    group = Window.partitionBy("head", "hash", "salt", "text")
    order = group.orderBy(F.col("doc_id").desc_nulls_last())
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    local = ranged.select(
        "doc_id", "hash", "salt", F.sha2("text", 256).alias("text_sha256"),
        F.first("doc_id").over(whole).alias("keep_id"),
        F.count(F.lit(1)).over(whole).alias("group_size"),
        F.row_number().over(order).alias("place"),
        F.when(F.row_number().over(order) == 1, F.col("text")).alias("first_text"))
    if not many:
        return local.select("doc_id", "keep_id", "group_size",
                            (F.col("place") == 1).alias("kept"), "text_sha256")

    local = materialise(local.withColumn(
        "first_text", F.when(F.col("salt") > 0, F.col("first_text"))))
    cold = local.filter("salt = 0").select(
        "doc_id", "keep_id", "group_size", (F.col("place") == 1).alias("kept"), "text_sha256")
    parts = local.filter("first_text IS NOT NULL")
    same = Window.partitionBy("hash", "first_text")
    best = same.orderBy(F.col("keep_id").desc_nulls_last(), "salt")
    tops = materialise(parts.select(
        F.col("text_sha256").alias("sha"), F.col("salt").alias("part"),
        F.first("keep_id").over(best.rowsBetween(Window.unboundedPreceding,
                                                 Window.unboundedFollowing)).alias("top_id"),
        F.sum("group_size").over(same).alias("total"),
        (F.row_number().over(best) == 1).alias("top_part")))
    # one row per hot text and salt
    small = tops.limit(HOT_MAX * SALTS + 1).count() <= HOT_MAX
    warm = (local.filter("salt > 0").join(
        F.broadcast(tops) if small else tops,
        (F.col("text_sha256") == F.col("sha")) & (F.col("salt") == F.col("part")))
        .select("doc_id", F.col("top_id").alias("keep_id"), F.col("total").alias("group_size"),
                (F.col("top_part") & (F.col("place") == 1)).alias("kept"), "text_sha256"))
    return cold.unionByName(warm)


def _salted(rows: DataFrame, repeats: bool) -> DataFrame:
    """``rows`` with ``salt``: 0, or from 1 to ``parts`` for a row of a hot text."""
    def part(value):
        return (F.pmod(F.xxhash64(value), F.col("parts")) + 1).cast("int")

    by_id = F.when(F.col("hot_hash").isNotNull(), part("doc_id")).otherwise(F.lit(0))
    if not repeats:
        return rows.withColumn("salt", by_id)
    numbered = materialise(rows.filter("repeats").withColumn("salt", part(F.monotonically_increasing_id())))
    return rows.filter("NOT coalesce(repeats, false)").withColumn("salt", by_id).unionByName(numbered)


SQL = """
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       row_number() OVER w = 1 AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW w AS (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST)
"""
