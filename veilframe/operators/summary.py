"""Counts and summaries over span rows and scrubbed documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.functions import text as X
from veilframe.session import materialise

ACTIONS = {"redact": "Redacted", "pseudonymise": "Pseudonymised"}


def count_by_type(spans: DataFrame, doc: str) -> DataFrame:
    return spans.groupBy(doc, "entity_type").agg(F.count(F.lit(1)).alias("n"))


def batch_totals(spans: DataFrame) -> DataFrame:
    return spans.groupBy("entity_type").agg(F.count(F.lit(1)).alias("n"))


def batch_status(entries: DataFrame) -> DataFrame:
    """Documents that succeeded and failed, from audit entries."""
    return entries.agg(F.count_if(~F.col("error_flag")).alias("succeeded"),
                       F.count_if("error_flag").alias("failed"))


def detection_summary(spans: DataFrame, doc: str) -> DataFrame:
    """Per entity: count and the masked first occurrence."""
    place = F.struct(doc, "chunk_ord", "start")
    return (spans.groupBy("entity_type")
            .agg(F.count(F.lit(1)).alias("count"),
                 F.min_by(F.expr(X.masked("original")), place).alias("example"))
            .orderBy("entity_type"))


def scrub_summary(spans: DataFrame, mode: str) -> DataFrame:
    """Type, count and action, sorted by type; one "no PII" row when nothing was found."""
    # a row per entity, written once: it is used twice
    counted = materialise(spans.groupBy("entity_type").agg(F.count(F.lit(1)).alias("count")))
    rows = counted.withColumn("action", F.lit(ACTIONS[mode]))
    empty = (counted.agg(F.count(F.lit(1)).alias("kinds")).filter("kinds = 0")
             .select(F.lit("no PII").alias("entity_type"), F.lit(0).cast("bigint").alias("count"),
                     F.lit("None").alias("action")))
    return rows.unionByName(empty).orderBy("entity_type")
