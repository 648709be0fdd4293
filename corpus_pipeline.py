"""The corpus pipeline: quality rules, line dedup, near-dedup, source mixing, encoding.

Every stage takes null ids, null and empty texts, repeated rows, empty tables and further columns;
what becomes of them is said at each.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from veilframe.llm import lines, mixing, pieces, quality, registry, simhash
from veilframe.llm.common import table
from veilframe.session import shared_dir


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the forest keep. Null and empty texts go; repeated rows
    stay or go together; an empty table stays empty."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that recur in others, one row for each row. Null texts become
    empty; rows of one id, and all without an id, are one document."""
    return lines.without_repeated_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component: the smallest id, and one row of it. Rows
    without ids are compared as well; all texts without a word are one component."""
    return simhash.keep_one(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents by the target weights, once for each epoch that selects them. Null texts have no
    units; rows without or with repeated ids take their share; an empty table stays empty."""
    return mixing.mix_sources(docs).select("row.*")


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and digests of the ids and of what they decode to; one row for
    each row, none for an empty table, and no ids for null and empty texts."""
    return pieces.digests(docs, public_tokenizers.path(registry.PIECE_MODEL), with_ids=True)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("source_mixing", source_mixing),
    ("encoding", encoding),
]

#: The forest and the encoder cannot be written in SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    base = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        path = f"{base}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
