"""CSV files read in many tasks: record borders by prefix sums over lines.

A line begins a record if the quotes before it in the file are even in number. Lines are numbered
within runs of RUN lines of a split; only one row per run, and one per split, is summed over
the file. Both counts, for an even and for an odd number of quotes before the run, are
taken in the same pass, so every line is looked at once. Records of one line go on as they are,
and only lines of longer ones are grouped. Record numbers do not depend on the splits.
"""

from __future__ import annotations

import csv
import io

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RUN = 4096
FIELD_LIMIT = 2**31 - 1
_BEFORE = (Window.unboundedPreceding, -1)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    text = spark.read.option("lineSep", "\n").text(path)
    return (text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
                        F.monotonically_increasing_id().alias("place"), F.expr("make_valid_utf8(value)").alias("line"))
            .withColumns({"run": F.expr(f"place div {RUN}"),
                          "quotes": F.length("line") - F.length(F.replace("line", F.lit('"')))}))


def _below(column: str, window) -> F.Column:
    return F.coalesce(F.sum(column).over(window.rowsBetween(*_BEFORE)), F.lit(0))


def records(spark: SparkSession, path: str) -> DataFrame:
    """``file, record, text``: every record of the files, numbered from 0 in each; a blank line is a
    record of its own."""
    in_run = Window.partitionBy("file", "split", "run").orderBy("place")
    lines = _lines(spark, path).withColumn("odd", _below("quotes", in_run) % 2)
    lines = lines.withColumns({"if_even": F.sum(1 - F.col("odd")).over(in_run), "if_odd": F.sum("odd").over(in_run)})

    runs = lines.groupBy("file", "split", "run").agg(
        F.sum("quotes").alias("quotes"), F.max("if_even").alias("if_even"), F.max("if_odd").alias("if_odd"))
    in_split = Window.partitionBy("file", "split").orderBy("run")
    in_file = Window.partitionBy("file").orderBy("split")
    splits = runs.groupBy("file", "split").agg(F.sum("quotes").alias("quotes")).select(
        "file", "split", _below("quotes", in_file).alias("split_quotes"))
    runs = (runs.join(splits, ["file", "split"])
            .withColumn("open", (_below("quotes", in_split) + F.col("split_quotes")) % 2)
            .withColumn("begun", F.expr("IF(open = 0, if_even, if_odd)")))
    counts = runs.groupBy("file", "split").agg(F.sum("begun").alias("begun")).select(
        "file", "split", _below("begun", in_file).alias("split_begun"))
    runs = runs.join(counts, ["file", "split"]).select(
        "file", "split", "run", "open", (_below("begun", in_split) + F.col("split_begun")).alias("begun_before"))

    numbered = (lines.join(runs, ["file", "split", "run"])
                .withColumn("record", F.expr("begun_before + IF(open = 0, if_even, if_odd) - 1"))
                .withColumn("alone", F.expr("(odd + open) % 2 = 0 AND quotes % 2 = 0")))
    alone = numbered.filter("alone").select("file", "record", F.col("line").alias("text"))
    grouped = (numbered.filter("NOT alone").groupBy("file", "record")
               .agg(F.array_sort(F.collect_list(F.struct("split", "place", "line"))).alias("lines"))
               .select("file", "record", F.expr("array_join(transform(lines, l -> l.line), '\\n')").alias("text")))
    return alone.unionByName(grouped)


def fields(recs: DataFrame) -> DataFrame:
    """``file, record, cells``, as the standard library reads each record; none for a blank line."""
    def one(text: str) -> list[str]:
        return next(csv.reader(io.StringIO(text.removeprefix("﻿"), newline="")), [])

    def run(batches):
        csv.field_size_limit(FIELD_LIMIT)
        for batch in batches:
            cells = [one(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("file"), batch.column("record"), pa.array(cells, pa.list_(pa.string()))],
                names=["file", "record", "cells"])

    return recs.mapInArrow(run, "file string, record bigint, cells array<string>")


def read(spark: SparkSession, path: str, path_name: str, row_name: str) -> DataFrame:
    """The rows of files with one common header as text columns, and their file and row number.

    Rows count from 1. An empty or missing cell is null; a row with more cells than the header is refused, as
    are files with different headers or names that repeat.
    """
    cells = fields(records(spark, path))
    headers = cells.filter("record = 0").select("cells").distinct().limit(2).collect()
    if len(headers) != 1:
        raise ValueError("the CSV files have no header" if not headers else "the CSV files differ in their headers")
    names = headers[0]["cells"]
    if taken := {path_name, row_name} & set(names):
        raise ValueError(f"a CSV file has columns named {sorted(taken)}")
    if len({n.lower() for n in names}) < len(names):
        raise ValueError("names repeat in the header of a CSV file")
    fits = F.when(F.size("cells") <= len(names), True).otherwise(
        F.raise_error(F.lit("a CSV row has more cells than the header")).cast("boolean"))
    return cells.filter("record > 0").filter(fits).select(
        *[F.nullif(F.get("cells", F.lit(i)), F.lit("")).alias(n) for i, n in enumerate(names)],
        F.col("file").alias(path_name), F.col("record").alias(row_name))
