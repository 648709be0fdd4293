"""A levelled store for rows that come in numbered batches, such as the mapping of a stream.

Batch N's rows lie in ``store/batch=N`` and stay there, so the folder as a whole reads as one
table. Beside them, merged runs below ``store/_runs`` spare later batches the many small folders:
FAN runs of one level become a run of the next, so a batch reads at most FAN - 1 runs of each of
the log(N) levels, and a row is rewritten once per level. ``store/_pointer/batch-N`` lists the
runs that hold everything up to batch N.

The pointer of a batch is its commit. It is written last, and a run that an earlier pointer
names is never changed, so a batch that failed anywhere can be run again: it starts from the
pointer before it and replaces its own folders.
"""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from veilframe.session import SPLIT_BYTES

FAN = 8
POINTER = "level int, path string"


def batch_path(store: str, number: int) -> str:
    return f"{store}/batch={number}"


def active_runs(spark: SparkSession, store: str, number: int) -> list[tuple[int, str]]:
    """``(level, path)`` of the runs that hold batches 0 to ``number``, oldest first.

    There are few of them, see above. A store without pointers, as earlier versions wrote it, is
    taken as one run for each of its batches.
    """
    if number < 0:
        return []
    try:
        rows = spark.read.schema(f"place int, {POINTER}").parquet(f"{store}/_pointer/batch-{number}").collect()
    except AnalysisException:
        return [(0, f"batch={n}") for n in range(number + 1)]
    return [(r.level, r.path) for r in sorted(rows, key=lambda r: r.place)]


def read_before(spark: SparkSession, store: str, number: int) -> DataFrame | None:
    """The rows of all batches before ``number``, or None if it is the first."""
    runs = active_runs(spark, store, number - 1)
    return spark.read.parquet(*[f"{store}/{path}" for _, path in runs]) if runs else None


def add_batch(rows: DataFrame, store: str, number: int) -> None:
    """Write batch ``number``, merge full levels, then commit. An empty batch is a run as well."""
    spark = rows.sparkSession
    rows.write.mode("overwrite").parquet(batch_path(store, number))
    runs = [*active_runs(spark, store, number - 1), (0, f"batch={number}")]
    level = 0
    while sum(at == level for at, _ in runs) >= FAN:
        merged = [path for at, path in runs if at == level]
        path = f"_runs/level{level + 1}-{number}"
        _merge(spark, [f"{store}/{p}" for p in merged], f"{store}/{path}")
        runs = [*[r for r in runs if r[0] > level], (level + 1, path), *[r for r in runs if r[0] < level]]
        level += 1
    listed = [(i, at, path) for i, (at, path) in enumerate(runs)]
    (spark.createDataFrame(listed, f"place int, {POINTER}").coalesce(1)
     .write.mode("overwrite").parquet(f"{store}/_pointer/batch-{number}"))


def _merge(spark: SparkSession, paths: list[str], target: str) -> None:
    """One run from several; small files become fewer, no row is shuffled."""
    rows = reduce(DataFrame.unionByName, [spark.read.parquet(p) for p in paths])
    size = int(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    rows.coalesce(max(size // (8 * SPLIT_BYTES), 1)).write.mode("overwrite").parquet(target)
