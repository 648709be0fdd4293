"""Vectors in Arrow columns, and a global order of rows; shared by the vector operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import materialise

#: Rows of a task's Arrow batch that are turned into one matrix at a time.
MATRIX_ROWS = 2048


def matrices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(rows, matrix)`` for each vector length in a list column, in double precision.

    Null vectors and vectors with a null or non-finite component are left out.
    """
    length = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    values = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    size = np.maximum(length, 0)
    start = np.cumsum(size) - size
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    usable = (length >= 0) & (bad[start + size] == bad[start])
    for dim in np.unique(size[usable]):
        rows = np.flatnonzero(usable & (size == dim))
        yield rows, values[start[rows][:, None] + np.arange(dim)]


def ranked(df: DataFrame, *order: str) -> DataFrame:
    """``df`` with ``rank``, its place from 0 in the given total order.

    Rows are range partitioned and sorted once and written; only one count per partition
    goes to the driver.
    """
    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    placed = materialise(df.repartitionByRange(*order).sortWithinPartitions(*order)
                         .withColumns({"_part": F.spark_partition_id(), "_place": place}))
    counts = placed.groupBy("_part").agg(F.max("_place").alias("last")).orderBy("_part").collect()
    starts, below = [], 0
    for row in counts:
        starts.append((row["_part"], below))
        below += row["last"] + 1
    spark = df.sparkSession
    table = spark.createDataFrame(starts, "_part int, _below bigint")
    return (placed.join(F.broadcast(table), "_part")
            .withColumn("rank", F.col("_below") + F.col("_place")).drop("_part", "_place", "_below"))
