"""Helpers shared by the training-data operators."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.session import materialise  # noqa: F401  (re-exported for the operators)

#: Rows that are turned into Python objects at a time, so long texts never pile up.
ROWS_AT_ONCE = 128
#: Word separators of every contract here: [\x20\x09-\x0D].
SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def labelled(docs: DataFrame, labels: DataFrame, column: str, most: int,
             known: Column | None = None) -> DataFrame:
    """``doc_id, text, y`` of at most ``most`` labelled documents, the first by a hash of
    their id; ``known`` restricts the labels.

    The chosen ids are bounded by ``most``, so they are broadcast and no text is shuffled.
    """
    marks = (labels.select("doc_id", F.col(column).cast("int").alias("y"))
             .filter("doc_id IS NOT NULL AND y IN (0, 1)"))
    if known is not None:
        marks = marks.filter(known)
    marks = marks.groupBy("doc_id").agg(F.max("y").alias("y"))
    chosen = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")


def crc_mod(doc_id: Column, modulus: int) -> Column:
    """``crc32(doc_id as text) mod modulus``; a null id counts as empty text."""
    text = F.coalesce(doc_id.cast("string"), F.lit(""))
    return F.pmod(F.crc32(text.cast("binary")), F.lit(modulus)).cast("int")


def pieces(batch: pa.RecordBatch, size: int = ROWS_AT_ONCE) -> Iterator[pa.RecordBatch]:
    for start in range(0, batch.num_rows, size):
        yield batch.slice(start, size)


def map_texts(df: DataFrame, keep: list[str], text: str, schema: str,
              make: Callable[[], Callable[[list], list]]) -> DataFrame:
    """Arrow map over ``keep`` columns plus columns computed from the texts.

    ``make()`` runs once per task and returns a function from a list of texts (None for
    null) to a list of result columns, in the order of ``schema`` after ``keep``.
    """
    names = [*keep, text] if text not in keep else list(keep)

    def run(batches):
        fn = make()
        for batch in batches:
            for part in pieces(batch):
                columns = fn(part.column(text).to_pylist())
                arrays = [part.column(k) for k in keep]
                yield pa.RecordBatch.from_arrays(
                    [*arrays, *(pa.array(values, type=kind) for values, kind in columns)],
                    names=[*keep, *(f"c{i}" for i in range(len(columns)))])

    fixed = ", ".join(f"`{k}` {dict(df.dtypes)[k]}" for k in keep)
    out = schema.split(",")
    tmp = ", ".join(f"c{i} {item.split()[1]}" for i, item in enumerate(out))
    mapped = df.select(*names).mapInArrow(run, f"{fixed}, {tmp}")
    return mapped.select(*[F.col(k) for k in keep],
                         *[F.col(f"c{i}").alias(item.split()[0]) for i, item in enumerate(out)])


def utf8(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def lower_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` in UTF-8 with A-Z lower-cased (bytes methods are ASCII only)."""
    return utf8(text).lower().split() if text else []


def crc(data: bytes) -> int:
    return zlib.crc32(data)
