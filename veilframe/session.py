"""Session-level helpers: checkpoint folder, parallel input, size-checked joins."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import PySparkTypeError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

BROADCAST_ROW_LIMIT = 100_000
HOT_KEY_SHARE = 2_000
SPLIT_BYTES = 4 * 1024 * 1024
#: Bytes of input per partition that ``spread`` deals out, and its most partitions.
DEALT_BYTES = 32 * 1024 * 1024
MOST_DEALT = 10_000
#: Array elements that ``join_sparse`` broadcasts, and the size of its table of bits beyond.
SPARSE_ITEMS = 500_000
BITS_PER_KEY = 16
BIT_WORDS = 1 << 20
KEY_PATTERN = r"(?i)(0x|X')[0-9a-f]{64}"


_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only in a local session, where driver and executors are one process, a temporary folder
    takes its place. On a cluster each executor would write to its own disk, so an unset
    folder is an error there.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    master = spark.conf.get("spark.master", "local")
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = tempfile.mkdtemp(prefix="veilframe-")
    return _own_dirs[app]


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and continue from there.

    Used where a result must not be recomputed (random nonces, tables read several
    times); a reliable checkpoint survives the loss of executors.
    """
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def hide_keys(spark: SparkSession) -> None:
    """Keep key literals out of plan texts, besides what the session redacts already."""
    own = spark.conf.get("spark.sql.redaction.string.regex", None)
    if not own:
        spark.conf.set("spark.sql.redaction.string.regex", KEY_PATTERN)
    elif KEY_PATTERN not in own:
        spark.conf.set("spark.sql.redaction.string.regex", f"{own}|{KEY_PATTERN}")


def packed(df: DataFrame, *secret: str) -> DataFrame:
    """``materialise`` for many or wide rows: each Arrow batch is written as one compressed piece.

    Rows, their order and their partitions stay. Rows of nested columns take several times the
    bytes of their values in a checkpoint, which Spark does not compress. ``secret`` text columns are
    sealed with a key of this one table. Types that Arrow lacks are written as they are.
    """
    if secret:
        hide_keys(df.sparkSession)
        key = os.urandom(32).hex()
        sealed = df.withColumn("_sealed", F.expr(f"aes_encrypt(to_json(struct({', '.join(secret)})), X'{key}', 'GCM')"))
        kind = ", ".join(f"{c} string" for c in secret)
        opened = packed(sealed.drop(*secret)).withColumn("_sealed", F.expr(
            f"from_json(cast(aes_decrypt(_sealed, X'{key}', 'GCM') AS string), '{kind}')"))
        return opened.select(*[F.col(f"_sealed.{c}") if c in secret else c for c in df.columns])

    try:
        to_arrow_schema(df.schema)
    except PySparkTypeError:
        return materialise(df)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_batch(batch)
            yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["piece"])

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in batch.column(0):
                yield from pa.ipc.open_stream(piece.as_buffer())

    return materialise(df.mapInArrow(pack, "piece binary")).mapInArrow(unpack, df.schema)


def spread(df: DataFrame, *keys: str, splits: int | None = None) -> DataFrame:
    """Repartition by ``keys`` only when the scan has fewer splits than there are cores.

    A small single-file input would otherwise keep the regex work on one core; the texts of
    any larger input stay where they are. Without ``splits`` their number follows from the
    size of the files read: Spark cuts files down to SPLIT_BYTES (its cost of opening a
    file) to give every core a split. Rows of a join or a union are always dealt out: a small
    table may bring most of them, and the size estimated for a join tells nothing of its splits.
    Give 0 where a view makes long texts of a small table. Nothing runs for it.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if splits is not None:
        return df if splits >= cores else df.repartition(cores, *keys)
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size())]
    if len(sizes) == 1 and sizes[0] // SPLIT_BYTES >= cores:
        return df
    return df.repartition(max(cores, min(sum(sizes) // DEALT_BYTES, MOST_DEALT)), *keys)


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str],
                   how: str = "left") -> DataFrame:
    """Equi-join in which null keys meet null keys; key columns come from ``left``."""
    other = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys]
    return left.join(other, same, how).drop(*[f"_right_{k}" for k in keys])


def union_parts(left: DataFrame, right: DataFrame) -> DataFrame:
    """Union of two differently processed parts of one table.

    Spark 4.1 may report the common hash partitioning of both sides for the union and then
    fail when adaptive execution has given them different partition counts, so that
    shortcut is switched off.
    """
    left.sparkSession.conf.set("spark.sql.unionOutputPartitioning", "false")
    return left.unionByName(right)


def small_enough(df: DataFrame, limit: int = BROADCAST_ROW_LIMIT) -> bool:
    """True when ``df`` has at most ``limit`` rows (reads at most ``limit + 1`` of them)."""
    return df.limit(limit + 1).count() <= limit


def join_checked(left: DataFrame, right: DataFrame, on: list[str], how: str = "left",
                 salts: int = 16, small: bool | None = None) -> DataFrame:
    """Join ``left`` to the keyed table ``right`` without a hot key ending in one task.

    ``right`` is broadcast when it is counted to be small (``small`` gives a count made
    before). Otherwise its rows are replicated over ``salts`` and the left rows spread over
    them, so one key that holds a third of the left side is shared by ``salts`` tasks.
    """
    if small_enough(right) if small is None else small:
        return left.join(F.broadcast(right), on, how)
    salt = F.pmod(F.xxhash64(*left.columns), F.lit(salts)).cast("int")
    # the optimizer's size of the replicated side leaves the copies out, so it would broadcast any table
    salted = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).hint("merge")
    return (left.withColumn("_salt", salt).join(salted, [*on, "_salt"], how).drop("_salt"))


def join_sparse(left: DataFrame, right: DataFrame, keys: list[str], present: DataFrame,
                items: str = "1") -> DataFrame:
    """Null-safe left join of wide rows to ``right``, which has partners for some of them only.

    ``present`` is materialised and holds the keys of ``right``; ``items`` counts what one of its
    rows brings. Up to BROADCAST_ROW_LIMIT rows and SPARSE_ITEMS are broadcast. For more, a table of bits of their key hashes is (at most
    BIT_WORDS numbers): left rows whose bit is not set have no partner and pass through where
    they are, and only the others are shuffled. A bit set by chance costs a shuffle, no row.
    """
    many, brought = present.agg(F.count(F.lit(1)), F.expr(f"coalesce(sum({items}), 0)")).first()
    if many <= BROADCAST_ROW_LIMIT and brought <= SPARSE_ITEMS:
        return join_null_safe(left, F.broadcast(right), keys)
    words = min(max(many * BITS_PER_KEY // 64, 1), BIT_WORDS)

    bit = F.pmod(F.xxhash64(*keys), F.lit(words * 64)).alias("_bit")
    word = F.expr("_bit div 64").alias("_word")
    bits = (present.select(bit).groupBy(word)
            .agg(F.expr("bit_or(shiftleft(1L, cast(_bit % 64 AS int)))").alias("_bits")))
    tagged = (left.select("*", bit).select("*", word)
              .join(F.broadcast(materialise(bits)), "_word", "left")
              .withColumn("_met", F.expr("coalesce(shiftright(_bits, cast(_bit % 64 AS int)) & 1L, 0L) = 1"))
              .drop("_word", "_bit", "_bits"))
    met = join_null_safe(tagged.filter("_met").drop("_met"), right, keys)
    none = [F.lit(None).cast(f.dataType).alias(f.name) for f in right.schema if f.name not in keys]
    return union_parts(met, tagged.filter("NOT _met").drop("_met").select("*", *none))


def join_hot_split(left: DataFrame, right: DataFrame, key: str, weight: str) -> DataFrame:
    """Left join on the text column ``key``, of which ``right`` has each value once.

    ``weight`` counts the left rows of a key. Keys with more than 1/HOT_KEY_SHARE of all
    rows number at most HOT_KEY_SHARE, so they are broadcast. Their rows then carry a
    spread key that matches nothing in the shuffle join of all other keys, and no task
    gets more than its share. ``left`` is computed once; ``right`` should be materialised.
    """
    total = right.agg(F.sum(weight)).first()[0] or 0
    cut = max(total // HOT_KEY_SHARE, 1)
    values = [c for c in right.columns if c not in (key, weight)]

    def side(rows: DataFrame, tag: str) -> DataFrame:
        return rows.select(F.col(key).alias(f"_{tag}"),
                           F.struct(*values).alias(f"_{tag}_values"))

    hot = side(right.filter(F.col(weight) > cut), "hot")
    cold = side(right.filter(F.col(weight) <= cut), "cold")
    spread_key = F.concat(F.lit("#"), F.xxhash64(*left.columns).cast("string"))
    joined = (left.join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left")
              .withColumn("_key", F.when(F.col("_hot").isNull(), F.col(key))
                          .otherwise(spread_key))
              .join(cold, F.col("_key") == F.col("_cold"), "left"))
    found = F.coalesce("_hot_values", "_cold_values")
    return joined.select(*left.columns, *[found[v].alias(v) for v in values])
