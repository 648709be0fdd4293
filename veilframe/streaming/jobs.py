"""Structured Streaming jobs: scrub new documents, count detections per time window."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from veilframe.functions import layout as L
from veilframe.functions import rules as R
from veilframe.operators.audit import audit_entries
from veilframe.operators.detect import with_hits
from veilframe.operators.guard import assert_no_private_columns
from veilframe.operators.redact import redact_documents
from veilframe.plans.scrub import REDACT, scrub
from veilframe.streaming import runs as RU


def read_stream(spark: SparkSession, folder: str, schema: StructType, glob: str | None = None,
                max_files: int | None = None, table: str | None = None) -> DataFrame:
    """A stream of the parquet files of ``folder`` whose own names match ``glob``, or of its
    ``table``, which may be one file or a folder of files."""
    reader = spark.readStream.schema(schema)
    if glob is not None:
        reader = reader.option("pathGlobFilter", glob)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    # in braces the path is a pattern: the source takes a plain path for a folder only
    return reader.parquet(folder if table is None else f"{folder.rstrip('/')}/{{{table}}}")


def scrub_stream(source: DataFrame, doc: str, text: str, target: str, checkpoint: str,
                 threshold: float = R.DEFAULT_THRESHOLD, partitions: int | None = None):
    """Redact every document not seen before and append it to ``target``.

    A document lies in one row, so its labels need no state across batches and the plain
    file sink keeps its exactly-once commit log. ``partitions`` spreads batches of few
    small files over more tasks; leave it out for large batches.
    """
    if partitions is not None:
        source = source.repartition(partitions, doc)
    scrubbed = redact_documents(with_hits(source, text, threshold=threshold), text)
    return (scrubbed.select(doc, "scrubbed_text").writeStream.format("parquet")
            .option("path", target).option("checkpointLocation", checkpoint)
            .outputMode("append").trigger(availableNow=True).start())


def windowed_counts(events: DataFrame, time: str, kind: str, window: str = "1 hour",
                    delay: str = "1 hour") -> DataFrame:
    """Counts per tumbling window and kind; later rows than ``delay`` are dropped."""
    return (events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)
            .groupBy(F.window(time, window).alias("w"), kind)
            .agg(F.count(F.lit(1)).alias("n"))
            .select(F.col("w.start").alias("window_start"), kind, "n"))


def counts_stream(events: DataFrame, time: str, kind: str, target: str, checkpoint: str,
                  window: str = "1 hour", delay: str = "1 hour"):
    """Append windows to ``target`` once the watermark has passed them."""
    return (windowed_counts(events, time, kind, window, delay).writeStream.format("parquet")
            .option("path", target).option("checkpointLocation", checkpoint)
            .outputMode("append").trigger(availableNow=True).start())


def windowed_detections(events: DataFrame, event: str, time: str, text: str, window: str = "1 hour",
                        delay: str = "1 hour", threshold: float = R.DEFAULT_THRESHOLD) -> DataFrame:
    """Detections per tumbling window and entity, each event once.

    Texts are scanned as they come. An event that comes again within ``delay`` is dropped by its
    key, one that is later than ``delay`` is dropped with its window; the state holds the keys and
    counts of open windows, no texts.
    """
    timed = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)
    once = timed.select(event, time, text).dropDuplicatesWithinWatermark([event])
    found = with_hits(once, text, threshold=threshold).select(
        time, F.expr(f"inline({L.entity_counts('hits')})"))
    return (found.groupBy(F.window(time, window).alias("w"), F.col("entity").alias("entity_type"))
            .agg(F.sum("n").alias("n")).select(F.col("w.start").alias("window_start"), "entity_type", "n"))


def detections_stream(events: DataFrame, event: str, time: str, text: str, target: str, checkpoint: str, **how):
    """Append the detections of windows to ``target`` once the watermark has passed them."""
    return (windowed_detections(events, event, time, text, **how).writeStream.format("parquet")
            .option("path", target).option("checkpointLocation", checkpoint)
            .outputMode("append").trigger(availableNow=True).start())


def scrub_batches(source: DataFrame, doc: str, text: str, target: str, log: str, checkpoint: str, *,
                  store: str | None = None, **how):
    """Scrub new documents with all options of ``scrub`` and log each of them.

    Every micro-batch writes its texts, its audit entries and, in pseudonymise mode, its new
    mapping rows (below ``store``) into folders ``batch=N``. A batch that is run again after
    a failure replaces its own folders, so nothing is stored or logged twice. The entries
    are made from the stored rows. Later batches take the fakes of earlier ones, which they read
    from the few runs of ``runs``, however many batches there were.
    """
    how.setdefault("threshold", R.DEFAULT_THRESHOLD)
    mode = how.get("mode", REDACT)
    if mode != REDACT and (store is None or "session_id" not in how):
        raise ValueError("pseudonymise mode needs a store and a session_id")

    def handle(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        known = None if store is None else RU.read_before(spark, store, number)
        done = scrub(batch, doc, text, mapping=known, **how)
        rows = done.texts.select(doc, "scrubbed_text", F.sha2(text, 256).alias("source_hash"),
                                 "entity_counts")
        rows.write.mode("overwrite").parquet(f"{target}/batch={number}")
        if store is not None:
            RU.add_batch(assert_no_private_columns(done.mapping), store, number)
        stored = spark.read.parquet(f"{target}/batch={number}")
        entries = audit_entries(
            stored, source=None, mode=mode, threshold=how["threshold"], document=doc,
            counts=F.col("entity_counts"), session_id=how.get("session_id"))
        entries.write.mode("overwrite").parquet(f"{log}/batch={number}")

    return (source.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
