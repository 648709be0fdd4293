"""Audit log of scrubbed documents: build, validate, append, query, export."""

from __future__ import annotations

import hashlib
import socket
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.functions import checksums as C
from veilframe.functions import layout as L
from veilframe.operators.guard import assert_no_private_columns

VERSION = "0.1.0"
ENGINE = "rules"
HASH_COLUMNS = ("source_hash", "output_hash", "operator_hash")

# Field order of the exported log.
EXPORT_COLUMNS = (
    "event_id", "timestamp_utc", "source_hash", "output_hash", "operator_hash",
    "engine_version", "detector", "threshold", "mode", "entity_type_counts",
    "processing_duration_ms", "error_flag", "error_message", "session_id",
)
LIST_COLUMNS = ("event_id", "timestamp_utc", "mode", "entity_type_counts",
                "processing_duration_ms", "error_flag")


def operator_hash() -> str:
    return hashlib.sha256(socket.gethostname().encode()).hexdigest()


def count_map(hits: str = "hits") -> Column:
    """``map<entity, count>`` of a table with ``hits``."""
    return F.map_from_entries(F.expr(L.entity_counts(hits)))


def audit_entries(scrubbed: DataFrame, *, source: str | None, output: str = "scrubbed_text",
                  mode: str, threshold: float, duration_ms: int = 0,
                  operator: str | None = None, session_id: str | None = None,
                  timestamp: datetime | None = None, error: str | None = None,
                  keys: tuple[str, ...] = (), counts: Column | None = None,
                  document: str | None = None) -> DataFrame:
    """One entry per document of a table with a source and an output, text or bytes.

    ``counts`` is a ``map<entity, count>``, by default taken from ``hits``. Without
    ``source`` the table has ``source_hash``. ``document`` is the document's key (by default
    the first of ``keys``); it makes the event ids of equal texts differ.

    ``error`` names an optional column with an error class; a failed document is logged
    with the flag set and the hash of the empty text as output.
    """
    failed = F.lit(False) if error is None else F.col(error).isNotNull()
    message = F.lit("") if error is None else F.coalesce(F.col(error), F.lit(""))
    when = F.current_timestamp() if timestamp is None else F.lit(timestamp)
    source_hash = F.col("source_hash") if source is None else F.sha2(source, 256)
    output_hash = F.sha2(output, 256)
    document = document or (keys[0] if keys else None)
    own = F.lit("") if document is None else F.coalesce(F.col(document).cast("string"), F.lit(""))
    empty_hash = F.expr(C.hex_hash("''"))
    return scrubbed.select(
        *keys,
        F.sha2(F.concat_ws("|", source_hash, F.lit(mode), F.lit(session_id or ""),
                           when.cast("string"), own), 256).alias("event_id"),
        when.alias("timestamp_utc"), source_hash.alias("source_hash"),
        F.when(failed, empty_hash).otherwise(output_hash).alias("output_hash"),
        F.lit(operator or operator_hash()).alias("operator_hash"),
        F.lit(VERSION).alias("engine_version"), F.lit(ENGINE).alias("detector"),
        F.lit(str(threshold)).alias("threshold"), F.lit(mode).alias("mode"),
        (count_map() if counts is None else counts).alias("entity_type_counts"),
        F.lit(duration_ms).alias("processing_duration_ms"), failed.alias("error_flag"),
        message.alias("error_message"),
        F.lit(session_id).cast("string").alias("session_id"))


def invalid_field(counts: str = "entity_type_counts") -> Column:
    """Name of the first field that breaks a rule, or NULL for a valid entry.

    Hashes are 64 hexadecimal digits; count keys are capital letters and underscores.
    """
    checks = F.lit(None).cast("string")
    keys_ok = F.forall(F.map_keys(counts), lambda k: k.rlike("^[A-Z_]*[A-Z][A-Z_]*$"))
    checks = F.when(~keys_ok, F.lit("entity_type_counts")).otherwise(checks)
    for name in reversed(HASH_COLUMNS):
        ok = F.coalesce(F.col(name).rlike("^[0-9a-fA-F]{64}$"), F.lit(False))
        checks = F.when(~ok, F.lit(name)).otherwise(checks)
    return checks


def append_entries(entries: DataFrame, path: str) -> None:
    """Append valid entries; the job fails, and nothing is committed, on an invalid one."""
    bad = invalid_field()
    guard = F.when(bad.isNull(), F.lit(True)).otherwise(
        F.raise_error(F.concat(F.lit("audit entry rejected, field: "), bad)).cast("boolean"))
    assert_no_private_columns(entries).filter(guard).write.mode("append").parquet(path)


def query_log(log: DataFrame, since: datetime | None = None, until: datetime | None = None,
              session_id: str | None = None) -> DataFrame:
    """Entries in time order, with optional inclusive bounds and session."""
    if since is not None:
        log = log.filter(F.col("timestamp_utc") >= F.lit(since))
    if until is not None:
        log = log.filter(F.col("timestamp_utc") <= F.lit(until))
    if session_id is not None:
        log = log.filter(F.col("session_id") == session_id)
    return log.orderBy("timestamp_utc", "event_id")


def export_frame(log: DataFrame) -> DataFrame:
    """The fixed export columns, counts as JSON text."""
    return log.withColumn("entity_type_counts", F.to_json("entity_type_counts")).select(
        *EXPORT_COLUMNS)


def export_csv(log: DataFrame, path: str) -> int:
    """Write the export as CSV with a header; an empty log writes nothing and returns 0."""
    rows = log.count()
    if rows:
        export_frame(log).write.option("header", True).csv(path)
    return rows
