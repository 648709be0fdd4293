"""Whole folders and whole tables: the batch form of ``scrub``."""

from __future__ import annotations

import hmac
import time
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.functions import layout as L
from veilframe.functions import rules as R
from veilframe.functions import spans as S
from veilframe.functions import text as X
from veilframe.functions.arrays import var
from veilframe.operators import audit as A
from veilframe.operators import mapping as M
from veilframe.operators.detect import pick_rules, span_rows
from veilframe.operators.gazetteer import Gazetteer
from veilframe.operators.guard import assert_no_private_columns
from veilframe.operators.model import Model
from veilframe.operators.pseudonymise import grouped_parts, mapped_spans, restore_documents
from veilframe.operators.redact import CHUNK, SPAN_OF_ROW, label_bases
from veilframe.plans.scrub import (PSEUDONYMISE, REDACT, Scrubbed, detector_spans, session_fakes,
                                   written_once)
from veilframe.session import join_null_safe, join_sparse, materialise, packed, spread, union_parts
from veilframe.sources import csvfile as CSV
from veilframe.sources import email as EM
from veilframe.sources import files as FI


FILE_TOO_LARGE = "FileTooLarge"


@dataclass(frozen=True)
class Batch:
    """``done``: a row per file that has a reader: path, format, output_path, content (the new
    bytes, null after an error), source_hash, counts, error. ``rejects``: files of a format
    that is not handled, with the reason. ``mapping``: rows to append, in pseudonymise mode.
    """

    done: DataFrame
    rejects: DataFrame
    mode: str
    threshold: float
    session_id: str | None = None
    mapping: DataFrame | None = None

    @property
    def outputs(self) -> DataFrame:
        return self.done.filter("error IS NULL").select("path", "output_path", "content")

    @property
    def entries(self) -> DataFrame:
        return batch_entries(self, self.done)


def batch_entries(batch: Batch, done: DataFrame, duration_ms: int = 0) -> DataFrame:
    """One audit entry for each row of ``done``."""
    return A.audit_entries(
        done, source=None, output="content", mode=batch.mode, threshold=batch.threshold,
        counts=F.coalesce("counts", F.expr("cast(map() AS map<string,bigint>)")), error="error",
        session_id=batch.session_id, document="path", duration_ms=duration_ms)


def scrub_folder(spark: SparkSession, folder: str, threshold: float = R.DEFAULT_THRESHOLD, *,
                 mode: str = REDACT, entities: Iterable[str] | str | None = None,
                 rules: Iterable[R.Rule] | None = None, gazetteers: Iterable[Gazetteer] = (),
                 model: Callable[[], Model] | None = None, session_id: str | None = None,
                 key: bytes | None = None, mapping: DataFrame | None = None) -> Batch:
    """Scrub all text, CSV and mail files below ``folder``; sub-folders are kept in the names.

    A text or mail file is one row with an array of chunks: lines, or headers and bodies. A CSV file is
    several, with some thousand cells each; its numbering goes on from piece to piece. In
    pseudonymise mode all files share one session and its mapping. A file that cannot be
    read or written becomes an audit entry with an error class and has no output, and so does
    one over Spark's limit for whole files; ``scrub_csv`` reads CSV files of any size.
    """
    if mode not in (REDACT, PSEUDONYMISE):
        raise ValueError(f"unknown mode {mode!r}")
    if mode == PSEUDONYMISE and key is None:
        raise ValueError("pseudonymise mode needs a key, see derive_key")
    if isinstance(entities, str):
        entities = R.parse_entities(entities)
    how = {"rules": pick_rules(entities, rules), "threshold": threshold}
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    most = _most_bytes(spark)
    files = raw.select("path", "length")
    # the reader tests the length before it reads a file
    known = FI.discover(raw.filter(F.col("length") <= most).select("path", "content"))
    M.hide_keys(spark)
    gazetteers = tuple(gazetteers)
    detect = (gazetteers, model, entities, how)
    found, spans = _detect(_parsed(known), *detect)
    tables = known.filter("format = 'csv'")
    cells, cell_rows = _detect(CSV.chunk_pieces(tables), *detect)
    stored = _stored_spans(cells, None if mode == REDACT else key, cell_rows if gazetteers or model is not None else None)

    fresh = None
    if mode == REDACT:
        found = found.withColumn("parts", F.expr(L.labelled(L.numbered("hits"))))
        base = label_bases(stored.withColumn(CHUNK, F.lit(0)), "path", "piece").drop(CHUNK)
        x = var("x")                                             # a piece's labels go on from those before it
        hits = f"transform(spans, {x} -> named_struct('ord', {x}.ord, 'spans', array({x})))"
        cell_parts = join_null_safe(stored, base, _PIECE).select(
            *_PIECE, F.expr(L.labelled(L.numbered(hits, "bases"))).alias("parts"))
    else:
        session_id = session_id or str(uuid.uuid4())
        secret = hmac.new(key, session_id.encode(), "sha256").hexdigest()
        columns = [*_PIECE, "chunk_ord", "entity_type", "start", "end", "original"]
        spans = union_parts(spans.select(*columns), _span_rows(stored, key))
        fresh = M.build_mapping(spans, session_id, key, salt=secret, existing=mapping, doc="path")
        fakes = session_fakes(fresh, mapping, session_id, spans)
        parts = mapped_spans(spans, fakes).groupBy(*_PIECE).agg(F.array_sort(F.collect_list(F.expr(
            "struct(chunk_ord AS ord, start, end, fake_value AS value)"))).alias("parts"))
        found = join_null_safe(found, parts, _PIECE).withColumn("parts", F.expr(
            f"coalesce(parts, cast(array() AS {L.PARTS_TYPE}))"))
        cell_parts = parts

    keep = ["path", "format", "content", "counts", "error"]
    ready = found.withColumn("counts", A.count_map()).drop("hits")
    texts = ready.filter("format = 'txt'").select(*keep, F.encode(F.expr(
        L.rebuilt(FI.X.utf8("content"), "parts")), "UTF-8").alias("new"))
    mails = EM.write_mails(ready.filter("format = 'eml'").select(*keep, "chunks", "parts"), "content", "new")
    done = union_parts(texts, mails).withColumn("source_hash", F.sha2("content", 256)).drop("content")
    counts = stored.select(*_PIECE, F.expr(L.entity_counts("array(named_struct('spans', spans))")).alias("counts"))
    rows = join_null_safe(join_null_safe(CSV.row_pieces(tables), cell_parts, _PIECE), counts, _PIECE)
    done = union_parts(done, CSV.write_pieces(rows).withColumn("format", F.lit("csv"))).select(
        "path", "format", FI.output_name("path").alias("output_path"), F.col("new").alias("content"),
        "source_hash", "counts", "error")
    large = FI.discover(files.filter(F.col("length") > most)).filter(F.col("format").isin(*FI.READABLE)).select(
        "path", "format", FI.output_name("path").alias("output_path"),
        F.lit(None).cast("binary").alias("content"), F.sha2(F.lit(""), 256).alias("source_hash"),
        F.expr("cast(map() AS map<string,bigint>)").alias("counts"), F.lit(FILE_TOO_LARGE).alias("error"))
    done = union_parts(done, large)
    rejects = (FI.format_errors(files.select("path"))
               .withColumn("error", F.expr(
                   f"coalesce(error, IF(format NOT IN ({_handled()}), 'no reader here', NULL))"))
               .filter("error IS NOT NULL"))
    return Batch(done, rejects, mode, threshold, session_id if mode == PSEUDONYMISE else None, fresh)


def restore_contents(contents: DataFrame, pairs: DataFrame) -> DataFrame:
    """Files ``(path, content)`` with every fake of ``pairs`` replaced by its real value.

    Files are taken as UTF-8 text, whatever their format; fakes are found as in
    ``restore_documents``. Gives ``path, output_path, content``.
    """
    texts = contents.select("path", F.expr(X.utf8("content")).alias("_text"))
    done = restore_documents(texts, "path", "_text", pairs)
    return done.select("path", FI.output_name("path", FI.RESTORED, keep_format=True).alias("output_path"),
                       F.encode("restored_text", "UTF-8").alias("content"))


def restore_folder(spark: SparkSession, folder: str, mapping: DataFrame, session_id: str, key: bytes) -> DataFrame:
    """The counterpart of ``scrub_folder``: all text, CSV and mail files below ``folder`` restored.

    ``mapping`` holds the stored rows of the session; outputs of an earlier restore are left out. A
    wrong key, or a session without rows, is an error; a file over Spark's limit for whole files
    is left out as well, see ``scrub_folder``.
    """
    if mapping.filter(F.col("session_id") == session_id).isEmpty():
        raise M.MappingError(f"the mapping has no rows of session {session_id!r}")
    M.check_key(mapping, session_id, key)
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    files = FI.discover(raw.filter(F.col("length") <= _most_bytes(spark)).select("path", "content"), suffix=FI.RESTORED)
    return restore_contents(files.filter(F.col("format").isin(*FI.READABLE)), M.replacements(mapping, session_id, key))


def _most_bytes(spark: SparkSession) -> int:
    """Length up to which the reader takes a file as one row."""
    return int(spark.conf.get("spark.sql.sources.binaryFile.maxLength", str(2**31 - 1)))


_PIECE = ["path", "piece"]


def _parsed(known: DataFrame) -> DataFrame:
    """``path, piece, content, format, error, chunks`` of the text and mail files."""
    columns = [*_PIECE, "content", "format", "error", "chunks"]
    x = var("x")
    known = known.withColumn("piece", F.lit(0))
    lines = (f"transform({L.chunks_of(FI.X.utf8('content'))}, {x} -> named_struct('ord', {x}.ord, "
             f"'part', cast(NULL AS string), 'content_type', cast(NULL AS string), "
             f"'text', {x}.text))")
    texts = known.filter("format = 'txt'").select(
        *_PIECE, "content", "format", F.lit(None).cast("string").alias("error"),
        F.expr(lines).alias("chunks"))
    rows = known.filter("format = 'eml'").select(*_PIECE, "content", "format")
    return union_parts(texts, EM.parse_mails(rows).select(*columns))


def _detect(parsed: DataFrame, gazetteers: tuple[Gazetteer, ...], model, entities,
            how: dict) -> tuple[DataFrame, DataFrame]:
    """``parsed`` with ``hits``, and the same spans as rows ``(path, piece, chunk_ord, …)``."""
    if not gazetteers and model is None:
        found = EM.hits_of_parsed(parsed, how["rules"], how["threshold"])
        return found, span_rows(found, *_PIECE)
    chunks = parsed.select(*_PIECE, F.lit(0).alias(CHUNK), F.expr("inline(chunks)")).select(
        *_PIECE, CHUNK, F.col("ord").alias("chunk_ord"), F.col("text").alias("_text"))
    keys = [*_PIECE, CHUNK, "chunk_ord"]
    rows = detector_spans(chunks, keys, gazetteers, model,
                          None if entities is None else set(entities), how)
    if model is not None:
        rows = written_once(rows, chunks, keys)
    hit = f"named_struct('ord', chunk_ord, 'text', '', 'spans', array({SPAN_OF_ROW}))"
    per_file = rows.groupBy(*_PIECE).agg(F.collect_list(F.expr(hit)).alias("hits"))
    found = join_null_safe(parsed, per_file, _PIECE).withColumn("hits", F.expr(
        f"coalesce(hits, cast(array() AS array<{L.HIT_TYPE}>))"))
    return found, rows.drop(CHUNK)


def _stored_spans(found: DataFrame, key: bytes | None, rows: DataFrame | None = None) -> DataFrame:
    """``path, piece, spans`` of the pieces with spans, written once, so that their detection runs once.

    The spans are those of the ``hits`` in ``found``, or ``rows`` of any detector. With ``key``, ``_originals`` has
    their texts in the same order, sealed.
    """
    h, s, x = var("h"), var("s"), var("x")
    fields = "named_struct('ord', {0}, 'start', {1}.start, 'end', {1}.end, 'entity', {1}.entity"
    if rows is None:
        flat = (f"flatten(transform(hits, {h} -> transform({h}.spans, {s} -> {fields.format(f'{h}.ord', s)}, "
                f"'original', {S.span_text(f'{h}.text', s)}))))")
        some = found.select(*_PIECE, F.expr(
            f"inline(filter(array(named_struct('_flat', {flat})), {x} -> size({x}._flat) > 0))"))
    else:
        some = rows.groupBy(*_PIECE).agg(F.collect_list(F.struct(
            F.col("chunk_ord").alias("ord"), "start", "end", F.col("entity_type").alias("entity"), "original")).alias("_flat"))
    spans = F.expr(f"transform(_flat, {s} -> {fields.format(f'{s}.ord', s)}))").alias("spans")
    if key is None:
        return packed(some.select(*_PIECE, spans))
    originals = M.encrypt(f"to_json(transform(_flat, {s} -> {s}.original))", key)
    return packed(some.select(*_PIECE, spans, F.expr(originals).alias("_originals")))


def _span_rows(stored: DataFrame, key: bytes) -> DataFrame:
    """One row per stored span with its original."""
    s, o = var("s"), var("o")
    originals = f"from_json({M.decrypt('_originals', key)}, 'array<string>')"
    return stored.select(*_PIECE, F.expr(
        f"inline(zip_with(spans, {originals}, ({s}, {o}) -> named_struct('chunk_ord', {s}.ord, 'entity_type', {s}.entity, "
        f"'start', {s}.start, 'end', {s}.end, 'original', {o})))"))


def _handled() -> str:
    return ", ".join(f"'{f}'" for f in FI.READABLE)


def write_outputs(batch: Batch, outputs: str, log: str) -> None:
    """Store outputs as parquet and append the audit entries.

    Files are scrubbed once: the entries are made from the stored rows, so a logged hash is
    that of the stored bytes. The logged duration is each file's share of the time taken.
    """
    begun = time.monotonic()
    assert_no_private_columns(batch.done).write.mode("errorifexists").parquet(outputs)
    spent = (time.monotonic() - begun) * 1000
    stored = batch.done.sparkSession.read.parquet(outputs)
    A.append_entries(batch_entries(batch, stored, int(spent / max(stored.count(), 1))), log)


def scrub_table(df: DataFrame, row: str, columns: list[str], table: str | None = None,
                threshold: float = R.DEFAULT_THRESHOLD,
                rules: Iterable[R.Rule] | None = None) -> DataFrame:
    """The redacted cells of ``columns``, see ``scrub_cells``."""
    return scrub_cells(df, row, columns, table, threshold=threshold, rules=rules).texts.drop("entity_counts")


def scrub_cells(df: DataFrame, row: str, columns: list[str], table: str | None = None, *,
                mode: str = REDACT, threshold: float = R.DEFAULT_THRESHOLD,
                entities: Iterable[str] | str | None = None, rules: Iterable[R.Rule] | None = None,
                gazetteers: Iterable[Gazetteer] = (), model: Callable[[], Model] | None = None,
                session_id: str | None = None, key: bytes | None = None,
                mapping: DataFrame | None = None) -> Scrubbed:
    """Scrub the cells of ``columns``, numbered over the whole table (or per ``table``).

    ``row`` is a whole number that orders the rows; a row is one chunk with an array of cells.
    Every row comes out, with cells as text without outer white space and ``entity_counts``;
    null and blank cells stay as they are. Rows with a null or repeated number are told apart
    by their cells. Detection runs once; its spans are written (without originals, or with sealed
    ones in pseudonymise mode) and joined to the rows that have them.
    """
    if mode not in (REDACT, PSEUDONYMISE):
        raise ValueError(f"unknown mode {mode!r}")
    if mode == PSEUDONYMISE and key is None:
        raise ValueError("pseudonymise mode needs a key, see derive_key")
    if isinstance(entities, str):
        entities = R.parse_entities(entities)
    chosen = pick_rules(entities, rules)
    keyed = _keyed_cells(df, row, columns, table)
    x = var("x")
    keys = ["_table", "_row", CHUNK]
    if gazetteers or model is not None:
        cells = keyed.select(*keys, F.posexplode("_cells").alias("chunk_ord", "_text")).filter("_text IS NOT NULL")
        rows = detector_spans(cells, [*keys, "chunk_ord"], tuple(gazetteers), model,
                              None if entities is None else set(entities),
                              {"rules": chosen, "threshold": threshold})
        hit = f"named_struct('ord', chunk_ord, 'text', '', 'spans', array({SPAN_OF_ROW}))"
        hits = rows.groupBy(*keys).agg(F.collect_list(F.expr(hit)).alias("hits"))
    else:
        hits = _cell_hits(keyed, keys, chosen, threshold)
        rows = span_rows(hits, *keys)

    fresh = None
    if mode == REDACT:
        h = var("h")
        offsets = f"transform(hits, {h} -> named_struct('ord', {h}.ord, 'text', '', 'spans', {h}.spans))"
        found = materialise(hits.withColumn("hits", F.expr(offsets)).dropDuplicates(keys))
        flat = found.select(*keys, F.expr(f"flatten(transform(hits, {h} -> {h}.spans))").alias("spans"))
        changes = join_null_safe(found, label_bases(flat, "_table", "_row"), keys).select(
            *keys, F.expr(L.labelled(L.numbered("hits", "bases"))).alias("_parts"),
            A.count_map().alias("entity_counts"))
        items = f"size(flatten(transform(hits, {h} -> {h}.spans)))"
    else:
        M.hide_keys(df.sparkSession)
        session_id = session_id or str(uuid.uuid4())
        secret = hmac.new(key, session_id.encode(), "sha256").hexdigest()
        found = materialise(rows.withColumn("original", F.expr(M.encrypt("original", key))))
        spans = found.withColumn("original", F.expr(M.decrypt("original", key)))
        placed = spans.withColumn("chunk_ord", F.struct("_row", "chunk_ord"))
        fresh = M.build_mapping(placed, session_id, key, salt=secret, existing=mapping, doc="_table")
        changes = grouped_parts(mapped_spans(spans, session_fakes(fresh, mapping, session_id, spans)), keys)
        items = "1"

    def cell(k: int) -> str:
        own = f"filter(_parts, {x} -> {x}.ord = {k})"
        return (f"IF(_cells[{k}] IS NULL OR _parts IS NULL, _cells[{k}], "
                f"{S.splice(f'_cells[{k}]', own)})")

    names = [F.col("_row").alias(row), *([] if table is None else [F.col("_table").alias(table)])]
    texts = join_sparse(keyed, changes, keys, found, items).select(
        *names, *[F.expr(cell(k)).alias(c) for k, c in enumerate(columns)],
        F.expr("coalesce(entity_counts, cast(map() AS map<string,bigint>))").alias("entity_counts"))
    return Scrubbed(texts, fresh, session_id if mode == PSEUDONYMISE else None)


def _keyed_cells(df: DataFrame, row: str, columns: list[str], table: str | None) -> DataFrame:
    """``_table, _row, CHUNK, _cells`` with cells stripped; blank and null ones as they are."""
    keyed = spread(df.select(
        (F.lit("") if table is None else F.col(f"`{table}`")).alias("_table"),
        F.col(f"`{row}`").alias("_row"),
        F.array(*[F.col(f"`{c}`").cast("string") for c in columns]).alias("_cells")), "_row")
    x = var("x")
    clean = F.expr(f"transform(_cells, {x} -> IF({x} IS NULL OR NOT {X.not_blank(x)}, {x}, "
                   f"{X.stripped(x)}))")
    return keyed.withColumn("_cells", clean).withColumn(CHUNK, F.xxhash64("_cells"))


def _cell_hits(keyed: DataFrame, keys: list[str], chosen: tuple[R.Rule, ...], threshold: float) -> DataFrame:
    """``keys, hits`` of the rows with spans."""
    x, i, y = var("x"), var("i"), var("y")
    likely = S.may_match("array_join(_cells, ' ')", chosen)
    cells = (f"filter(transform(_cells, ({x}, {i}) -> named_struct('ord', {i}, 'text', {x})), "
             f"{y} -> {y}.text IS NOT NULL)")
    hits = L.hits_of_chunks(cells, chosen, threshold)
    return (keyed.filter(f"coalesce({likely}, false)")
            .select(*keys, F.expr(f"inline(filter(array(named_struct('hits', {hits})), {x} -> size({x}.hits) > 0))")))


def scrub_csv(spark: SparkSession, path: str, threshold: float = R.DEFAULT_THRESHOLD) -> DataFrame:
    """Every cell of large CSV files redacted, see ``scrub_csv_files``."""
    return scrub_csv_files(spark, path, threshold=threshold).texts.drop("entity_counts")


def scrub_csv_files(spark: SparkSession, path: str, **how) -> Scrubbed:
    """Scrub every cell of large CSV files with one header, split over many tasks, with all options
    of ``scrub_cells``; each file has its own numbering. Adds ``FI.PATH`` and ``FI.ROW``."""
    rows = FI.read_csv(spark, path)
    columns = [c for c in rows.columns if c not in (FI.PATH, FI.ROW)]
    return scrub_cells(rows, FI.ROW, columns, FI.PATH, **how)
