"""The public entry point: detect and replace personal data in a table of texts."""

from __future__ import annotations

import hmac
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.functions import checksums as C
from veilframe.functions import layout as L
from veilframe.functions import rules as R
from veilframe.functions import text as X
from veilframe.operators import mapping as M
from veilframe.operators.audit import count_map
from veilframe.operators.detect import (line_table, pick_rules, raw_chunk_spans, resolved_rows,
                                        with_hits)
from veilframe.operators.gazetteer import Gazetteer, gazetteer_spans
from veilframe.operators.model import Model, model_spans
from veilframe.operators.pseudonymise import (detect_once, pseudonymise_chunks,
                                              pseudonymise_documents)
from veilframe.operators.redact import (CHUNK, redact_chunk_rows, redact_chunks,
                                        redact_document_rows, redact_documents, text_hash)
from veilframe.session import join_null_safe, materialise, spread, union_parts

REDACT, PSEUDONYMISE = "redact", "pseudonymise"


@dataclass(frozen=True)
class Scrubbed:
    """``texts``: the input with ``scrubbed_text`` and ``entity_counts``, a map per row;
    ``mapping``: rows to append, or None."""

    texts: DataFrame
    mapping: DataFrame | None = None
    session_id: str | None = None


def scrub(df: DataFrame, doc: str, text: str = "text", *, order: str | None = None,
          mode: str = REDACT, threshold: float = R.DEFAULT_THRESHOLD,
          entities: Iterable[str] | str | None = None, rules: Iterable[R.Rule] | None = None,
          gazetteers: Iterable[Gazetteer] = (), model: Callable[[], Model] | None = None,
          session_id: str | None = None, key: bytes | None = None,
          mapping: DataFrame | None = None) -> Scrubbed:
    """Scrub ``text`` of a table keyed by ``doc``, or by ``(doc, order)`` with ``order`` given.

    Without ``order`` each row is a whole document, worked on line by line in place; with
    it each row is one chunk of a document. ``gazetteers`` and ``model`` add detectors to
    the rules; their spans travel as rows, so documents are then joined once to their
    spans. Pseudonymise mode needs ``key``; ``mapping`` is what earlier runs of the session
    stored.
    """
    if mode not in (REDACT, PSEUDONYMISE):
        raise ValueError(f"unknown mode {mode!r}")
    if not 0 <= threshold <= 1:
        raise ValueError("threshold must be between 0 and 1")
    if mode == PSEUDONYMISE and key is None:
        raise ValueError("pseudonymise mode needs a key, see derive_key")
    if isinstance(entities, str):
        entities = R.parse_entities(entities)
    how = {"rules": pick_rules(entities, rules), "threshold": threshold}
    df = spread(df, *([doc] if order is None else [doc, order]))
    rows = None
    if gazetteers or model is not None:
        keyed = df.select("*", text_hash(text))
        chunks = (line_table(keyed, doc, CHUNK, text=text).withColumnRenamed("text", "_text")
                  if order is None else keyed.select(doc, order, CHUNK, F.col(text).alias("_text")))
        keys = [doc, CHUNK, "chunk_ord"] if order is None else [doc, order, CHUNK]
        rows = detector_spans(chunks, keys, tuple(gazetteers), model,
                              None if entities is None else set(entities), how)
        if model is not None:
            rows = written_once(rows, chunks, keys)

    if mode == REDACT:
        if order is not None:
            out = (redact_chunks(df, doc, order, text, **how) if rows is None
                   else redact_chunk_rows(df, rows, doc, order, text))
            counts = F.map_from_entries(F.expr(
                L.entity_counts("array(named_struct('spans', spans))")))
            return Scrubbed(out.withColumn("entity_counts", counts).drop("spans", "parts"))
        out = (redact_documents(with_hits(df, text, **how), text) if rows is None
               else redact_document_rows(df, rows, doc, text))
        return Scrubbed(out.withColumn("entity_counts", count_map()).drop("hits", "parts"))

    session_id = session_id or str(uuid.uuid4())
    secret = hmac.new(key, session_id.encode(), "sha256").hexdigest()
    once = None
    if rows is None:
        once = detect_once(df, text, key, session_id + secret, chunk=order is not None, **how)
        rows = once.span_rows(doc, *([] if order is None else [order]))
    placed = rows if order is None else rows.withColumn("chunk_ord", F.col(order))
    fresh = M.build_mapping(placed, session_id, key, salt=secret, existing=mapping, doc=doc)
    if once is not None:
        out = once.pseudonymised(known_fakes(fresh, mapping, session_id))
        return Scrubbed(out, fresh, session_id)
    session = session_fakes(fresh, mapping, session_id, rows)
    if order is None:
        out = pseudonymise_documents(df, doc, text, session, spans=rows, **how)
    else:
        out = pseudonymise_chunks(df, doc, order, text, session, spans=rows, **how)
    return Scrubbed(out, fresh, session_id)


def known_fakes(fresh: DataFrame, mapping: DataFrame | None, session_id: str) -> DataFrame:
    """``original_hash, fake_value`` of a session: new rows and those of earlier runs."""
    rows = fresh.select("original_hash", "fake_value")
    if mapping is None:
        return rows
    return union_parts(rows, mapping.filter(F.col("session_id") == session_id)
                       .select("original_hash", "fake_value"))


def detector_spans(chunks: DataFrame, keys: list[str], gazetteers: tuple[Gazetteer, ...],
                   model: Callable[[], Model] | None, entities: set[str] | None,
                   how: dict) -> DataFrame:
    """Resolved span rows of the rules, the gazetteers and the model over ``_text``."""
    rows = raw_chunk_spans(chunks, *keys, text="_text", **how)
    more = [gazetteer_spans(chunks, keys, "_text", g) for g in gazetteers]
    if model is not None:
        more.append(model_spans(chunks.filter(X.not_blank("_text")), keys, "_text", model))
    for extra in more:
        extra = extra.filter(F.col("score") >= how["threshold"])
        if entities is not None:
            extra = extra.filter(F.col("entity_type").isin(*entities))
        rows = union_parts(rows, extra)
    return resolved_rows(rows, keys)


def written_once(rows: DataFrame, chunks: DataFrame, keys: list[str]) -> DataFrame:
    """Span rows through the checkpoint folder, so that a model runs once.

    Only offsets are written; the originals are cut from the texts again.
    """
    stored = materialise(rows.drop("original"))
    cut = join_null_safe(stored, chunks.dropDuplicates(keys), keys)
    return cut.withColumn("original", F.expr(
        "substring(_text, start + 1, end - start)")).drop("_text")


def session_fakes(fresh: DataFrame, mapping: DataFrame | None, session_id: str,
                  spans: DataFrame) -> DataFrame:
    """Fakes of this run: the new ones and, with their counts here, those of earlier runs."""
    columns = ["original_hash", "fake_value", "occurrences"]
    if mapping is None:
        return fresh.select(*columns)
    counted = (spans.groupBy(F.expr(C.hex_hash("original")).alias("original_hash"))
               .agg(F.count(F.lit(1)).alias("occurrences")))
    known = (mapping.filter(F.col("session_id") == session_id)
             .select("original_hash", "fake_value").join(counted, "original_hash"))
    return materialise(union_parts(fresh.select(*columns), known.select(*columns)))
