"""Registered queries: one per operator, each with reference SQL where SQL can say it."""

from __future__ import annotations

import dataclasses
import hashlib
import os
import tempfile
import uuid
from collections.abc import Callable
from datetime import datetime
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.functions import checksums as C
from veilframe.functions import fakes as K
from veilframe.functions import layout as L
from veilframe.functions import rules as R
from veilframe.functions import spans as S
from veilframe.functions import text as X
from veilframe.functions.arrays import lit, var
from veilframe.operators import audit as A
from veilframe.operators import detect as D
from veilframe.operators import gazetteer as Z
from veilframe.operators import guard as G
from veilframe.operators import mapping as M
from veilframe.operators import pseudonymise as P
from veilframe.operators import redact as RD
from veilframe.operators import summary as U
from veilframe.operators.substrings import OCCURRENCES
from veilframe.plans import batch as B
from veilframe.plans import corpora as Q
from veilframe.plans import oracle as O
from veilframe.plans.scrub import scrub
from veilframe.session import materialise, shared_dir, spread, union_parts
from veilframe.sources import chunks as CH
from veilframe.sources import csvfile as CSV
from veilframe.sources import email as EM
from veilframe.sources import files as FI
from veilframe.streaming import jobs as J

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
KEY = M.derive_key("registered queries", b"\x00" * 32, iterations=1_000)
SESSION = "batch"
FIXED_TIME = datetime(2024, 1, 1)
MIXED = Q.portable(Q.MIXED)
LOW = 0.4
RD_MODE = "redact"
HOST = hashlib.sha256(b"host").hexdigest()


def query(name: str, sql: str | None = None):
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return register


def docs(spark, sf, **kw) -> DataFrame:
    return D.with_hits(Q.documents(spark, sf).select("doc_id", "text"), **kw)


def doc_spans(spark, sf, **kw) -> DataFrame:
    return D.span_rows(docs(spark, sf, **kw), "doc_id")


def planted(spark, sf) -> DataFrame:
    return spread(Q.view(spark, sf, Q.PLANTED), "doc_id", splits=0)


def redacted(spark, sf, **kw) -> DataFrame:
    return RD.redact_documents(docs(spark, sf, **kw))


# Sources and sinks -------------------------------------------------------------------

LISTING = Q.portable(Q.LISTING)
EXT = "lower(regexp_extract(path, '[.]([^./]+)$', 1))"
SUPPORTED_SQL = ", ".join(O.q(s) for s in FI.SUPPORTED)


@query("src_discover", f"SELECT doc_id, path, {EXT} AS format FROM ({LISTING}) AS l "
       f"WHERE {EXT} IN ({SUPPORTED_SQL}) AND path NOT LIKE '%\\_scrubbed.txt' ESCAPE '\\'")
def src_discover(spark, sf):
    return FI.discover(Q.view(spark, sf, Q.LISTING)).select("doc_id", "path", "format")


@query("src_format_reject",
       f"SELECT doc_id, {EXT} AS format, CASE WHEN {EXT} NOT IN ({SUPPORTED_SQL}) THEN "
       f"'unsupported format .' || {EXT} || '; supported: .csv, .docx, .eml, .pdf, .txt, .xlsx' "
       f"END AS error FROM ({LISTING}) AS l")
def src_format_reject(spark, sf):
    return FI.format_errors(Q.view(spark, sf, Q.LISTING)).select("doc_id", "format", "error")


@query("chunk_lines",
       f"SELECT doc_id, chunk_ord, CAST(a AS INTEGER) AS char_offset_start, CAST(a + length(text) "
       f"AS INTEGER) AS char_offset_end, text FROM (SELECT *, coalesce(sum(length(text) + 1) OVER ("
       f"PARTITION BY doc_id ORDER BY chunk_ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), "
       f"0) AS a FROM ({O.lines_of(O.DOCS)}) AS l) AS o WHERE regexp_matches(text, '\\S')")
def chunk_lines(spark, sf):
    return CH.line_chunks(Q.documents(spark, sf), "doc_id")


def _cells_sql(table: str, key: str, columns: list[str], extra: str = "") -> str:
    return " UNION ALL ".join(
        f"SELECT {extra}{key} AS row_id, {i} AS col, '{c}' AS col_name, "
        f"trim(CAST({c} AS VARCHAR)) AS text FROM {table} WHERE trim(CAST({c} AS VARCHAR)) <> ''"
        for i, c in enumerate(columns))


CUSTOMER = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]
SUPPLIER = ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"]
NATION = ["n_nationkey", "n_name", "n_regionkey"]


@query("chunk_cells", _cells_sql("customer", "c_custkey", CUSTOMER))
def chunk_cells(spark, sf):
    return CH.cell_chunks(Q.table(spark, sf, "customer"), "c_custkey", CUSTOMER)


@query("chunk_sheets", " UNION ALL ".join(
    _cells_sql(t, cols[0], cols, f"{i} AS sheet_ord, '{t}' AS sheet, ")
    for i, (t, cols) in enumerate((("customer", CUSTOMER), ("supplier", SUPPLIER),
                                   ("nation", NATION)), start=1)))
def chunk_sheets(spark, sf):
    sheets = (("customer", "c_custkey"), ("supplier", "s_suppkey"), ("nation", "n_nationkey"))
    return CH.sheet_chunks([(t, Q.table(spark, sf, t), k) for t, k in sheets])


def mails(spark, sf) -> DataFrame:
    return spread(Q.view(spark, sf, Q.MAILS), "doc_id", splits=0).select(
        "doc_id", F.encode("mail", "UTF-8").alias("content"))


PLANTED = O.PLANTED
MAIL_PARTS = (
    f"SELECT doc_id, 0 AS chunk_ord, 'from' AS part, 'c' || doc_id || '@example.com' AS text "
    f"FROM ({PLANTED}) AS p UNION ALL SELECT doc_id, 1, 'to', 'desk@example.com' FROM ({PLANTED}) "
    f"AS p UNION ALL SELECT doc_id, 2, 'subject', 'Account ' || doc_id FROM ({PLANTED}) AS p "
    f"UNION ALL SELECT doc_id, 3, 'body0', text || chr(10) FROM ({PLANTED}) AS p"
)


@query("chunk_email",
       f"SELECT *, CAST(coalesce(sum(length(text)) OVER (PARTITION BY doc_id ORDER BY chunk_ord "
       f"ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS char_offset_start, "
       f"0 AS attachment_count FROM ({MAIL_PARTS}) AS m")
def chunk_email(spark, sf):
    return EM.mail_chunks(mails(spark, sf), "doc_id").select(
        "doc_id", "chunk_ord", "part", "text", "char_offset_start", "attachment_count")


@query("rebuild_email",
       f"WITH parts AS ({MAIL_PARTS}), {O.spans_ctes('', chunks='SELECT * FROM parts')}, "
       f"{O.LABELLED}, {O.spliced()} SELECT d.doc_id, part, new AS text FROM done AS d "
       f"JOIN parts AS p USING (doc_id, chunk_ord)")
def rebuild_email(spark, sf):
    done = EM.scrub_mails(mails(spark, sf)).select("doc_id",
                                                   F.col("scrubbed_content").alias("content"))
    return EM.mail_chunks(done, "doc_id").select("doc_id", "part", "text")


PAGE_CHUNKS = "SELECT page_id AS doc_id, 0 AS chunk_ord, html AS text FROM pages"


@query("scrub_pages", O.redacted("", chunks=PAGE_CHUNKS)
       + " SELECT doc_id AS page_id, new AS scrubbed_html FROM done")
def scrub_pages(spark, sf):
    pages = spread(Q.table(spark, sf, "pages"), "page_id")
    chunk = "array(named_struct('ord', 0, 'text', html))"
    found = pages.withColumn("hits", F.expr(L.hits_of_chunks(chunk, O.ALL_RULES)))
    parts = found.withColumn("parts", F.expr(L.labelled(L.numbered("hits"))))
    return parts.select("page_id", F.expr(S.splice("html", "parts")).alias("scrubbed_html"))


SIGNED_CHUNKS = f"SELECT conv_id AS doc_id, turn AS chunk_ord, text FROM ({Q.portable(Q.SIGNED)}) AS g"


def conversations(spark, sf) -> DataFrame:
    return spread(Q.view(spark, sf, Q.SIGNED), "conv_id", "turn")


@query("scrub_conversations", O.redacted("", chunks=SIGNED_CHUNKS)
       + " SELECT doc_id AS conv_id, chunk_ord AS turn, new AS scrubbed_text FROM done")
def scrub_conversations(spark, sf):
    return RD.redact_chunks(conversations(spark, sf), "conv_id", "turn").select(
        "conv_id", "turn", "scrubbed_text")


@query("rebuild_text", O.redacted() + " " + O.WHOLE.format("scrubbed_text"))
def rebuild_text(spark, sf):
    return redacted(spark, sf).select("doc_id", "scrubbed_text")


CELL_CHUNKS = " UNION ALL ".join(
    f"SELECT 1 AS doc_id, CAST(doc_id * 3 + {i} AS BIGINT) AS chunk_ord, {c} AS text "
    f"FROM ({O.PLANTED}) AS p{i}" for i, c in enumerate(
        ("CAST(doc_id AS VARCHAR)", "CAST(variant AS VARCHAR)", "text")))


@query("rebuild_table", O.redacted("", chunks=CELL_CHUNKS)
       + " SELECT chunk_ord // 3 AS row_id, max(new) FILTER (WHERE chunk_ord % 3 = 0) AS doc_id, "
       "max(new) FILTER (WHERE chunk_ord % 3 = 1) AS variant, "
       "max(new) FILTER (WHERE chunk_ord % 3 = 2) AS text FROM done GROUP BY 1")
def rebuild_table(spark, sf):
    rows = planted(spark, sf).withColumn("row_id", F.col("doc_id"))
    return B.scrub_table(rows, "row_id", ["doc_id", "variant", "text"])


BLANK_TABLE = """SELECT c_custkey AS row_id,
  CASE WHEN c_custkey % 3 = 0 THEN NULL WHEN c_custkey % 3 = 1 THEN ' ' ELSE c_name END AS name,
  CASE WHEN c_custkey % 4 = 0 THEN NULL WHEN c_custkey % 4 = 1 THEN '' ELSE
    'c' || cast(c_custkey AS string) || '@example.com' END AS mail FROM {customer}"""
BLANK_CELLS = " UNION ALL ".join(
    f"SELECT 1 AS doc_id, CAST(row_id * 2 + {i} AS BIGINT) AS chunk_ord, {c} AS text FROM "
    f"({Q.portable(BLANK_TABLE)}) AS b{i} WHERE trim({c}) <> ''" for i, c in enumerate(("name", "mail")))


@query("rebuild_blanks", O.redacted("", chunks=BLANK_CELLS) + f" SELECT b.row_id, coalesce(n.new, "
       f"b.name) AS name, coalesce(m.new, b.mail) AS mail FROM ({Q.portable(BLANK_TABLE)}) AS b "
       "LEFT JOIN done AS n ON n.chunk_ord = b.row_id * 2 LEFT JOIN done AS m ON m.chunk_ord = "
       "b.row_id * 2 + 1")
def rebuild_blanks(spark, sf):
    """Blank cells and rows of blanks come back as they were."""
    return B.scrub_table(Q.view(spark, sf, BLANK_TABLE), "row_id", ["name", "mail"])


def _stripped(column: str) -> str:
    """Reference SQL of a cell without outer white space; blank cells stay."""
    space = r"[\s]"
    bare = f"regexp_replace(regexp_replace({column}, '^{space}+', ''), '{space}+$', '')"
    return f"CASE WHEN {bare} = '' THEN {column} ELSE {bare} END"


@query("pseudo_table", f"SELECT doc_id AS row_id, {_stripped('text')} AS text, "
       "CAST(variant AS VARCHAR) AS variant, true AS replaced FROM "
       f"({O.PLANTED}) AS p WHERE text IS NOT NULL")
def pseudo_table(spark, sf):
    """Cells pseudonymised and restored: the table comes back, and no value stood in the output."""
    rows = planted(spark, sf).withColumn("row_id", F.col("doc_id"))
    done = B.scrub_cells(rows, "row_id", ["variant", "text"], mode="pseudonymise", key=KEY, session_id=SESSION)
    given = done.texts.withColumn("_given", F.col("text"))
    back = P.restore_documents(given, "row_id", "text", M.replacements(done.mapping, SESSION, KEY))
    changed = (F.col("_given") != F.col("restored_text")) == (F.size(F.map_keys("entity_counts")) > 0)
    return back.select("row_id", F.col("restored_text").alias("text"), "variant", changed.alias("replaced"))


NULL_CHUNKS = f"""SELECT CASE WHEN conv_id % 5 = 0 THEN NULL ELSE conv_id END AS conv,
  conv_id * 1000 + turn AS place, CASE WHEN turn % 4 = 3 THEN NULL ELSE text END AS text
FROM ({Q.SIGNED}) AS g"""


@query("scrub_nulls", O.redacted("", chunks="SELECT coalesce(conv, -1) AS doc_id, place AS chunk_ord, "
       f"text FROM ({Q.portable(NULL_CHUNKS)}) AS n") + " SELECT nullif(doc_id, -1) AS conv, chunk_ord "
       "AS place, new AS scrubbed_text FROM done")
def scrub_nulls(spark, sf):
    """Null texts stay, and rows with a null key are one document that is scrubbed as well."""
    chunks = spread(Q.view(spark, sf, NULL_CHUNKS), "place")
    return RD.redact_chunks(chunks, "conv", "place").select("conv", "place", "scrubbed_text")


NULL_DOCS = """SELECT doc_id AS n, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE doc_id % 50 END AS doc,
  CASE WHEN doc_id % 7 = 0 THEN NULL ELSE text END AS text FROM {mixed}"""


def null_docs(spark, sf) -> DataFrame:
    return spark.sql(NULL_DOCS, mixed=mixed(spark, sf))


def pseudonymised(rows: DataFrame, doc: str) -> tuple[DataFrame, DataFrame]:
    """Pseudonymised rows of a table ``(doc, text)`` and their mapping, from one detection pass."""
    found = P.detect_once(rows, "text", KEY, SESSION, rules=O.ALL_RULES, threshold=LOW)
    mapping = M.build_mapping(found.span_rows(doc), SESSION, KEY, doc=doc)
    return found.pseudonymised(mapping), mapping


def mixed(spark, sf) -> DataFrame:
    """``Q.MIXED`` with the rows of ``customer`` dealt out before they become texts."""
    own = {n: Q.table(spark, sf, n) for n in ("customer", "nation", "region")}
    own["customer"] = own["customer"].repartition(max(
        spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), "c_custkey")
    rows = Q.documents(spark, sf).select("doc_id", "lang", "text")
    for base, lang, sql in ((1_000_000_000, "planted", Q.PLANTED), (2_000_000_000, "letter", Q.LETTERS)):
        used = {n: t for n, t in own.items() if "{" + n + "}" in sql}
        rows = union_parts(rows, spark.sql(sql, **used).select(
            (F.lit(base) + F.col("doc_id")).alias("doc_id"), F.lit(lang).alias("lang"), "text"))
    return rows


def mixed_spans(spark, sf, **kw) -> DataFrame:
    found = D.with_hits(mixed(spark, sf), threshold=LOW, **kw)
    return D.span_rows(found, "doc_id", "lang")


@query("pseudo_nulls", "WITH " + O.mapped(
    SESSION, source=f"SELECT doc_id, text FROM ({MIXED}) AS m WHERE doc_id % 7 <> 0", threshold=LOW)
    + ", labelled AS (SELECT s.*, m.fake_value AS label FROM spans AS s JOIN mapping "
    "AS m ON m.original_hash = sha256(s.original)), " + O.spliced() + ", whole AS ("
    + O.WHOLE.format("t") + f") SELECT d.doc_id AS n, t AS scrubbed_text FROM ({MIXED}) AS d LEFT JOIN "
    "whole AS w USING (doc_id)")
def pseudo_nulls(spark, sf):
    """Null texts, null keys and repeated keys in pseudonymise mode: every row comes out."""
    return pseudonymised(null_docs(spark, sf), "n")[0].select("n", "scrubbed_text")


@query("output_name",
       f"SELECT doc_id, regexp_replace(path, '[.][^./]+$', '') || '_scrubbed.' || CASE {EXT} "
       f"WHEN 'pdf' THEN 'docx' WHEN 'eml' THEN 'txt' ELSE {EXT} END AS output FROM ({LISTING}) AS l")
def output_name(spark, sf):
    return Q.view(spark, sf, Q.LISTING).select("doc_id", FI.output_name("path").alias("output"))


@query("strip_metadata", "SELECT doc_id, '' AS lang, '' AS source, n_chars FROM documents")
def strip_metadata(spark, sf):
    return CH.strip_metadata(Q.table(spark, sf, "documents"), ["source", "lang", "author"]).select(
        "doc_id", "lang", "source", "n_chars")


# Projections -------------------------------------------------------------------------

@query("spans_text", O.found() + " SELECT doc_id, chunk_ord, s AS start, original FROM spans")
def spans_text(spark, sf):
    return doc_spans(spark, sf).select("doc_id", "chunk_ord", "start", "original")


NOT_BLANK = "regexp_matches(new, '\\S')"


@query("full_text", O.redacted() + " SELECT doc_id, coalesce(string_agg(new, chr(10) ORDER BY "
       f"chunk_ord) FILTER (WHERE {NOT_BLANK}), '') AS full_text FROM done GROUP BY doc_id")
def full_text(spark, sf):
    return redacted(spark, sf).select("doc_id", F.expr(
        X.joined_lines("scrubbed_text", "\n")).alias("full_text"))


@query("preview", O.redacted() + " SELECT doc_id, substr(coalesce(string_agg(new, ' ' ORDER BY "
       f"chunk_ord) FILTER (WHERE {NOT_BLANK}), ''), 1, 600) AS preview, substr(string_agg(new, "
       "chr(10) ORDER BY chunk_ord), 1, 800) AS snippet FROM done GROUP BY doc_id")
def preview(spark, sf):
    return redacted(spark, sf).select("doc_id", F.expr(X.preview("scrubbed_text")).alias("preview"),
                                      F.expr(X.snippet("scrubbed_text")).alias("snippet"))


@query("masked_example", O.found() + " SELECT doc_id, chunk_ord, s AS start, CASE WHEN "
       "length(original) > 3 THEN substr(original, 1, 3) || '***' ELSE '***' END AS masked FROM spans")
def masked_example(spark, sf):
    return doc_spans(spark, sf).select("doc_id", "chunk_ord", "start",
                                       F.expr(X.masked("original")).alias("masked"))


ESCAPED = ("replace(replace(replace(replace(replace(new, '&', '&amp;'), '<', '&lt;'), '>', "
           "'&gt;'), '\"', '&quot;'), '''', '&#x27;')")


@query("html_highlight", O.redacted() + ", marked AS (SELECT doc_id, chunk_ord, regexp_replace("
       + ESCAPED + ", '\\[([A-Z_]+_\\d+)\\]', '<mark class=\"pii\">[\\1]</mark>', 'g') AS new "
       "FROM done) SELECT doc_id, string_agg(new, '<br>' ORDER BY chunk_ord) AS html FROM marked "
       "GROUP BY doc_id")
def html_highlight(spark, sf):
    return redacted(spark, sf).select("doc_id", F.expr(X.highlighted("scrubbed_text")).alias("html"))


@query("label_runs", O.redacted() + ", whole AS (" + O.WHOLE.format("t") + "), cut AS (SELECT doc_id, "
       "generate_subscripts(ps, 1) AS i, unnest(ps) AS p FROM (SELECT doc_id, string_split("
       "regexp_replace(t, '(\\[[A-Z_]+_\\d+\\])', chr(1) || '\\1' || chr(2), 'g'), chr(1)) AS ps "
       "FROM whole) AS w), runs AS (SELECT doc_id, i * 2 AS o, CASE WHEN i > 1 THEN "
       "split_part(p, chr(2), 1) END AS txt, true AS is_label FROM cut UNION ALL SELECT doc_id, "
       "i * 2 + 1, CASE WHEN i > 1 THEN split_part(p, chr(2), 2) ELSE p END, false FROM cut) "
       "SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY o) - 1 AS INTEGER) AS "
       "run_no, txt AS text, is_label FROM runs WHERE txt IS NOT NULL AND txt <> ''")
def label_runs(spark, sf):
    return (redacted(spark, sf)
            .select("doc_id", F.posexplode(F.expr(X.label_runs("scrubbed_text"))))
            .select("doc_id", F.col("pos").alias("run_no"), "col.text", "col.is_label"))


@query("heading_lines", "SELECT doc_id, chunk_ord, s = upper(s) AND length(s) > 2 AND length(s) <= "
       "60 AND NOT regexp_matches(s, '^\\d') AND NOT contains(s, '.') AS is_heading FROM (SELECT *, "
       "trim(text) AS s FROM (" + O.lines_of(O.DOCS) + ") AS l) AS t WHERE s <> ''")
def heading_lines(spark, sf):
    return CH.line_chunks(Q.documents(spark, sf), "doc_id").select(
        "doc_id", "chunk_ord", F.expr(X.is_heading("text")).alias("is_heading"))


JSON_COUNTS = ("'{' || coalesce(string_agg('\"' || entity || '\":' || n, ',' ORDER BY entity), '') "
               "|| '}'")
COUNTS = ("counts AS (SELECT doc_id, entity, count(*) AS n FROM spans GROUP BY 1, 2), "
          f"per_doc AS (SELECT d.doc_id, any_value(d.text) AS text, {JSON_COUNTS} AS "
          "entity_type_counts FROM documents AS d LEFT JOIN counts AS c ON c.doc_id = d.doc_id "
          "GROUP BY d.doc_id)")
EVENT_ID = "sha256(sha256(text) || '|redact||2024-01-01 00:00:00|' || CAST(doc_id AS VARCHAR))"


def entries(spark, sf) -> DataFrame:
    return A.audit_entries(redacted(spark, sf), source="text", mode=RD_MODE, keys=("doc_id",),
                           threshold=R.DEFAULT_THRESHOLD, operator=HOST,
                           timestamp=FIXED_TIME)


@query("audit_list", O.found() + f", {COUNTS} SELECT {EVENT_ID} AS event_id, '2024-01-01 00:00:00' "
       "AS timestamp_utc, 'redact' AS mode, entity_type_counts, 0 AS processing_duration_ms, "
       "false AS error_flag FROM per_doc")
def audit_list(spark, sf):
    return (entries(spark, sf).select(*A.LIST_COLUMNS)
            .withColumn("timestamp_utc", F.col("timestamp_utc").cast("string"))
            .withColumn("entity_type_counts", F.to_json("entity_type_counts")))


@query("replacement_map", O.found() + f", {O.LABELLED} SELECT doc_id, chunk_ord, original, "
       "arg_min(label, s) AS replacement FROM labelled GROUP BY 1, 2, 3")
def replacement_map(spark, sf):
    rows = RD.label_rows(docs(spark, sf), "doc_id")
    return (rows.groupBy("doc_id", "chunk_ord", "original")
            .agg(F.min_by("label", "start").alias("replacement")))


# Filters -----------------------------------------------------------------------------

LEVELS = (0.3, 0.4, 0.6, 0.85)


@query("threshold_sweep", f"WITH {O.spans_ctes(O.DOCS, threshold=0.0)} SELECT threshold, "
       "entity AS entity_type, count(*) AS n FROM cand JOIN (SELECT CAST(unnest(["
       + ", ".join(map(str, LEVELS)) + "]) AS DOUBLE) AS threshold) AS t ON score >= threshold "
       "GROUP BY 1, 2")
def threshold_sweep(spark, sf):
    rows = D.raw_spans(Q.documents(spark, sf), "doc_id", threshold=0.0)
    levels = F.explode(F.array(*[F.lit(x) for x in LEVELS])).alias("threshold")
    return (rows.select("entity_type", "score", levels).filter("score >= threshold")
            .groupBy("threshold", "entity_type").agg(F.count(F.lit(1)).alias("n")))


@query("entity_subset", O.found(rules=O.rules_for("EMAIL_ADDRESS", "IP_ADDRESS"))
       + f" SELECT {O.SPAN_COLUMNS} FROM spans")
def entity_subset(spark, sf):
    wanted = R.parse_entities("email_address, IP_ADDRESS")
    return doc_spans(spark, sf, entities=wanted)


@query("audit_validate", O.found() + ", " + COUNTS + " SELECT p.doc_id, CASE WHEN d.lang = 'fr' THEN "
       "'source_hash' WHEN d.lang = 'de' AND p.entity_type_counts <> '{}' THEN "
       "'entity_type_counts' END AS invalid_field FROM per_doc AS p JOIN documents AS d "
       "USING (doc_id)")
def audit_validate(spark, sf):
    """Entries of French texts carry a name instead of a hash, German ones lower-case keys."""
    langs = Q.table(spark, sf, "documents").select("doc_id", "lang", "source")
    bad = (entries(spark, sf).join(langs, "doc_id")
           .withColumn("source_hash", F.when(F.col("lang") == "fr", F.col("source"))
                       .otherwise(F.col("source_hash")))
           .withColumn("entity_type_counts", F.expr(
               "IF(lang = 'de', transform_keys(entity_type_counts, (k, v) -> lower(k)), "
               "entity_type_counts)")))
    return bad.select("doc_id", A.invalid_field().alias("invalid_field"))


@query("audit_query", "SELECT event_id, event_type AS session_id, strftime(ts, '%Y-%m-%d %H:%M:%S') "
       "AS logged FROM events WHERE ts >= TIMESTAMP '2024-01-02' AND ts <= TIMESTAMP "
       "'2024-01-20 12:00:00' AND event_type = 'click'")
def audit_query(spark, sf):
    log = Q.table(spark, sf, "events").select(
        "event_id", F.col("ts").alias("timestamp_utc"), F.col("event_type").alias("session_id"))
    rows = A.query_log(log, datetime(2024, 1, 2), datetime(2024, 1, 20, 12), "click")
    return rows.select("event_id", "session_id",
                       F.date_format("timestamp_utc", "yyyy-MM-dd HH:mm:ss").alias("logged"))


# Detection ---------------------------------------------------------------------------

def _detector(name: str, corpus: str, entities: tuple[str, ...],
              threshold: float = R.DEFAULT_THRESHOLD) -> None:
    views = {"documents": O.DOCS, "planted": O.PLANTED, "notes": Q.portable(Q.ORDER_NOTES),
             "letters": Q.portable(Q.LETTERS), "addresses": Q.portable(Q.ADDRESSES)}
    portable = {"planted": Q.PLANTED, "notes": Q.ORDER_NOTES, "letters": Q.LETTERS,
                "addresses": Q.ADDRESSES}

    def run(spark, sf):
        df = (Q.documents(spark, sf) if corpus == "documents"
              else spread(Q.view(spark, sf, portable[corpus]), "doc_id"))
        found = D.with_hits(df.select("doc_id", "text"), entities=entities, threshold=threshold)
        return D.span_rows(found, "doc_id")

    query(name, O.found(views[corpus], rules=O.rules_for(*entities), threshold=threshold)
          + f" SELECT {O.SPAN_COLUMNS} FROM spans")(run)


_detector("det_uk_ni", "planted", ("UK_NI",))
_detector("det_uk_nhs", "planted", ("UK_NHS",))
_detector("det_uk_postcode", "planted", ("UK_POSTCODE",))
_detector("det_uk_phone", "planted", ("UK_PHONE",))
_detector("det_uk_dl", "planted", ("UK_DRIVING_LICENCE",))
_detector("det_uk_iban", "planted", ("UK_IBAN",))
_detector("det_email", "documents", ("EMAIL_ADDRESS",))
_detector("det_phone", "documents", ("PHONE_NUMBER",), LOW)
_detector("det_card", "documents", ("CREDIT_CARD",))
_detector("det_iban", "planted", ("IBAN_CODE",))
_detector("det_ip", "documents", ("IP_ADDRESS",))
_detector("det_ipv6", "addresses", ("IP_ADDRESS",))
_detector("scan_ipv6", "addresses", R.ENTITIES)
_detector("det_date", "notes", ("DATE_TIME",))
_detector("det_nrp", "letters", ("NRP",))
_detector("detect_all", "documents", R.ENTITIES, 0.3)
_detector("detect_planted", "planted", R.ENTITIES)


def _with_gazetteer(df: DataFrame, entity: str, names: DataFrame) -> DataFrame:
    """Rule spans of an entity merged with the occurrences of a table of names."""
    lines, keys = D.line_table(df, "doc_id"), ["doc_id", "chunk_ord"]
    extra = Z.gazetteer_spans(lines, keys, "text", Z.Gazetteer(entity, names, "name"))
    return D.resolved_rows(
        D.raw_chunk_spans(lines, *keys, entities=[entity]).unionByName(extra), keys)


def _gazetteer_sql(view: str, entity: str, token: str, names: str) -> str:
    """Tokens of one shape whose text is a name, next to the rules of the entity."""
    shape = R.Rule("gazetteer", entity, token, 0.85, ignore_case=False)
    rules = O.rules_for(entity) + (shape,)
    return (O.found(view, rules=rules, extra=f" AND (rule <> 'gazetteer' OR lower(substr(text, "
                    f"s + 1, e - s)) IN (SELECT lower(name) FROM ({names}) AS g))")
            + f" SELECT {O.SPAN_COLUMNS} FROM spans")


@query("det_person", _gazetteer_sql(O.PLANTED, "PERSON", r"\bCustomer#\d+\b",
                                    "SELECT c_name AS name FROM customer"))
def det_person(spark, sf):
    names = Q.table(spark, sf, "customer").select(F.col("c_name").alias("name"))
    return _with_gazetteer(planted(spark, sf), "PERSON", names)


PLACES = "SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region"
LETTERS = Q.portable(Q.LETTERS)


@query("det_location", _gazetteer_sql(LETTERS, "LOCATION", r"\b(?:NATION_\d+|[A-Z]+ [A-Z]+|[A-Z]+)\b",
                                      PLACES))
def det_location(spark, sf):
    names = (Q.table(spark, sf, "nation").select(F.col("n_name").alias("name"))
             .union(Q.table(spark, sf, "region").select("r_name")))
    return _with_gazetteer(spread(Q.view(spark, sf, Q.LETTERS), "doc_id"), "LOCATION", names)


@query("det_org", _gazetteer_sql(LETTERS, "ORGANIZATION", r"\bCustomer#\d+\b",
                                 "SELECT c_name AS name FROM customer"))
def det_org(spark, sf):
    names = Q.table(spark, sf, "customer").select(F.col("c_name").alias("name"))
    return _with_gazetteer(spread(Q.view(spark, sf, Q.LETTERS), "doc_id"), "ORGANIZATION", names)


PLACE = R.Rule("gazetteer", "LOCATION", r"\b(?:NATION_\d+|[A-Z]+ [A-Z]+|[A-Z]+)\b", 0.85,
               ignore_case=False)


@query("scrub_gazetteer", O.redacted(
    LETTERS, rules=O.ALL_RULES + (PLACE,), extra=" AND (rule <> 'gazetteer' OR lower(substr(text, "
    f"s + 1, e - s)) IN (SELECT lower(name) FROM ({PLACES}) AS g))") + " "
    + O.WHOLE.format("scrubbed_text"))
def scrub_gazetteer(spark, sf):
    """All rules and a table of places together, through the public entry point."""
    names = (Q.table(spark, sf, "nation").select(F.col("n_name").alias("name"))
             .union(Q.table(spark, sf, "region").select("r_name")))
    letters = Q.view(spark, sf, Q.LETTERS)
    return scrub(letters, "doc_id", rules=O.ALL_RULES,
                 gazetteers=[Z.Gazetteer("LOCATION", names, "name")]).texts.select(
        "doc_id", "scrubbed_text")


# Scoring -----------------------------------------------------------------------------

NUMBERS = ("SELECT c_custkey, lpad(CAST((c_custkey * 7919 + 943476591) % 10000000000 AS string), 10, "
           "'0') AS n10, 'GB' || lpad(CAST(c_custkey % 97 + 2 AS string), 2, '0') || 'NWBK' || "
           "lpad(CAST((c_custkey * 104729 + 60161331926819) % 100000000000000 AS string), 14, '0') "
           "AS iban FROM {customer}")


@query("val_nhs", f"SELECT c_custkey, n10, {O.digits_valid_nhs('n10')} AS valid FROM "
       f"({Q.portable(NUMBERS)}) AS n")
def val_nhs(spark, sf):
    return Q.view(spark, sf, NUMBERS).select("c_custkey", "n10",
                                             F.expr(C.nhs_valid("n10")).alias("valid"))


@query("val_iban", f"SELECT c_custkey, iban, {O.valid_iban('iban')} AS valid FROM "
       f"({Q.portable(NUMBERS)}) AS n")
def val_iban(spark, sf):
    return Q.view(spark, sf, NUMBERS).select("c_custkey", "iban",
                                             F.expr(C.iban_valid("iban", 22)).alias("valid"))


RAW = "doc_id, chunk_ord, entity AS entity_type, s AS start, e AS \"end\", score, rule"
RAW_COLUMNS = ("doc_id", "chunk_ord", "entity_type", "start", "end", "score", "rule")


@query("score_nhs", f"WITH {O.spans_ctes(O.PLANTED, rules=O.rules_for('UK_NHS'), threshold=0.0)} "
       f"SELECT {RAW} FROM cand")
def score_nhs(spark, sf):
    return D.raw_spans(planted(spark, sf), "doc_id", entities=["UK_NHS"],
                       threshold=0.0).select(*RAW_COLUMNS)


@query("context_boost", f"WITH {O.spans_ctes(O.PLANTED, rules=R.UK_RULES, threshold=0.0)} "
       "SELECT doc_id, chunk_ord, rule, s AS start, base, score, score > base AS boosted FROM cand")
def context_boost(spark, sf):
    """Every UK rule with and without its context words."""
    df = planted(spark, sf)
    plain = tuple(dataclasses.replace(r, context=()) for r in R.UK_RULES)
    lines = D.line_table(df, "doc_id")
    both = lines.select("doc_id", "chunk_ord",
                        F.expr(S.candidate_spans("text", plain, 0.0)).alias("base"),
                        F.expr(S.candidate_spans("text", R.UK_RULES, 0.0)).alias("final"))
    pairs = ("inline(zip_with(base, final, (b, f) -> named_struct('rule', b.rule, 'start', b.start, "
             "'base', b.score, 'score', f.score, 'boosted', f.score > b.score)))")
    return both.select("doc_id", "chunk_ord", F.expr(pairs))


def _per_line(df: DataFrame, expression: str) -> DataFrame:
    """Span rows of an expression over the raw spans of each line."""
    lines = D.line_table(df, "doc_id")
    raw = lines.withColumn("raw", F.expr(S.candidate_spans("text", O.ALL_RULES, 0.3)))
    found = raw.withColumn("spans", F.expr(expression))
    return D.chunk_span_rows(found, "doc_id", "chunk_ord").select(*RAW_COLUMNS)


@query("dedupe_spans", f"WITH {O.spans_ctes(O.PLANTED, threshold=0.3)} SELECT {RAW} FROM best")
def dedupe_spans(spark, sf):
    return _per_line(planted(spark, sf), S.dedupe("raw"))


@query("resolve_overlaps", f"WITH {O.spans_ctes(O.PLANTED, threshold=0.3)} SELECT {RAW} FROM spans")
def resolve_overlaps(spark, sf):
    return _per_line(planted(spark, sf), S.resolve("raw"))


@query("overlap_pairs", f"WITH {O.spans_ctes(O.PLANTED, threshold=0.3)} SELECT a.doc_id, a.chunk_ord, "
       "a.s AS start, a.rule, CAST(count(b.rule) AS INTEGER) AS overlaps FROM cand AS a "
       "LEFT JOIN cand AS b ON b.doc_id = a.doc_id AND b.chunk_ord = a.chunk_ord AND b.s < a.e "
       "AND a.s < b.e AND b.entity <> a.entity GROUP BY ALL")
def overlap_pairs(spark, sf):
    """Per span, how many spans of other entities it overlaps; no pairs are emitted."""
    lines = D.line_table(planted(spark, sf), "doc_id")
    raw = lines.select("doc_id", "chunk_ord",
                       F.expr(S.candidate_spans("text", O.ALL_RULES, 0.3)).alias("raw"))
    counted = ("inline(transform(raw, a -> named_struct('start', a.start, 'rule', a.rule, 'overlaps', "
               "size(filter(raw, b -> b.start < a.end AND a.start < b.end "
               "AND b.entity != a.entity)))))")
    return raw.select("doc_id", "chunk_ord", F.expr(counted))


# Joins and mapping -------------------------------------------------------------------

@query("scrub_left_join", O.redacted() + " SELECT d.doc_id, d.chunk_ord, d.new AS scrubbed_text, "
       "CAST(count(s.s) AS INTEGER) AS n_spans FROM done AS d LEFT JOIN spans AS s USING (doc_id, "
       "chunk_ord) WHERE regexp_matches(d.new, '\\S') GROUP BY 1, 2, 3")
def scrub_left_join(spark, sf):
    """All chunks; those without a hit pass unchanged."""
    lines = CH.line_chunks(Q.documents(spark, sf), "doc_id")
    done = RD.redact_chunks(lines, "doc_id", "chunk_ord")
    return done.select("doc_id", "chunk_ord", "scrubbed_text", F.size("spans").alias("n_spans"))


def batch_mapping(spark, sf, session: str = SESSION, entities=None, **kw) -> DataFrame:
    return M.build_mapping(mixed_spans(spark, sf, entities=entities), session, KEY, **kw)


def _mapped(session: str = SESSION, rules=O.ALL_RULES) -> str:
    return "WITH " + O.mapped(session, source=MIXED, rules=rules, threshold=LOW)


EMAIL_RULES = O.rules_for("EMAIL_ADDRESS")


@query("map_first", _mapped() + " SELECT original_hash, entity AS entity_type, n AS occurrences, "
       "CAST(first_doc AS VARCHAR) AS first_doc FROM mapping")
def map_first(spark, sf):
    return M.originals(mixed_spans(spark, sf)).select(
        "original_hash", "entity_type", "occurrences", "first_doc")


@query("map_lookup", _mapped(rules=EMAIL_RULES)
       + ", other AS (SELECT DISTINCT sha256(original) AS original_hash FROM ("
       + O.found(MIXED, threshold=LOW) + " SELECT * FROM spans) AS z) "
       "SELECT original_hash, fake_value FROM other LEFT JOIN mapping USING (original_hash)")
def map_lookup(spark, sf):
    """All values against a session that holds only the mail addresses."""
    hashes = (mixed_spans(spark, sf)
              .select(F.expr(C.hex_hash("original")).alias("original_hash")).distinct())
    mapping = batch_mapping(spark, sf, entities=("EMAIL_ADDRESS",))
    return M.lookup(hashes, mapping, SESSION)


@query("map_upsert", "WITH old AS (SELECT * FROM (" + _mapped(SESSION + "old", EMAIL_RULES)
       + " SELECT * FROM mapping) AS a), fresh AS (SELECT * FROM (" + _mapped()
       + " SELECT * FROM mapping) AS b) SELECT original_hash, entity AS entity_type, fake_value FROM "
       "old UNION ALL SELECT original_hash, entity, fake_value FROM fresh WHERE original_hash NOT IN "
       "(SELECT original_hash FROM old)")
def map_upsert(spark, sf):
    """The first write wins: mail addresses keep the fakes of the earlier mapping."""
    old = batch_mapping(spark, sf, entities=("EMAIL_ADDRESS",), salt="old")
    return M.insert_if_absent(old, batch_mapping(spark, sf)).select(
        "original_hash", "entity_type", "fake_value")


def _lang_sessions(spark, sf) -> DataFrame:
    return mixed_spans(spark, sf).select(
        F.col("lang").alias("session_id"), "entity_type",
        F.expr(C.hex_hash("original")).alias("original_hash")).distinct()


LANG_SESSIONS = (O.found(MIXED, threshold=LOW) + ", ls AS (SELECT DISTINCT lang AS "
                 "session_id, entity AS entity_type, sha256(original) AS original_hash FROM spans "
                 f"JOIN (SELECT doc_id, lang FROM ({MIXED}) AS m) AS l USING (doc_id))")


@query("map_sessions", LANG_SESSIONS + " SELECT DISTINCT session_id FROM ls")
def map_sessions(spark, sf):
    return M.sessions(_lang_sessions(spark, sf))


@query("map_purge", LANG_SESSIONS + " SELECT * FROM ls WHERE session_id <> 'fr'")
def map_purge(spark, sf):
    return M.purge(_lang_sessions(spark, sf), "fr")


@query("map_decrypt", _mapped() + " SELECT fake_value, original AS real_value FROM mapping")
def map_decrypt(spark, sf):
    return M.replacements(batch_mapping(spark, sf), SESSION, KEY)


@query("hash_values", "SELECT c_custkey, sha256(c_name) AS original_hash FROM customer")
def hash_values(spark, sf):
    return Q.table(spark, sf, "customer").select(
        "c_custkey", F.expr(C.hex_hash("c_name")).alias("original_hash"))


@query("hash_docs", "SELECT doc_id, sha256(text) AS source_hash FROM documents")
def hash_docs(spark, sf):
    return Q.table(spark, sf, "documents").select(
        "doc_id", F.expr(C.hex_hash("text")).alias("source_hash"))


@query("crypto_roundtrip", "SELECT c_custkey, c_name AS plain, CAST(12 + length(c_name) + 16 AS "
       "INTEGER) AS blob_bytes, true AS wrong_key_is_null FROM customer")
def crypto_roundtrip(spark, sf):
    M.hide_keys(spark)
    other = M.derive_key("another", b"\x01" * 32, iterations=1_000)
    blobs = Q.table(spark, sf, "customer").select(
        "c_custkey", F.expr(M.encrypt("c_name", KEY)).alias("blob"))
    return blobs.select("c_custkey", F.expr(M.decrypt("blob", KEY)).alias("plain"),
                        F.length("blob").alias("blob_bytes"),
                        F.expr(M.decrypt("blob", other)).isNull().alias("wrong_key_is_null"))


WITH_FAKES = (", labelled AS (SELECT s.*, m.fake_value AS label FROM spans AS s JOIN mapping AS m ON "
              "m.original_hash = sha256(s.original))")


@query("pseudo_consistent", _mapped() + WITH_FAKES + ", " + O.spliced() + " "
       + O.WHOLE.format("scrubbed_text"))
def pseudo_consistent(spark, sf):
    return pseudonymised(mixed(spark, sf), "doc_id")[0].select("doc_id", "scrubbed_text")


@query("pseudo_cross_doc", _mapped() + WITH_FAKES + " SELECT label AS fake_value, count(DISTINCT "
       "doc_id) AS docs, count(*) AS occurrences, count(DISTINCT original) AS originals FROM labelled "
       "GROUP BY 1")
def pseudo_cross_doc(spark, sf):
    """One session over all documents: each fake stands for one original everywhere."""
    spans = mixed_spans(spark, sf)
    mapping = M.build_mapping(spans, SESSION, KEY)
    return (P.mapped_spans(spans, mapping).groupBy("fake_value")
            .agg(F.countDistinct("doc_id").alias("docs"),
                 F.count(F.lit(1)).alias("occurrences"),
                 F.countDistinct("original").alias("originals")))


@query("restore", "SELECT doc_id AS n, CASE WHEN doc_id % 7 <> 0 THEN text END AS restored_text "
       f"FROM ({MIXED}) AS m")
def restore(spark, sf):
    """Null texts, null and repeated ids: every row gets its own values back."""
    texts, mapping = pseudonymised(null_docs(spark, sf), "n")
    pairs = M.replacements(mapping, SESSION, KEY, OCCURRENCES)
    return P.restore_documents(texts.select("n", "doc", "scrubbed_text"), "doc", "scrubbed_text", pairs).select(
        "n", "restored_text")


# Aggregates and windows --------------------------------------------------------------

@query("count_by_type", O.found(threshold=LOW) + " SELECT doc_id, entity AS entity_type, count(*) AS n "
       "FROM spans GROUP BY 1, 2")
def count_by_type(spark, sf):
    return U.count_by_type(doc_spans(spark, sf, threshold=LOW), "doc_id")


@query("counts_map", O.found() + f", {COUNTS} SELECT doc_id, entity_type_counts AS counts FROM per_doc")
def counts_map(spark, sf):
    return docs(spark, sf).select("doc_id", F.to_json(A.count_map()).alias("counts"))


@query("batch_totals", O.found(threshold=LOW) + " SELECT entity AS entity_type, count(*) AS n "
       "FROM spans GROUP BY 1")
def batch_totals(spark, sf):
    return U.batch_totals(doc_spans(spark, sf, threshold=LOW))


@query("batch_status", f"SELECT CAST(count(*) FILTER (WHERE {EXT} IN ({SUPPORTED_SQL})) AS BIGINT) AS "
       f"succeeded, CAST(count(*) FILTER (WHERE {EXT} NOT IN ({SUPPORTED_SQL})) AS BIGINT) AS failed "
       f"FROM ({LISTING}) AS l")
def batch_status(spark, sf):
    """Files of an unknown format are logged as failed entries, the others as done."""
    listed = FI.format_errors(Q.view(spark, sf, Q.LISTING)).select("doc_id", F.when(
        F.col("error").isNotNull(), F.lit("UnsupportedFormat")).alias("error"))
    done = redacted(spark, sf).join(listed, "doc_id")
    return U.batch_status(A.audit_entries(done, source="text", mode=RD_MODE, error="error",
                                          threshold=R.DEFAULT_THRESHOLD))


@query("detection_summary", O.found(threshold=LOW) + " SELECT entity AS entity_type, count(*) AS "
       "\"count\", arg_min(CASE WHEN length(original) > 3 THEN substr(original, 1, 3) || '***' ELSE "
       "'***' END, (doc_id, chunk_ord, s)) AS example FROM spans GROUP BY 1")
def detection_summary(spark, sf):
    return U.detection_summary(doc_spans(spark, sf, threshold=LOW), "doc_id")


@query("scrub_summary", O.found(O.PLANTED) + " SELECT entity AS entity_type, count(*) AS \"count\", "
       "'Redacted' AS action FROM spans GROUP BY 1")
def scrub_summary(spark, sf):
    found = D.with_hits(planted(spark, sf))
    return U.scrub_summary(D.span_rows(found, "doc_id"), RD_MODE)


@query("extract_stats", "SELECT doc_id, count(*) AS chunks, CAST(sum(length(text)) AS BIGINT) AS chars "
       f"FROM ({O.lines_of(O.DOCS)}) AS l WHERE regexp_matches(text, '\\S') GROUP BY 1")
def extract_stats(spark, sf):
    """Chunk and character counts; each document lies in one row, so no shuffle is needed."""
    kept = (f"filter(transform({L.chunks_of('text')}, c -> c.text), l -> {X.not_blank('l')})")
    lines = Q.documents(spark, sf).select("doc_id", F.expr(kept).alias("lines"))
    return (lines.select("doc_id", F.size("lines").cast("bigint").alias("chunks"), F.expr(
        "aggregate(lines, 0L, (a, l) -> a + length(l))").alias("chars")).filter("chunks > 0"))


@query("redact_labels", O.found(O.PLANTED) + f", {O.LABELLED} SELECT doc_id, chunk_ord, s AS start, "
       "e AS \"end\", entity AS entity_type, label FROM labelled")
def redact_labels(spark, sf):
    return RD.label_rows(D.with_hits(planted(spark, sf)), "doc_id").drop("original")


@query("redact_text", O.redacted(O.PLANTED) + " " + O.WHOLE.format("scrubbed_text"))
def redact_text(spark, sf):
    return RD.redact_documents(D.with_hits(planted(spark, sf))).select("doc_id", "scrubbed_text")


@query("redact_documents", O.redacted(threshold=LOW) + " " + O.WHOLE.format("scrubbed_text"))
def redact_documents(spark, sf):
    return redacted(spark, sf, threshold=LOW).select("doc_id", "scrubbed_text")


@query("transition_flag", "SELECT conv_id, turn, coalesce(role <> lag(role) OVER (PARTITION BY conv_id "
       "ORDER BY turn), false) AS changed FROM conversations")
def transition_flag(spark, sf):
    return CH.transitions(Q.table(spark, sf, "conversations"), "conv_id", "turn", "role").select(
        "conv_id", "turn", "changed")


NULL_TURNS = """SELECT CASE WHEN conv_id % 5 = 0 THEN NULL ELSE conv_id END AS conv, conv_id * 1000 + turn AS place,
  CASE WHEN turn % 4 = 3 THEN NULL ELSE role END AS role FROM {conversations}"""


@query("transition_nulls", "SELECT place, coalesce(role <> lag(role) OVER (PARTITION BY conv ORDER BY place), "
       f"false) AS changed FROM ({Q.portable(NULL_TURNS)}) AS t")
def transition_nulls(spark, sf):
    """Null documents are one document and keep all their rows."""
    turns = Q.view(spark, sf, NULL_TURNS)
    return CH.transitions(turns, "conv", "place", "role").select("place", "changed")


# Fakes -------------------------------------------------------------------------------

def _generator(name: str, *entities: str) -> None:
    def run(spark, sf):
        hashed = Q.table(spark, sf, "customer").select(
            "c_custkey", F.expr(C.hex_hash("c_name")).alias("h"))
        return hashed.select("c_custkey", *[
            F.expr(K.fake_value(lit(e), "h")).alias(e.lower()) for e in entities])

    query(name, O.gen(*entities))(run)


_generator("gen_names", "PERSON", "ORGANIZATION", "LOCATION")
_generator("gen_email", "EMAIL_ADDRESS")
_generator("gen_phone", "PHONE_NUMBER", "UK_PHONE")
_generator("gen_postcode", "UK_POSTCODE")
_generator("gen_date", "DATE_TIME")
_generator("gen_iban", "IBAN_CODE", "UK_IBAN")
_generator("gen_card", "CREDIT_CARD")
_generator("gen_ip", "IP_ADDRESS")
_generator("gen_nrp", "NRP")
_generator("gen_ni", "UK_NI")
_generator("gen_nhs", "UK_NHS")
_generator("gen_dl", "UK_DRIVING_LICENCE")
_generator("gen_unknown", "STAFF_ID")


# Audit and guards --------------------------------------------------------------------

@query("audit_entries", O.redacted() + f", {COUNTS}, whole AS ({O.WHOLE.format('t')}) SELECT "
       "p.doc_id, sha256(text) AS source_hash, sha256(t) AS output_hash, 'redact' AS mode, '0.6' AS "
       "threshold, entity_type_counts AS counts, false AS error_flag, '' AS error_message "
       "FROM per_doc AS p JOIN whole AS w USING (doc_id)")
def audit_entries(spark, sf):
    return entries(spark, sf).select(
        "doc_id", "source_hash", "output_hash", "mode", "threshold",
        F.to_json("entity_type_counts").alias("counts"), "error_flag", "error_message")


@query("audit_export", O.redacted() + f", {COUNTS}, whole AS ({O.WHOLE.format('t')}) SELECT "
       f"{EVENT_ID} AS event_id, '2024-01-01 00:00:00' AS timestamp_utc, sha256(text) AS source_hash, "
       "sha256(t) AS output_hash, sha256('host') AS operator_hash, '0.1.0' AS engine_version, "
       "'rules' AS detector, '0.6' AS threshold, 'redact' AS mode, entity_type_counts, 0 AS "
       "processing_duration_ms, false AS error_flag, '' AS error_message, CAST(NULL AS VARCHAR) AS "
       "session_id FROM per_doc AS p JOIN whole AS w USING (doc_id)")
def audit_export(spark, sf):
    return A.export_frame(entries(spark, sf)).withColumn(
        "timestamp_utc", F.col("timestamp_utc").cast("string"))


GUARD_CASES = " ".join(f"WHEN regexp_matches(text, {O.q(rx.replace('(?U)', ''))}) THEN {O.q(name)}"
                       for name, rx in G.GUARD_PATTERNS.items())


@query("leak_guard", f"SELECT * FROM (SELECT doc_id, 'text' AS column_name, CASE WHEN length(text) <= "
       f"200 THEN NULL {GUARD_CASES} END AS pattern FROM documents) AS g WHERE pattern IS NOT NULL")
def leak_guard(spark, sf):
    return G.leaks(Q.documents(spark, sf), "doc_id")


@query("residual_pii", O.redacted(MIXED, threshold=LOW) + ", known AS (SELECT DISTINCT "
       "original FROM spans), stages AS (SELECT 'before' AS stage, doc_id, chunk_ord, text AS t FROM "
       "lines UNION ALL SELECT 'after', doc_id, chunk_ord, new FROM done) SELECT stage, original, "
       "count(DISTINCT (doc_id, chunk_ord)) AS chunks FROM stages JOIN known ON contains(t, original) "
       "GROUP BY 1, 2")
def residual_pii(spark, sf):
    """Known values in the input and in the output, which keeps only what no rule sees there."""
    found = P.detect_once(mixed(spark, sf).select("doc_id", "text"), "text", KEY, None, threshold=LOW)
    known = found.span_rows("doc_id").groupBy("original").agg(F.count(F.lit(1)).alias(OCCURRENCES))
    out = found.redacted()
    stages = out.select("doc_id", F.expr("inline(array(named_struct('stage', 'before', 't', text), "
                                         "named_struct('stage', 'after', 't', scrubbed_text)))"))
    chunks = stages.select("doc_id", "stage", F.expr(f"inline({L.chunks_of('t')})"))
    keys = ["stage", "doc_id", "ord"]
    return (G.residual_values(chunks, keys, "text", known, "original")
            .groupBy("stage", "original").agg(F.count(F.lit(1)).alias("chunks")))


@query("residual_detect", "WITH " + O.spans_ctes("", chunks="SELECT doc_id, chunk_ord, new AS text FROM ("
       + O.redacted() + " SELECT * FROM done) AS r") + " SELECT d.doc_id, count(s.s) AS n_left FROM "
       "documents AS d LEFT JOIN spans AS s USING (doc_id) GROUP BY 1")
def residual_detect(spark, sf):
    """All rules once more on the redacted texts: how much they still find in each."""
    again = D.with_hits(redacted(spark, sf).select("doc_id", "scrubbed_text"), "scrubbed_text")
    return again.select("doc_id", F.expr(
        "aggregate(hits, 0L, (a, h) -> a + size(h.spans))").alias("n_left"))


@query("audit_pseudonymised", _mapped() + ", counted AS (SELECT doc_id, entity, count(*) AS n FROM spans "
       "GROUP BY 1, 2), per AS (SELECT doc_id, sum(n) AS n, count(*) AS kinds FROM counted GROUP BY 1)"
       + WITH_FAKES + ", " + O.spliced() + ", whole AS (" + O.WHOLE.format("t") + ") SELECT w.doc_id, "
       "sha256(d.text) AS source_hash, sha256(t) AS output_hash, 'pseudonymise' AS mode, "
       "CAST(coalesce(n, 0) AS BIGINT) AS found, CAST(coalesce(kinds, 0) AS INTEGER) AS kinds FROM whole "
       f"AS w JOIN ({MIXED}) AS d USING (doc_id) LEFT JOIN per USING (doc_id)")
def audit_pseudonymised(spark, sf):
    """Audit rows with counts of pseudonymised documents."""
    done, _ = pseudonymised(mixed(spark, sf), "doc_id")
    rows = A.audit_entries(done, source="text", mode="pseudonymise", threshold=LOW, keys=("doc_id",),
                           session_id=SESSION, counts=F.col("entity_counts"))
    return rows.select("doc_id", "source_hash", "output_hash", "mode", F.expr(
        "aggregate(map_values(entity_type_counts), 0L, (a, n) -> a + n)").alias("found"),
        F.size("entity_type_counts").alias("kinds"))


# Files -------------------------------------------------------------------------------

FILE_CELLS = " UNION ALL ".join(
    f"SELECT variant AS doc_id, CAST(doc_id * 2 + {i} AS BIGINT) AS chunk_ord, {c} AS text FROM ({O.PLANTED}) AS f{i}"
    for i, c in enumerate(("CAST(doc_id AS VARCHAR)", "text")))


def _csv_folder(spark, sf) -> str:
    """Planted texts as CSV files, one per variant, whose cells hold line breaks."""
    base = _run_dir(spark, "csv_folder")
    rows = Q.view(spark, sf, Q.PLANTED).repartition("variant").sortWithinPartitions("variant", "doc_id")
    rows.write.partitionBy("variant").option("header", True).option("escape", '"').csv(f"{base}/in")
    return f"{base}/in"


def _csv_rows(contents: DataFrame) -> DataFrame:
    """``variant, row_id, doc_id, text`` of CSV files ``(path, content)``."""
    def run(batches):
        for pdf in batches:
            rows = ((int(path.split("variant=")[1][0]), n, *row) for path, content in zip(pdf["path"], pdf["content"])
                    for n, row in enumerate(islice(CSV.rows_of(content), 1, None)))
            while some := list(islice(rows, 10_000)):
                yield pd.DataFrame(some, columns=["variant", "row_id", "doc_id", "text"])

    return contents.select("path", "content").mapInPandas(run, "variant int, row_id int, doc_id string, text string")


@query("batch_folder", O.redacted("", chunks=FILE_CELLS) + " SELECT CAST(doc_id AS INTEGER) AS variant, CAST("
       "dense_rank() OVER (PARTITION BY doc_id ORDER BY chunk_ord // 2) - 1 AS INTEGER) AS row_id, max(new) FILTER ("
       "WHERE chunk_ord % 2 = 0) AS doc_id, max(new) FILTER (WHERE chunk_ord % 2 = 1) AS text FROM done "
       "GROUP BY done.doc_id, chunk_ord // 2")
def batch_folder(spark, sf):
    """A folder job over CSV files; each file has its own numbering."""
    return _csv_rows(B.scrub_folder(spark, _csv_folder(spark, sf)).outputs)


@query("batch_restore", "SELECT CAST(variant AS INTEGER) AS variant, CAST(row_number() OVER (PARTITION BY variant "
       f"ORDER BY doc_id) - 1 AS INTEGER) AS row_id, CAST(doc_id AS VARCHAR) AS doc_id, text FROM ({O.PLANTED}) AS p")
def batch_restore(spark, sf):
    """The same files pseudonymised and restored."""
    done = B.scrub_folder(spark, _csv_folder(spark, sf), mode="pseudonymise", key=KEY, session_id=SESSION)
    pairs = M.replacements(done.mapping, SESSION, KEY, OCCURRENCES)
    return _csv_rows(B.restore_contents(materialise(done.outputs), pairs))


# Streaming ---------------------------------------------------------------------------

def _run_dir(spark: SparkSession, name: str) -> str:
    root = shared_dir(spark)
    if "://" in root:
        return f"{root.rstrip('/')}/{name}-{uuid.uuid4()}"
    os.makedirs(root, exist_ok=True)
    return tempfile.mkdtemp(prefix=f"{name}-", dir=root)


@query("stream_scrub", O.redacted() + " " + O.WHOLE.format("scrubbed_text"))
def stream_scrub(spark, sf):
    base = _run_dir(spark, "stream_scrub")
    source = J.read_stream(spark, sf, Q.table(spark, sf, "documents").schema, table="documents.parquet")
    J.scrub_stream(source, "doc_id", "text", f"{base}/out", f"{base}/state",
                   partitions=spark.sparkContext.defaultParallelism).awaitTermination()
    return spark.read.parquet(f"{base}/out")


@query("stream_counts", "SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, event_type, n FROM "
       "(SELECT time_bucket(INTERVAL '1 hour', ts) AS w, event_type, count(*) AS n FROM events "
       "GROUP BY 1, 2) AS c WHERE w + INTERVAL '1 hour' <= (SELECT max(ts) - INTERVAL '1 hour' FROM "
       "events)")
def stream_counts(spark, sf):
    base = _run_dir(spark, "stream_counts")
    events = J.read_stream(spark, sf, Q.table(spark, sf, "events").schema, table="events.parquet")
    J.counts_stream(events, "ts", "event_type", f"{base}/out", f"{base}/state").awaitTermination()
    return spark.read.parquet(f"{base}/out").withColumn(
        "window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))


EVENT_TEXT = ("props || CASE event_type WHEN 'error' THEN '' WHEN 'click' THEN ' by u' || cast(user_id AS string) || "
              "'@example.com' ELSE ' from 10.0.0.' || cast(user_id % 250 AS string) || ' by u' || "
              "cast(user_id AS string) || '@example.com or u@example.com' END")


@query("stream_detections", O.found("", chunks=f"SELECT event_id AS doc_id, 0 AS chunk_ord, {EVENT_TEXT} AS text "
       "FROM events") + " SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, entity_type, n FROM (SELECT "
       "time_bucket(INTERVAL '1 hour', ts) AS w, entity AS entity_type, CAST(count(*) AS BIGINT) AS n FROM spans "
       "JOIN events ON event_id = doc_id GROUP BY 1, 2) AS c WHERE w + INTERVAL '1 hour' <= (SELECT max(ts) - "
       "INTERVAL '1 hour' FROM events)")
def stream_detections(spark, sf):
    """Detections per hour and entity over a stream in which every tenth event comes twice."""
    base = _run_dir(spark, "stream_detections")
    schema = Q.table(spark, sf, "events").schema

    def events():
        return J.read_stream(spark, sf, schema, table="events.parquet").withColumn("text", F.expr(EVENT_TEXT))

    twice = events().unionByName(events().filter("event_id % 10 = 0"))
    J.detections_stream(twice, "event_id", "ts", "text", f"{base}/out", f"{base}/state").awaitTermination()
    return spark.read.parquet(f"{base}/out").withColumn(
        "window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))
