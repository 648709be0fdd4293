"""Gazetteer, audit, guards, sources, mail, batch and streaming."""

import email
import email.policy
import os
from datetime import datetime
from email.message import EmailMessage

import pytest
from pyspark.sql import functions as F

from veilframe.operators import audit as A
from veilframe.operators import detect as D
from veilframe.operators import gazetteer as Z
from veilframe.operators import guard as G
from veilframe.operators import redact, summary
from veilframe.plans import batch as B
from veilframe.session import join_hot_split
from veilframe.sources import chunks as CH
from veilframe.sources import email as EM
from veilframe.sources import files as FI
from veilframe.streaming import jobs as J

NAMES = ["New York", "York", "Ann Lee", "O'Neil", "Zürich", "a1@b.org"]
PLACES = ["In New  York, yorkshire; YORK.", "Ann Lee-Smith met ann lee (O'Neil)", "zürich Zürichs",
          "mail a1@b.org or xa1@b.org", "nothing", ""]


def brute_entries(text):
    """Case-insensitive occurrences that start and end at a word border; spaces folded."""
    import re
    out = set()
    for name in NAMES:
        rx = re.sub(r"\\ ", r"\\s+", re.escape(name))
        for m in re.finditer(rx, text, re.I):
            a, b = m.span()
            left = a == 0 or not (re.match(r"\w", text[a - 1]) and re.match(r"\w", text[a]))
            right = b == len(text) or not (re.match(r"\w", text[b]) and re.match(r"\w", text[b - 1]))
            if left and right:
                out.add((a, b, name))
    return out


@pytest.mark.parametrize("limit", [100_000, 0])
def test_gazetteer_against_brute_force(spark, limit, monkeypatch):
    """Broadcast and salted joins give the same, with and without first-atom pruning."""
    df = spark.createDataFrame(list(enumerate(PLACES)), "id int, text string")
    names = spark.createDataFrame([(n,) for n in NAMES], "name string")
    want = {(i, *e) for i, t in enumerate(PLACES) for e in brute_entries(t)}
    for first_limit in (2_000, 0):
        monkeypatch.setattr(Z.first_atoms, "__defaults__", (first_limit,))
        rows = Z.find_entries(df, ["id"], "text", names, "name", broadcast_rows=limit).collect()
        assert {(r.id, r.start, r.end, r["name"]) for r in rows} == want


def test_entry_gates(spark):
    df = spark.createDataFrame(list(enumerate(PLACES)), "id int, text string")
    for names in (["a1@b.org"], ["Ann Lee", "York"]):
        entries = spark.createDataFrame([(n,) for n in names], "name string")
        rows = Z.find_entries(df, ["id"], "text", entries, "name", ignore_case=False).collect()
        assert {r["name"] for r in rows} == set(names)


def test_hot_split_join(spark):
    """A key with most rows, cold keys and unmatched keys."""
    left = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i % 10}") for i in range(300)],
                                 "i int, k string")
    right = spark.createDataFrame([("hot", 200, "H")] + [(f"k{j}", 10, f"v{j}") for j in range(8)],
                                  "k string, n int, v string")
    got = {(r.i, r.v) for r in join_hot_split(left, right, "k", "n").collect()}
    want = {(r.i, r.v) for r in left.join(right, "k", "left").collect()}
    assert got == want and len(got) > 200


def test_audit_log(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a@b.org"), (2, "x")], "doc_id int, text string")
    done = redact.redact_documents(D.with_hits(docs))
    entries = A.audit_entries(done, source="text", mode="redact", threshold=0.6,
                              timestamp=datetime(2024, 1, 1))
    path = str(tmp_path / "log")
    A.append_entries(entries, path)
    later = A.audit_entries(done, source="text", mode="redact", threshold=0.6, session_id="s",
                            timestamp=datetime(2024, 2, 1))
    A.append_entries(later, path)
    log = spark.read.parquet(path)
    assert log.count() == 4 and set(A.EXPORT_COLUMNS) == set(log.columns)
    assert A.query_log(log, since=datetime(2024, 1, 15)).count() == 2
    assert A.query_log(log, until=datetime(2024, 1, 1)).count() == 2
    assert A.query_log(log, session_id="s").count() == 2
    assert A.export_csv(log, str(tmp_path / "csv")) == 4
    text = "".join(open(os.path.join(tmp_path, "csv", f)).read()
                   for f in os.listdir(tmp_path / "csv") if f.endswith(".csv"))
    assert '{\\"EMAIL_ADDRESS\\":1}' in text and "a@b.org" not in text
    assert A.export_csv(log.limit(0), str(tmp_path / "none")) == 0
    assert not os.path.exists(tmp_path / "none")
    bad = entries.withColumn("source_hash", F.lit("report.pdf"))
    with pytest.raises(Exception, match="source_hash"):
        A.append_entries(bad, path)
    assert spark.read.parquet(path).count() == 4


def test_failed_document_is_logged(spark):
    docs = spark.createDataFrame([("a", None), ("b", "ValueError")], "text string, error string")
    done = redact.redact_documents(D.with_hits(docs))
    rows = A.audit_entries(done, source="text", mode="redact", threshold=0.6, error="error")
    assert summary.batch_status(rows).first().asDict() == {"succeeded": 1, "failed": 1}
    failed = rows.filter("error_flag").first()
    assert failed.output_hash.startswith("e3b0c442") and failed.error_message == "ValueError"
    assert rows.filter(A.invalid_field().isNotNull()).count() == 0


def test_guards(spark):
    pad = "x" * 200
    df = spark.createDataFrame([(1, "a@b.org", "a@b.org" + pad), (2, pad + " 943 476 5919", "y"),
                                (3, pad, pad)], "id int, event string, note string")
    assert [(r.id, r.column_name, r.pattern) for r in G.leaks(df, "id").collect()] == [
        (1, "note", "email")]
    with pytest.raises(G.LeakError):
        G.assert_no_private_columns(df.withColumn("original", F.lit("")))


def test_summary_of_nothing(spark):
    docs = spark.createDataFrame([(1, "x")], "doc_id int, text string")
    spans = D.span_rows(D.with_hits(docs), "doc_id")
    assert summary.scrub_summary(spans, "redact").collect()[0].entity_type == "no PII"


def test_transitions_over_blocks(spark):
    rows = [(1, i, "u" if i % 5 else "a") for i in range(40)] + [(2, 0, "u")]
    df = spark.createDataFrame(rows, "doc int, ord int, role string")
    got = {(r.doc, r.ord): r.changed
           for r in CH.transitions(df, "doc", "ord", "role", block=4).collect()}
    for doc, i, role in rows:
        before = next((r for d, o, r in rows if d == doc and o == i - 1), None)
        assert got[doc, i] == (before is not None and before != role)


def test_offsets_and_cells(spark):
    df = spark.createDataFrame([(1, "one\n\n  \nthrée 😀\nend")], "doc int, text string")
    rows = CH.line_chunks(df, "doc").orderBy("chunk_ord").collect()
    assert [(r.chunk_ord, r.char_offset_start, r.char_offset_end, r.text) for r in rows] == [
        (0, 0, 3, "one"), (3, 8, 15, "thrée 😀"), (4, 16, 19, "end")]
    cells = spark.createDataFrame([(1, " a ", None), (2, "", "\tb")], "id int, x string, y string")
    got = CH.cell_chunks(cells, "id", ["x", "y"]).collect()
    assert [(r.row_id, r.col, r.col_name, r.text) for r in got] == [(1, 0, "x", "a"),
                                                                    (2, 1, "y", "b")]


def message():
    m = EmailMessage()
    m["From"], m["To"] = "Ann <ann@b.org>", "bob@c.org"
    m["Subject"] = "Ref AB123456C"
    m.set_content("Call 07700 900123\nplain body é")
    m.add_alternative("<p>html a@b.org</p>", subtype="html")
    m.add_attachment(b"secret a@b.org", maintype="text", subtype="plain", filename="n.txt")
    return m.as_bytes()


def test_mail_chunks_and_rebuild(spark):
    mails = spark.createDataFrame([(1, bytearray(message()))], "id int, content binary")
    rows = EM.mail_chunks(mails, "id").orderBy("chunk_ord").collect()
    assert [r.part for r in rows] == ["from", "to", "subject", "body0", "body1"]
    assert all(r.attachment_count == 1 for r in rows)
    assert all(r.char_offset_end - r.char_offset_start == len(r.text) for r in rows)
    assert rows[4].text.startswith("<p>html a@b.org</p>")
    done = EM.scrub_mails(mails).first()
    new = email.message_from_bytes(bytes(done.scrubbed_content), policy=email.policy.default)
    body = new.get_body(("plain",)).get_content()
    assert "[UK_PHONE_1]" in body and "é" in body
    assert "[EMAIL_ADDRESS_3]" in new.get_body(("html",)).get_content()
    assert "ann@b.org" not in bytes(done.scrubbed_content).decode().split("secret")[0]
    assert new["Subject"] == "Ref [UK_NI_1]"


def test_names(spark):
    df = spark.createDataFrame([("d/a.PDF",), ("d/b.eml",), ("c.v2.txt",), ("x.html",)], "path string")
    got = [r.o for r in df.select(FI.output_name("path").alias("o")).collect()]
    assert got == ["d/a_scrubbed.docx", "d/b_scrubbed.txt", "c.v2_scrubbed.txt",
                   "x_scrubbed.html"]
    assert FI.format_errors(df).filter("error IS NOT NULL").count() == 1


def test_folder(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_bytes("Mail a@b.org\r\nend \xff".encode("latin-1"))
    (tmp_path / "sub" / "a.TXT").write_text("NI AB123456C")
    (tmp_path / "m.eml").write_bytes(message())
    (tmp_path / "x.html").write_text("<p>")
    (tmp_path / "old_scrubbed.txt").write_text("a@b.org")
    batch = B.scrub_folder(spark, str(tmp_path))
    rows = {r.path.split(str(tmp_path) + "/")[1]: r for r in batch.outputs.collect()}
    assert sorted(rows) == ["a.txt", "m.eml", "sub/a.TXT"]
    assert bytes(rows["a.txt"].content).decode() == "Mail [EMAIL_ADDRESS_1]\nend �"
    assert rows["sub/a.TXT"].output_path.endswith("sub/a_scrubbed.txt")
    assert [r.path.split("/")[-1] for r in batch.rejects.collect()] == ["x.html"]
    out, log = str(tmp_path / "out"), str(tmp_path / "log")
    B.write_outputs(batch, out, log)
    entries = spark.read.parquet(log)
    assert entries.count() == 3 and entries.filter("error_flag").count() == 0
    assert spark.read.parquet(out).count() == 3


def test_csv(spark, tmp_path):
    (tmp_path / "t.csv").write_text('name,email,ni\nAnn,a@b.org,AB123456C\n"B, b",b@b.org,\n')
    rows = B.scrub_csv(spark, str(tmp_path / "t.csv")).orderBy(FI.ROW).collect()
    assert [(r.name, r.email, r.ni) for r in rows] == [
        ("Ann", "[EMAIL_ADDRESS_1]", "[UK_NI_1]"), ("B, b", "[EMAIL_ADDRESS_2]", None)]


def test_stream_takes_only_new_files(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    schema = "doc_id int, text string"
    for k in range(2):
        spark.createDataFrame([(k, f"a{k}@b.org")], schema).write.mode("append").parquet(source)
        stream = J.read_stream(spark, source, spark.read.parquet(source).schema)
        J.scrub_stream(stream, "doc_id", "text", out, state).awaitTermination()
        assert spark.read.parquet(out).count() == k + 1
    assert {r.scrubbed_text for r in spark.read.parquet(out).collect()} == {"[EMAIL_ADDRESS_1]"}


def test_stream_drops_late_rows(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    schema = "ts timestamp, kind string"
    batches = [[(datetime(2024, 1, 1, 0, 10), "a"), (datetime(2024, 1, 1, 5), "a")],
               [(datetime(2024, 1, 1, 0, 20), "a"), (datetime(2024, 1, 1, 9), "b")]]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = J.read_stream(spark, source, spark.read.parquet(source).schema)
        J.counts_stream(stream, "ts", "kind", out, state).awaitTermination()
    got = {(r.window_start.hour, r.kind, r.n) for r in spark.read.parquet(out).collect()}
    assert got == {(0, "a", 1), (5, "a", 1)}
