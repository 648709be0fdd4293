"""No row is lost and nothing is let through: nulls, repeated keys, blank rows, odd files."""

import email
import email.policy
import re
from email.message import EmailMessage

import pytest
from pyspark.sql import functions as F

from veilframe import Gazetteer, derive_key, scrub
from veilframe.functions import rules as R
from veilframe.functions import spans as S
from veilframe.operators import guard as G
from veilframe.operators import mapping as M
from veilframe.operators import pseudonymise as P
from veilframe.plans import batch as B
from veilframe.session import shared_dir, spread
from veilframe.sources import email as EM
from veilframe.sources import files as FI
from veilframe.streaming import jobs as J

KEY = derive_key("k", b"\x02" * 32, iterations=1_000)
ROWS = [(1, 0, "mail a@b.org"), (1, 1, None), (None, 0, "mail c@d.org"), (None, 1, "nothing"),
        (None, None, "x@y.org and c@d.org"), (2, 0, ""), (2, 0, "z@z.org"), (2, 0, "q@q.org z@z.org"),
        (2, 0, "z@z.org"), (3, None, None)]
MAIL = re.compile(r"\b(?:a@b|c@d|x@y|z@z|q@q)\.org")


def run(spark, chunks, **how):
    df = spark.createDataFrame(ROWS, "doc int, ord int, text string")
    done = scrub(df, "doc", order="ord" if chunks else None, **how)
    return df, done


@pytest.mark.parametrize("chunks", [True, False])
@pytest.mark.parametrize("how", [{}, {"gazetteers": True}, {"mode": "pseudonymise", "key": KEY},
                                 {"mode": "pseudonymise", "key": KEY, "gazetteers": True}])
def test_every_row_comes_out_scrubbed(spark, chunks, how):
    how = dict(how)
    if how.pop("gazetteers", False):
        names = spark.createDataFrame([("nothing",)], "name string")
        how["gazetteers"] = [Gazetteer("PERSON", names, "name")]
    df, done = run(spark, chunks, **how)
    rows = done.texts.collect()
    for r in rows:
        assert r.entity_counts.get("EMAIL_ADDRESS", 0) == len(MAIL.findall(r.text or ""))
    assert sorted(((r.doc, r.ord, r.text) for r in rows), key=repr) == sorted(ROWS, key=repr)
    for r in rows:
        assert (r.scrubbed_text is None) == (r.text is None)
        if done.mapping is None:
            assert not MAIL.search(r.scrubbed_text or "")
        elif r.text and MAIL.search(r.text):
            assert r.scrubbed_text != r.text


def test_null_document_is_numbered_as_one(spark):
    _, done = run(spark, True)
    rows = {(r.doc, r.ord, r.text): r.scrubbed_text for r in done.texts.collect()}
    own = [rows[None, None, "x@y.org and c@d.org"], rows[None, 0, "mail c@d.org"]]
    labels = re.findall(r"EMAIL_ADDRESS_\d", " ".join(own))
    assert sorted(labels) == [f"EMAIL_ADDRESS_{i}" for i in (1, 2, 3)]


def test_unmapped_span_is_not_left_in_clear(spark):
    texts = spark.createDataFrame([(1, "mail a@b.org"), (2, "mail c@d.org")], "doc int, text string")
    rows = spark.createDataFrame([("0" * 64, "x", 1)], "original_hash string, fake_value string, occurrences long")
    done = P.pseudonymise_documents(texts, "doc", "text", rows)
    assert {r.scrubbed_text for r in done.collect()} == {"mail [EMAIL_ADDRESS_FAKE]"}


LINES = ["dead:beef::cafe is up", "at ::1 or fe80::1", "fe80::", "a::b c", "staff-ab", "STAFF-AB", "x+y", "10.0.0.1",
         "Dear Ann Lee", "DEAR ANN", "Polish", "polish", "Acme Ltd", "a@b.org", "12:30:45", "std::vector", "", None]


def test_gates_drop_no_match(spark):
    """Each rule finds the same with its gate as without."""
    own = R.Rule("staff", "STAFF_ID", r"\bstaff-[a-z]{2}\b", 0.9, gate_words=("staff-",))
    plus = R.Rule("plus", "PLUS", r"x\+y", 0.9, gate_words=("x+y",), ignore_case=False)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(LINES)], "i int, text string")
    free = {"gate": None, "gate_words": (), "needs": None}
    for rule in (*R.default_rules(), own, plus):
        bare = R.Rule(**{f: getattr(rule, f) for f in rule.__dataclass_fields__} | free)
        gated = f"IF(coalesce({S.may_match('text', [rule])}, false), {S.find_spans('text', [rule], 0.1)}, {S.NO_SPANS})"
        both = df.select("i", F.expr(gated).alias("a"), F.expr(S.find_spans("coalesce(text, '')", [bare], 0.1)).alias("b"))
        for r in both.collect():
            assert r.a == r.b, (rule.name, LINES[r.i])


def test_addresses(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(LINES)], "i int, text string")
    done = {r.i: r.scrubbed_text for r in scrub(df, "i", entities="IP_ADDRESS").texts.collect()}
    assert done[0] == "[IP_ADDRESS_1] is up" and done[1] == "at [IP_ADDRESS_2] or [IP_ADDRESS_1]"
    assert done[3] == "[IP_ADDRESS_1] c" and done[14] == "12:30:45" and done[15] == "std::vector"


def test_own_gate_words(spark):
    rule = R.Rule("staff", "STAFF_ID", r"\bstaff-[a-z]{2}\b", 0.9, gate_words=("staff-",))
    df = spark.createDataFrame([(1, "STAFF-AB"), (2, "staff-ab")], "i int, text string")
    assert {r.scrubbed_text for r in scrub(df, "i", rules=[rule]).texts.collect()} == {"[STAFF_ID_1]"}


def test_what_a_winner_does_not_cover_is_replaced_too(spark):
    rules = [R.Rule("a", "AAA", r"alpha beta", 0.7, ignore_case=False), R.Rule("b", "BBB", r"beta gamma", 0.9),
             R.Rule("c", "CCC", r"x alpha beta gamma y", 0.65)]
    df = spark.createDataFrame([(1, "so alpha beta gamma."), (2, "so x alpha beta gamma y.")], "i int, text string")
    done = {r.i: r.scrubbed_text for r in scrub(df, "i", rules=rules).texts.collect()}
    assert done == {1: "so [AAA_1][BBB_1].", 2: "so [CCC_2][AAA_1][BBB_1][CCC_1]."}


def test_table_keeps_blank_rows(spark):
    rows = [(1, "a@b.org", " "), (2, None, None), (3, "", "\t"), (4, " c@d.org ", "x"), (None, "e@f.org", None)]
    df = spark.createDataFrame(rows, "r int, a string, b string")
    got = {r.r: (r.a, r.b) for r in B.scrub_table(df, "r", ["a", "b"]).collect()}
    assert len(got) == 5 and got[2] == (None, None) and got[3] == ("", "\t") and got[4][1] == "x"
    assert all("@" not in (r[0] or "") for r in got.values()) and got[1][1] == " "


def message(body=b"NI AB123456C mail z@z.org", kind=b'text/plain; charset="x-nope"', more=b""):
    return b"From: a@b.org\nX-Mark: 1\nTo: c@d.org\nReply-To: q@q.org\nSubject: s\nContent-Type: " + kind + b"\n" + more + b"\n" + body


def test_mail_with_unknown_charset_and_inline_file(spark):
    multi = EmailMessage()
    multi["From"], multi["X-Mark"], multi["To"] = "a@b.org", "1", "c@d.org"
    multi.set_content("body a@b.org")
    multi.add_attachment("NI AB123456C", filename="attachment.txt", disposition="inline")
    multi.add_attachment("kept z@z.org", filename="f.txt", disposition="ATTACHMENT")
    df = spark.createDataFrame([(1, message()), (2, multi.as_bytes()), (3, message(b"\xff\xfe z@z.org", b"text/plain"))],
                               "i int, content binary")
    done = {r.i: r for r in EM.scrub_mails(df).collect()}
    for r in done.values():
        assert r.error is None
        text = bytes(r.scrubbed_content).decode()
        assert "AB123456C" not in text and "mail z@z.org" not in text and "q@q.org" not in text
    names = [k for k, _ in email.message_from_bytes(bytes(done[1].scrubbed_content), policy=email.policy.default).items()]
    assert names[:5] == ["From", "X-Mark", "To", "Reply-To", "Subject"]
    assert done[2].attachments == 1 and b"kept z@z.org" in bytes(done[2].scrubbed_content)


def folder_of(tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    top = tmp_path / "in"
    (top / "a.txt").write_text("one a@b.org\ntwo c@d.org\n")
    (top / "same.txt").write_text("one a@b.org\ntwo c@d.org\n")
    (top / "sub" / "t.csv").write_text('path,mail\nx, a@b.org \n,\n"q, r","z@z.org\nnext"\n')
    (top / "m.eml").write_bytes(message(b"a@b.org here"))
    (top / "h.html").write_text("<p>")
    return str(top)


def test_folder_redacted(spark, tmp_path):
    batch = B.scrub_folder(spark, folder_of(tmp_path))
    out, log = str(tmp_path / "out"), str(tmp_path / "log")
    B.write_outputs(batch, out, log)
    rows = {r.path.split("/in/")[1]: r for r in spark.read.parquet(out).collect()}
    assert sorted(rows) == ["a.txt", "m.eml", "same.txt", "sub/t.csv"]
    assert bytes(rows["sub/t.csv"].content).decode() == (
        'path,mail\nx,[EMAIL_ADDRESS_1]\n,\n"q, r","[EMAIL_ADDRESS_2]\nnext"\n')
    entries = spark.read.parquet(log)
    assert entries.count() == 4 == entries.select("event_id").distinct().count()
    assert entries.filter("error_flag").count() == 0
    assert {r.entity_type_counts["EMAIL_ADDRESS"] for r in entries.collect()} == {2, 4}
    hashes = {r.output_hash for r in entries.collect()}
    assert hashes == {r.h for r in spark.read.parquet(out).select(F.sha2("content", 256).alias("h")).collect()}
    assert [r.path.split("/")[-1] for r in batch.rejects.collect()] == ["h.html"]


@pytest.mark.parametrize("model", [False, True])
def test_folder_pseudonymised(spark, tmp_path, model):
    folder = folder_of(tmp_path)
    names = spark.createDataFrame([("here",)], "name string")
    more = {"gazetteers": [Gazetteer("PERSON", names, "name")]} if model else {}
    batch = B.scrub_folder(spark, folder, mode="pseudonymise", key=KEY, session_id="s", **more)
    rows = {r.path.split("/in/")[1]: bytes(r.content).decode() for r in batch.outputs.collect()}
    assert len(rows) == 4 and not any(MAIL.search(t) for n, t in rows.items() if n != "m.eml")
    pairs = {r.real_value: r.fake_value for r in M.replacements(batch.mapping, "s", KEY).collect()}
    assert rows["a.txt"] == rows["same.txt"] == f"one {pairs['a@b.org']}\ntwo {pairs['c@d.org']}\n"
    assert pairs["a@b.org"] in rows["sub/t.csv"] and pairs["a@b.org"] in rows["m.eml"]
    assert batch.entries.filter("mode = 'pseudonymise' AND session_id = 's'").count() == 4
    assert ("here" in pairs) == model


def test_csv_columns_are_not_overwritten(spark, tmp_path):
    (tmp_path / "t.csv").write_text("path,row_id\na@b.org,7\n,\n")
    rows = B.scrub_csv(spark, str(tmp_path / "t.csv")).orderBy(FI.ROW).collect()
    assert [(r.path, r.row_id) for r in rows] == [("[EMAIL_ADDRESS_1]", "7"), (None, None)]


@pytest.mark.parametrize("mode", ["redact", "pseudonymise"])
def test_stream_with_audit(spark, tmp_path, mode):
    source, out, log, store, state = (str(tmp_path / n) for n in ("in", "out", "log", "store", "state"))
    how = {} if mode == "redact" else {"mode": mode, "key": KEY, "session_id": "s", "store": store}
    for k in range(2):
        rows = [(k, f"a@b.org and c{k}@d.org"), (10 + k, "nothing"), (20 + k, None)]
        spark.createDataFrame(rows, "doc int, text string").coalesce(1).write.mode("append").parquet(source)
        stream = J.read_stream(spark, source, spark.read.parquet(source).schema)
        J.scrub_batches(stream, "doc", "text", out, log, state, **how).awaitTermination()
    texts = {r.doc: r.scrubbed_text for r in spark.read.parquet(out).collect()}
    assert len(texts) == 6 and texts[20] is None and "@b.org" not in (texts[0] if mode == "redact" else "")
    assert texts[0].split(" and ")[0] == texts[1].split(" and ")[0] != "a@b.org"
    entries = spark.read.parquet(log).collect()
    assert len(entries) == 6 == len({r.event_id for r in entries})
    assert sorted(r.entity_type_counts.get("EMAIL_ADDRESS", 0) for r in entries) == [0, 0, 0, 0, 2, 2]
    if mode != "redact":
        assert spark.read.parquet(store).count() == 3


def test_residual_values_inside_words(spark):
    texts = spark.createDataFrame([(1, "xalice@example.comx"), (2, "tel+44 20"), (None, "Bé"), (3, "clean"), (4, None),
                                   (5, ""), (6, "a😀\n😀b")], "i int, t string")
    known = spark.createDataFrame([("alice@example.com",), ("+44",), ("Bé",), ("",), (None,), ("zz",), ("😀b",)], "v string")
    got = {(r.i, r.v) for r in G.residual_values(texts, ["i"], "t", known, "v").collect()}
    assert got == {(1, "alice@example.com"), (2, "+44"), (None, "Bé"), (6, "😀b")}
    assert G.residual_values(texts, ["i"], "t", known.limit(0), "v").count() == 0


def test_fakes_depend_on_the_key(spark):
    df = spark.createDataFrame([(1, "mail a@b.org")], "doc int, text string")
    other = derive_key("other", b"\x02" * 32, iterations=1_000)
    made = [scrub(df, "doc", mode="pseudonymise", key=k, session_id="s").texts.first().scrubbed_text
            for k in (KEY, KEY, other)]
    assert made[0] == made[1] != made[2]


def test_spread_and_shared_folder(spark):
    df = spark.range(10).repartition(2)
    assert spread(df, "id", splits=2).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert spread(df, "id", splits=64).rdd.getNumPartitions() == 2

    class Cluster:
        class conf:
            get = staticmethod(lambda k, d=None: {"spark.master": "yarn"}.get(k, d))

    with pytest.raises(ValueError):
        shared_dir(Cluster)
