"""The public API in both modes, on documents and on chunk tables."""

import random

import pytest
from pyspark.sql import functions as F

from veilframe import Rule, derive_key, scrub
from veilframe.functions import rules as R
from veilframe.operators import guard as G
from veilframe.operators import mapping as M
from veilframe.operators import pseudonymise as P
from veilframe.operators import redact

KEY = derive_key("secret", b"s" * 32, iterations=1000)


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id int, text string")


def test_arguments(spark):
    df = docs(spark, [(1, "x")])
    with pytest.raises(ValueError):
        scrub(df, "doc_id", mode="erase")
    with pytest.raises(ValueError):
        scrub(df, "doc_id", mode="pseudonymise")
    with pytest.raises(ValueError):
        scrub(df, "doc_id", threshold=2)
    with pytest.raises(ValueError):
        derive_key("", b"s" * 32)


def test_redact(spark, pii_text):
    out = scrub(docs(spark, [(1, pii_text), (2, "nothing"), (3, "")]), "doc_id").texts
    rows = {r.doc_id: r for r in out.collect()}
    assert "AB123456C" not in rows[1].scrubbed_text and "[UK_NI_1]" in rows[1].scrubbed_text
    assert rows[1].entity_counts["UK_PHONE"] == 1 and rows[2].entity_counts == {}
    assert rows[2].scrubbed_text == "nothing" and rows[3].scrubbed_text == ""
    again = scrub(out.select("doc_id", F.col("scrubbed_text").alias("text")), "doc_id").texts
    assert again.filter("size(entity_counts) > 0").count() == 0


def test_redact_is_narrow(spark):
    """No exchange: documents are redacted where they are read."""
    folder = "/root/testdata/sf0.001/documents.parquet"
    from veilframe.operators.detect import with_hits
    plan = redact.redact_documents(with_hits(spark.read.parquet(folder)))
    text = plan.select("doc_id", "scrubbed_text")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in text and "ReadSchema: struct<doc_id:bigint,text:string>" in text


def test_entity_subset_prunes_rules(spark):
    df = docs(spark, [(1, "a@b.org 10.0.0.1")])
    out = scrub(df, "doc_id", entities="email_address").texts.first()
    assert out.scrubbed_text == "[EMAIL_ADDRESS_1] 10.0.0.1"
    rules = (Rule("word", "WORD", r"\bsecret\b", 0.9),)
    out = scrub(docs(spark, [(1, "a Secret")]), "doc_id", rules=rules).texts.first()
    assert out.scrubbed_text == "a [WORD_1]"


def test_chunk_numbering_over_blocks(spark, monkeypatch):
    """Block-wise numbers equal one running counter, also for one document with most chunks."""
    monkeypatch.setattr(redact, "BLOCK", 4)
    rng = random.Random(5)
    rows = []
    for doc, n in ((1, 90), (2, 3), (3, 1)):
        for k in range(n):
            words = [rng.choice(["a@b.org", "x", "10.0.0.1", "hello"]) for _ in range(4)]
            rows.append((doc, k * rng.choice([1, 1]), " ".join(words)))
    df = spark.createDataFrame(rows, "doc int, ord int, text string")
    got = {(r.doc, r.ord): r.scrubbed_text for r in scrub(df, "doc", order="ord").texts.collect()}
    counters, want = {}, {}
    for doc, k, text in sorted(rows):
        words = text.split(" ")
        for i in reversed(range(len(words))):
            kind = {"a@b.org": "EMAIL_ADDRESS", "10.0.0.1": "IP_ADDRESS"}.get(words[i])
            if kind:
                counters[doc, kind] = counters.get((doc, kind), 0) + 1
                words[i] = f"[{kind}_{counters[doc, kind]}]"
        want[doc, k] = " ".join(words)
    assert got == want


TEXTS = [(i, f"Mail u{i % 7}@b.org, again u{i % 7}@b.org\nfrom 10.0.{i}.1 tel+44 7700 900 1{i:02d} "
             f"card 4111 1111 1111 1111 née.x{i}@b.orgé") for i in range(40)]


def test_pseudonymise_and_restore(spark):
    df = docs(spark, TEXTS)
    out = scrub(df, "doc_id", mode="pseudonymise", key=KEY, session_id="s")
    rows = {r.doc_id: r.scrubbed_text for r in out.texts.collect()}
    assert out.session_id == "s"
    assert not any("u1@b.org" in t or "4111" in t for t in rows.values())
    first = rows[3].split("Mail ")[1].split(",")[0]
    assert rows[3].count(first) == 2 and rows[10].count(first) == 2
    mapping = out.mapping
    assert mapping.count() == mapping.select("fake_value").distinct().count()
    pairs = M.replacements(mapping, "s", KEY)
    back = P.restore_documents(out.texts.select("doc_id", "scrubbed_text"), "doc_id",
                               "scrubbed_text", pairs)
    assert {r.doc_id: r.restored_text for r in back.collect()} == dict(TEXTS)
    G.assert_no_private_columns(mapping)
    assert "original" not in out.texts.columns
    raw = [bytes(r.real_value_encrypted) for r in mapping.collect()]
    assert not any(b"b.org" in r for r in raw) and len(set(raw)) == len(raw)


def test_second_run_of_a_session_keeps_its_fakes(spark):
    first = scrub(docs(spark, TEXTS[:5]), "doc_id", mode="pseudonymise", key=KEY, session_id="s")
    second = scrub(docs(spark, TEXTS), "doc_id", mode="pseudonymise", key=KEY, session_id="s",
                   mapping=first.mapping)
    old = {r.doc_id: r.scrubbed_text for r in first.texts.collect()}
    new = {r.doc_id: r.scrubbed_text for r in second.texts.collect()}
    assert all(new[d] == t for d, t in old.items())
    both = first.mapping.unionByName(second.mapping)
    assert both.select("original_hash").distinct().count() == both.count()
    assert both.select("fake_value").distinct().count() == both.count()


def test_pseudonymise_chunks_round_trip(spark):
    df = docs(spark, TEXTS).select(F.lit(1).alias("conv"), F.col("doc_id").alias("turn"), "text")
    out = scrub(df, "conv", order="turn", mode="pseudonymise", key=KEY, session_id="t")
    pairs = M.replacements(out.mapping, "t", KEY)
    back = P.restore_chunks(out.texts, ["conv", "turn"], "scrubbed_text", pairs)
    assert back.filter("restored_text != text").count() == 0
    assert out.texts.filter("scrubbed_text = text").count() == 0


def test_performance_text_values(spark):
    words = ["lorem"] * 720
    for k, v in enumerate(["AB123456C", "a.b@c.co.uk", "07700 900123", "SW1A 2AA", "EF345678E"]):
        words[k * 100 + 7] = v
    out = scrub(docs(spark, [(1, " ".join(words))]), "doc_id").texts.first().scrubbed_text
    assert "EF345678E" in out and "AB123456C" not in out and out.count("[") == 4
    assert out.count("[") == out.count("]")


PEOPLE = [(1, "Ann Lee wrote to York.\nyork and a@b.org"), (2, "nothing"), (3, "ANN  LEE\n\nYork")]


def people(spark):
    from veilframe import Gazetteer
    names = spark.createDataFrame([("Ann Lee",)], "n string")
    places = spark.createDataFrame([("York",)], "n string")
    return [Gazetteer("PERSON", names, "n"), Gazetteer("LOCATION", places, "n", ignore_case=False)]


def test_gazetteers_feed_redaction(spark):
    out = scrub(docs(spark, PEOPLE), "doc_id", gazetteers=people(spark)).texts
    assert {r.doc_id: r.scrubbed_text for r in out.collect()} == {
        1: "[PERSON_1] wrote to [LOCATION_1].\nyork and [EMAIL_ADDRESS_1]", 2: "nothing",
        3: "[PERSON_1]\n\n[LOCATION_1]"}
    counts = {r.doc_id: r.entity_counts for r in out.collect()}
    assert counts[1] == {"PERSON": 1, "LOCATION": 1, "EMAIL_ADDRESS": 1} and counts[2] == {}
    only = scrub(docs(spark, PEOPLE), "doc_id", gazetteers=people(spark), entities="LOCATION")
    assert "Ann Lee" in only.texts.filter("doc_id = 1").first().scrubbed_text


def test_gazetteers_on_chunks_and_pseudonyms(spark):
    turns = docs(spark, PEOPLE).select(F.lit(7).alias("conv"), F.col("doc_id").alias("turn"), "text")
    out = scrub(turns, "conv", order="turn", gazetteers=people(spark)).texts
    assert {r.turn: r.scrubbed_text for r in out.collect()}[3] == "[PERSON_2]\n\n[LOCATION_2]"
    run = scrub(docs(spark, PEOPLE), "doc_id", mode="pseudonymise", key=KEY, session_id="g",
                gazetteers=people(spark))
    texts = {r.doc_id: r.scrubbed_text for r in run.texts.collect()}
    assert "Ann" not in texts[1] and "York" not in texts[1] and texts[2] == "nothing"
    pairs = M.replacements(run.mapping, "g", KEY)
    back = P.restore_documents(run.texts.select("doc_id", "scrubbed_text"), "doc_id",
                               "scrubbed_text", pairs)
    assert {r.doc_id: r.restored_text for r in back.collect()} == dict(PEOPLE)
    assert run.mapping.filter("entity_type = 'PERSON'").count() == 2


def test_model_hook(spark):
    def load():
        def find(texts):
            return [[("TITLE", t.index("wrote"), t.index("wrote") + 5, 0.9)] if "wrote" in t else []
                    for t in texts]
        return find
    out = scrub(docs(spark, PEOPLE), "doc_id", model=load).texts.filter("doc_id = 1").first()
    assert out.scrubbed_text == "Ann Lee [TITLE_1] to York.\nyork and [EMAIL_ADDRESS_1]"
