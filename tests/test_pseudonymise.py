"""Pseudonymise in one detection pass, with exceptions joined; restore gives the text back."""

import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veilframe import scrub
from veilframe.functions import fakes as K
from veilframe.functions import rules as R
from veilframe.operators import mapping as M
from veilframe.operators import pseudonymise as P

KEY = M.derive_key("secret", b"s" * 32, iterations=1000)
ALL = R.UK_RULES + R.GENERIC_RULES

PARTS = ("NI AB123456C", "NHS number 943 476 5919", "SW1A 2AA", "call 07700 900123", "IBAN GB29NWBK60161331926819",
         "a.b@example.co.uk", "from 10.1.2.3 to 10.1.2.33", "card 4111 1111 1111 1111", "Dear Sarah Mitchell", "Mr Owen Patel",
         "a Welsh buyer at Harbour Foods Ltd", "on 12/03/2020 or 2020-03-12", "Licence number MORGA657054SM9IJ", "2001:db8::1",
         "\n", "\n\n", "  ", "plain words", "é日", "")


def table(spark, texts):
    return spark.createDataFrame([(n, None if n % 5 == 0 else n % 3, t) for n, t in enumerate(texts)],
                                 "n int, doc int, text string")


def back(spark, done):
    pairs = M.replacements(done.mapping, done.session_id, KEY)
    return P.restore_documents(done.texts, "doc", "scrubbed_text", pairs)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from(PARTS), max_size=8).map(" ".join), min_size=1, max_size=30))
def test_restore_undoes_pseudonymise(spark, texts):
    """All rules, null and repeated ids."""
    done = scrub(table(spark, [*texts, None]), "doc", mode="pseudonymise", key=KEY, rules=ALL, threshold=0.3)
    rows = back(spark, done).orderBy("n").collect()
    assert [r.restored_text for r in rows] == [*texts, None]
    for r in rows:
        if r.text:
            assert "AB123456C" not in r.scrubbed_text and "a.b@example.co.uk" not in r.scrubbed_text


def test_chunks(spark):
    texts = ["mail a@b.org\nor c@d.org", "a@b.org", "nothing", None, "  "]
    done = scrub(table(spark, texts), "doc", order="n", mode="pseudonymise", key=KEY)
    rows = P.restore_chunks(done.texts, ["doc", "n"], "scrubbed_text", M.replacements(done.mapping, done.session_id, KEY))
    rows = rows.orderBy("n").collect()
    assert [r.restored_text for r in rows] == texts
    assert [sum(r.entity_counts.values()) for r in rows] == [2, 1, 0, 0, 0]
    assert re.search(r"mail (\S+)\n", rows[0].scrubbed_text).group(1) == rows[1].scrubbed_text


def found(spark, texts, salt="s"):
    return P.detect_once(table(spark, texts), "text", KEY, salt, rules=ALL, threshold=0.4)


def test_usual_fakes_are_no_exceptions(spark):
    once = found(spark, list(PARTS))
    mapping = M.build_mapping(once.span_rows("n"), "s", KEY, doc="n")
    assert once.exceptions(mapping).count() == 0


def test_exceptions(spark, monkeypatch):
    """Fakes made anew in a tiny pool, fakes of an earlier run, and values the mapping lacks."""
    monkeypatch.setattr(K, "GENERATORS", {**K.GENERATORS, "UK_PHONE": lambda h: f"concat('0', {K.digits(K.word(h, 0), 1)})"})
    phones = [f"call 07700 9{n:05d}" for n in range(40)]
    once = found(spark, phones + phones[:3])
    mapping = M.build_mapping(once.span_rows("n"), "s", KEY, doc="n")
    given_fakes = {r.original_hash: r.fake_value for r in mapping.collect()}
    assert len(set(given_fakes.values())) == 40
    hashes = {r.original: r.h for r in once.span_rows("n").select(
        "original", F.sha2(F.col("original"), 256).alias("h")).collect()}
    want = {p: "call " + given_fakes[hashes[p[5:]]] for p in phones}
    rows = once.pseudonymised(mapping).collect()
    assert len(rows) == 43 and all(r.scrubbed_text == want[r.text] for r in rows)
    assert once.exceptions(mapping).count() >= 30
    own = mapping.withColumn("fake_value", F.lit("kept")).limit(1)
    kept = {r.text: r.scrubbed_text for r in once.pseudonymised(own).collect()}
    held = own.first().original_hash
    assert all(kept[p] == "call " + ("kept" if hashes[p[5:]] == held else "[UK_PHONE_FAKE]") for p in phones)


def test_later_runs_take_earlier_fakes(spark):
    first = scrub(table(spark, ["a@b.org"]), "doc", mode="pseudonymise", key=KEY, session_id="x")
    old = first.mapping.withColumn("fake_value", F.lit("old@example.com"))
    second = scrub(table(spark, ["c@d.org a@b.org", "a@b.org"]), "doc", mode="pseudonymise", key=KEY, session_id="x",
                   mapping=old)
    texts = [r.scrubbed_text for r in second.texts.orderBy("n").collect()]
    assert texts[1] == "old@example.com" and texts[0].endswith(" old@example.com") and second.mapping.count() == 1


@pytest.mark.parametrize("order", [None, "n"])
def test_texts_are_not_shuffled(spark, order):
    """Detection runs once, and no exchange of the output carries a text."""
    done = scrub(table(spark, list(PARTS)), "doc", order=order, mode="pseudonymise", key=KEY)
    plan = done.texts._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan and "AB" + "CEGHJ-PR" not in plan


def test_nothing_real_is_written(spark):
    once = found(spark, ["a@b.org and AB123456C"])
    row = once.stored.first().asDict(recursive=True)
    assert "a@b.org" not in str(row) and "AB123456C" not in str(row)
