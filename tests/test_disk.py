"""What is written on the way: only rows with spans, packed, without real values, and no gram that is none."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilframe.functions import rules as R
from veilframe.operators import mapping as M
from veilframe.operators import pseudonymise as P
from veilframe.operators import substrings as Z
from veilframe.session import packed

KEY = M.derive_key("secret", b"s" * 32, iterations=1000)
ALL = R.UK_RULES + R.GENERIC_RULES
TEXTS = ["mail a@b.org", "no. 5 of 7", "no. 5 of 7", "mail a@b.org", "plain", "", None, "x\r\n1", "NI AB123456C\r\nand 2"]


def rows(spark):
    return spark.createDataFrame([(n % 3 or None, t) for n, t in enumerate(TEXTS)], "doc int, text string")


def test_packed_rows_are_the_same(spark):
    df = spark.range(50).select(
        "id", F.expr("array(named_struct('a', id, 'b', cast(NULL AS string)))").alias("x"),
        F.expr("map('k', id)").alias("m"), F.expr("current_timestamp()").alias("t"), F.lit("real value").alias("v"))
    for done in (packed(df), packed(df, "v")):
        assert done.columns == df.columns and done.schema.simpleString() == df.schema.simpleString()
        assert [(r.id, r.x[0].a, r.x[0].b, r.m["k"], r.v) for r in done.orderBy("id").collect()] == [
            (n, n, None, n, "real value") for n in range(50)]
    odd = spark.range(3).select("id", F.expr("make_interval(1, 2)").alias("i"))
    assert packed(odd).count() == 3


@pytest.mark.parametrize("maybe", [None, True, False])
def test_only_rows_with_spans_are_written(spark, monkeypatch, maybe):
    """All rows with the signs of a match were written; those without a span come from the table again, once each."""
    if maybe is not None:
        monkeypatch.setattr(P, "has_bit", lambda bits, key: F.lit(maybe) | (F.lit(not maybe) & Z.has_bit(bits, key)))
    once = P.detect_once(rows(spark), "text", KEY, None, rules=ALL, threshold=0.4)
    assert once.stored.count() == 3 and once.rest.count() == 6
    got = sorted((r.text or "?", r.scrubbed_text or "?") for r in once.redacted().collect())
    new = {"mail a@b.org": "mail [EMAIL_ADDRESS_1]", "x\r\n1": "x\n1", "NI AB123456C\r\nand 2": "NI [UK_NI_1]\nand 2"}
    assert got == sorted((t or "?", new.get(t, t) or "?") for t in TEXTS)


def test_few_other_grams_pass_the_bits(spark):
    """One in seventy of all other grams was posted, most of what was shuffled of long texts."""
    table = Z.anchors(spark.createDataFrame([(f"07700 9{n:05d}",) for n in range(3000)], "v string"), "v", "v")
    bits = Z.anchor_bits(table)
    others = np.random.default_rng(1).integers(0, 1 << 63, 200_000, dtype=np.int64).view(np.uint64)
    assert max(bits.has(others, c).mean() for c in bits.classes) < 0.001


def test_a_value_goes_on_with_one_gram(spark, monkeypatch):
    """Of many shared grams only bits go to the values; all grams of every value were shuffled to them."""
    values = [f"07700 9{n:05d}" for n in range(400)] + ["ab", "b", "é" * 40]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    want = {r.value: r["class"] for r in Z.anchors(df, "v", "v").collect()}
    monkeypatch.setattr(Z, "small_enough", lambda df, limit=0: False)
    got = Z.anchors(df, "v", "v").collect()
    assert {r.value: r["class"] for r in got} == want and len(got) == len(values)
    for r in got:
        assert (r["class"], r.gram, r.offset) in Z.minimisers(r.value)
