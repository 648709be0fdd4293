"""Context words before a span: long lines by blocks, equal to the plain reading."""

import random
import time

import pytest
from pyspark.sql import functions as F

from veilframe.functions import rules as R
from veilframe.functions import spans as S


def brute(text, start):
    return " ".join(text[:start].lower().split()[-R.CONTEXT_WINDOW:])


@pytest.mark.parametrize("alphabet", ["ab ", "abcdefgh \t", "a😀é  ", "abcdefghijklmnopq" * 6 + " "])
def test_blocks_equal_the_plain_reading(spark, monkeypatch, alphabet):
    """Tokens over borders, runs of blanks, tokens longer than blocks, letters of four bytes."""
    monkeypatch.setattr(S, "CONTEXT_BLOCK", 16)
    rng = random.Random(7)
    texts = ["".join(rng.choice(alphabet) for _ in range(n)) for n in (0, 1, 31, 32, 33, 48, 200, 333)]
    rows = [(t, at) for t in texts for at in range(len(t) + 1)]
    df = spark.createDataFrame(rows, "t string, at int").repartition(4)
    blocks = df.withColumn("b", F.expr(S.context_blocks("t")))
    got = blocks.select("t", "at", F.expr(S.context_before("t", "at", "b")).alias("c")).collect()
    assert len(got) == len(rows) and all(r.c == brute(r.t, r.at) for r in got)


def test_long_line_is_linear(spark):
    """One line of 1 and of 4 MB, a span with a context word in every 100 characters."""
    unit = "please note the national insurance number AB123456C of this good customer and go on to the next line of it all "
    expr = S.candidate_spans("t", [r for r in R.UK_RULES if r.context], 0.0)
    took = []
    for copies in (100, 10_000, 40_000):
        df = spark.createDataFrame([(unit * copies,)], "t string")
        begun = time.monotonic()
        n = df.select(F.expr(f"size({expr})").alias("n"), F.expr(f"size(filter({expr}, x -> x.score > 0.9))")).first()
        took.append(time.monotonic() - begun)
    assert n[0] >= 40_000 and n[1] >= 40_000
    assert took[2] < 10 * max(took[1], 1)
