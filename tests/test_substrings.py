"""Values found inside texts: against plain search, in place and through joins."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from veilframe.operators import substrings as Z
from veilframe.operators.guard import residual_values
from veilframe.operators.pseudonymise import restore_chunks, restore_documents


def brute(text, values):
    return sorted((i, v) for v in values for i in range(len(text)) if text.startswith(v, i))


def matcher(values):
    rows = []
    for v in sorted(set(values)):
        grams = Z.minimisers(v)
        rows.append((v, *grams[hash(v) % len(grams)]))
    return Z.Matcher(rows)


letters = st.sampled_from("ab1é \U0001f600")


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(letters, max_size=80), min_size=1, max_size=5),
       st.lists(st.text(letters, min_size=1, max_size=40), min_size=1, max_size=6), st.data())
def test_every_occurrence_is_found(texts, values, data):
    """Random values, and pieces of the texts themselves so that there is something to find."""
    for text in texts:
        if text:
            i = data.draw(st.integers(0, len(text) - 1))
            values.append(text[i:i + data.draw(st.integers(1, 40))])
    found = matcher(values)
    got = sorted({(k, s, found.values[n]) for k, s, n in found.find(texts)})
    assert got == sorted((k, i, v) for k, t in enumerate(texts) for i, v in set(brute(t, set(values))))


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 6), min_size=1, max_size=60), st.integers(1, 6))
def test_selected_is_the_lowest_of_some_run(hashes, run):
    h = np.array(hashes, np.uint64)
    want = [any(h[p] == h[i:i + run].min() for i in range(max(0, p - run + 1), min(p, len(h) - run) + 1))
            for p in range(len(h))]
    assert Z.selected(h, run).tolist() == want


def test_occurrences_across_segments(monkeypatch):
    monkeypatch.setattr(Z, "SEGMENT", 100)
    values = ["needle in hay", "x" * 50, "é", "needle in hay and far more of it, as long as this"]
    text = ("hay " * 20 + values[3] + "x" * 70 + "é") * 6
    found = matcher(values)
    assert sorted((s, found.values[n]) for _, s, n in found.find([text])) == brute(text, values)


def test_longer_values_go_first():
    found = [(0, "ab", "1"), (1, "bcd", "2"), (4, "ab", "1"), (2, "cd", "3"), (6, "b", "4")]
    assert Z.replaced("abcdabb", found) == "a21" + "4"


PAIRS = [("Fay Fake", "Real One"), ("fa@x.org", "re@y.org"), ("Fay", "Al"), ("07700 912345", "01234 567890"), ("E1", "SW9")]
ROWS = [(1, "hello Fay Fake"), (1, "mail fa@x.org and Fay Fake here"), (None, "Fay Fay Fakery"), (None, None), (2, ""),
        (3, "glued07700 912345and07700 9123456"), (4, "E1E1 E1"), (4, "nothing"), (4, "nothing")]
WANT = ["hello Real One", "mail re@y.org and Real One here", "Al Real Onery", None, "",
        "glued01234 567890and01234 5678906", "SW9SW9 SW9", "nothing", "nothing"]


@pytest.mark.parametrize("limit", [100_000, 0], ids=["in place", "joined"])
def test_restore_by_row(spark, monkeypatch, limit):
    """Repeated and null ids never mix; fakes are found inside longer words."""
    monkeypatch.setattr(Z, "VALUE_LIMIT", limit)
    pairs = spark.createDataFrame(PAIRS, "fake_value string, real_value string")
    texts = spark.createDataFrame([(n, *r) for n, r in enumerate(ROWS)], "n int, doc_id int, text string")
    for done in (restore_documents(texts, "doc_id", "text", pairs), restore_chunks(texts, ["doc_id", "n"], "text", pairs)):
        assert [r.restored_text for r in done.orderBy("n").collect()] == WANT


@pytest.mark.parametrize("limit", [100_000, 0], ids=["in place", "joined"])
def test_residual_values(spark, monkeypatch, limit):
    monkeypatch.setattr(Z, "VALUE_LIMIT", limit)
    rng = np.random.default_rng(1)
    values = ["E1", "a", *("".join(rng.choice(list("abc1"), n)) for n in range(2, 45))]
    texts = [None, "", *("".join(rng.choice(list("abc1 "), 300)) for _ in range(6)), *[v + "E1" for v in values]]
    df = spark.createDataFrame(list(enumerate(texts)), "n int, text string")
    known = spark.createDataFrame([(v,) for v in [*values, "", "E1"]], "v string")
    got = sorted(tuple(r) for r in residual_values(df, ["n"], "text", known, "v").collect())
    assert got == sorted((n, v) for n, t in enumerate(texts) if t for v in set(values) if v in t)


def test_a_short_value_adds_no_pairs_of_others(spark):
    """A two-letter value does not loosen the others, and a common beginning anchors few of them."""
    values = [f"07700 9{n:05d}" for n in range(500)]
    rows = Z.anchors(spark.createDataFrame([(v,) for v in [*values, "E1"]], "v string"), "v", "v").collect()
    grams = {r.value: (r["class"], r.gram) for r in rows}
    assert len(grams) == 501 and grams["E1"][0] != grams[values[0]][0]
    shared = {}
    for key in grams.values():
        shared[key] = shared.get(key, 0) + 1
    assert max(shared.values()) <= 20


def test_few_values_are_anchored_like_many(spark):
    rng = np.random.default_rng(5)
    values = sorted({"".join(rng.choice(list("ab1é"), n)) for n in rng.integers(1, 60, 300)})
    table = Z.anchors(spark.createDataFrame([(v,) for v in values], "v string"), "v", "v").collect()
    assert sorted(Z.anchored(values)) == sorted((r.value, r["class"], r.gram, r.offset) for r in table)
    assert Z.anchored([]) == []


def test_long_values_take_the_joins(spark):
    long = "ab" * 600
    texts = spark.createDataFrame([(1, f"x{long}y"), (2, "ab")], "n int, text string")
    known = spark.createDataFrame([(long,), ("xa",)], "v string")
    assert Z.few_values(known, "v", "v") is None
    assert sorted(tuple(r) for r in residual_values(texts, ["n"], "text", known, "v").collect()) == [(1, long), (1, "xa")]


def test_density():
    """Selected grams of longer classes are a small share of the characters."""
    points = np.random.default_rng(0).integers(97, 123, 100_000).astype(np.uint32)
    for least, k, run in Z.CLASSES[:2]:
        assert Z.selected(Z.gram_hashes(points, k), run).mean() < 0.23
