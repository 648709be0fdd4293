"""The prefix tree of phrases: against brute force, its cost, and phrases longer than the tree."""

import random
import re

import pytest
from pyspark.sql import functions as F

from veilframe.operators import gazetteer as Z
from veilframe.operators import prefixtree as P

WORDS = ["ann", "Bob", "lee", "Zoë", "ΑΣ", "o", "x1", "new", "york", "'", "-", "the"]


def folded(text):
    return re.sub(r"\s+", " ", text).lower()


def brute(texts, names, ignore_case):
    """All spans from atom border to atom border whose folded form is a name."""
    fold = folded if ignore_case else (lambda t: re.sub(r"\s+", " ", t))
    wanted = {fold(n) for n in names}
    out = set()
    for i, text in enumerate(texts):
        atoms = [m.span() for m in re.finditer(r"\w+|[^\w\s]", text or "")]
        for a, (start, _) in enumerate(atoms):
            for _, end in atoms[a:a + 12]:
                if fold(text[start:end]) in wanted:
                    out.add((i, start, end, text[start:end]))
    return out


@pytest.mark.parametrize("ignore_case", [True, False])
@pytest.mark.parametrize("limit", [100_000, 0])
def test_tree_against_brute_force(spark, monkeypatch, ignore_case, limit):
    """Random phrases of one to nine atoms, more than the tree has levels; odd blanks; nulls."""
    rng = random.Random(5)

    def phrase(n, blanks):
        return "".join(rng.choice(WORDS) + rng.choice(blanks) for _ in range(n)).strip()

    names = [phrase(rng.randint(1, 9), [" ", " ", "", "'"]) for _ in range(60)]
    names += ["", "  ", " ann", "ΑΣ'ΑΣ", "new york", "New York"]
    texts = [" ".join(rng.choice(names + WORDS) for _ in range(30)) for _ in range(30)]
    texts += [None, "", "new\n\t york  new york", "ασ'ας ΑΣ'ΑΣ", "  ann  ", "newyork"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    entries = spark.createDataFrame([(n,) for n in [*names, None]], "name string")
    monkeypatch.setattr(Z.first_atoms, "__defaults__", (0,))
    rows = Z.find_entries(df, ["id"], "text", entries, "name", ignore_case=ignore_case,
                          broadcast_rows=limit).collect()
    got = [(r.id, r.start, r.end, r.surface) for r in rows]
    assert set(got) == brute(texts, names, ignore_case) and len(got) == len(set(got))


def test_only_prefixes_are_extended(spark):
    """Common first atoms alone build no n-gram, whatever the number of phrases."""
    df = spark.createDataFrame([(1, "the cat and the dog " * 500 + "the end 77")], "id int, text string")
    entries = spark.range(200_000).select(F.concat(F.lit("The End "), F.col("id")).alias("name"))
    rows = P.likely_entries(df, ["id"], "text", entries, "name", [3], 600_000, True)
    got = [(r.start, r.surface) for r in rows.collect()]
    assert (10_000, "the end 77") in got and len(got) <= 2


def test_no_entries_and_no_texts(spark, monkeypatch):
    monkeypatch.setattr(Z.first_atoms, "__defaults__", (-1,))
    df = spark.createDataFrame([(1, "ann")], "id int, text string")
    none = spark.createDataFrame([], "name string")
    assert Z.find_entries(df, ["id"], "text", none, "name").count() == 0
    some = spark.createDataFrame([("ann",)], "name string")
    assert Z.find_entries(df.limit(0), ["id"], "text", some, "name").count() == 0
    assert Z.find_entries(df, ["id"], "text", some, "name").count() == 1
