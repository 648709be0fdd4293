import random
import re
from collections import Counter

import numpy as np

from veilframe.llm import quality


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    found = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {j + k for j in range(len(words) - 2) if found[tuple(words[j:j + 3])] > 1 for k in range(3)}
    seen, dups = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dups += line in seen
            seen.add(line)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dups, len(covered))


def test_statistics(awkward):
    rng = random.Random(2)
    texts = ["".join(rng.choice("ab \n#É|") for _ in range(rng.randint(0, 200))) for _ in range(300)]
    for t in [*texts, None, "a b c a b c", "x\x1cy\x85z", *(r.text for r in awkward.collect())]:
        assert quality.statistics(t)[:5] == brute(t), t


def test_forest_tells_junk_from_prose():
    rng = np.random.default_rng(0)
    good = np.column_stack([rng.integers(60, 900, 600), np.zeros(600), rng.integers(0, 2, 600),
                            np.zeros(600), rng.integers(0, 9, 600), rng.integers(1, 9, 600), np.full(600, 9)])
    good[:, 1] = good[:, 0] * rng.normal(5, .2, 600)
    bad = good[:80].copy()
    bad[:, 2] = bad[:, 0] * rng.uniform(.4, 2, 80)
    rows, flag = np.vstack([good, bad]), np.r_[np.ones(600), np.zeros(80)] == 1
    forest = quality.calibrate(quality.fit(rows[flag], rows), rows, flag)
    kept = forest.path(quality.features(rows)) >= forest.threshold
    assert kept[flag].mean() > 0.98 and kept[~flag].mean() < 0.05


def test_paths_and_threshold_against_brute_force():
    """Every tree is walked node by node; every cut between two path lengths is tried."""
    rng = np.random.default_rng(3)
    rows = rng.integers(0, 40, (300, 7))
    rows[:, 0] += 50
    rows = np.vstack([rows, rows[:20]])
    flag = rng.random(len(rows)) < 0.8
    forest = quality.calibrate(quality.fit(rows[flag], rows), rows, flag)
    x = quality.features(rows)

    def walk(tree, point):
        at = 0
        while tree.feature[at] >= 0:
            side = tree.left if point[tree.feature[at]] < tree.cut[at] else tree.right
            at = side[at]
        return tree.depth[at]

    path = np.array([sum(walk(t, point) for t in forest.trees) / len(forest.trees) for point in x])
    assert np.allclose(forest.path(x), path)

    def cost(threshold):
        kept = path >= threshold
        return quality.GOOD_WEIGHT * (flag & ~kept).sum() + (~flag & kept).sum()

    cuts = [-1.0, *((a + b) / 2 for a, b in zip(np.unique(path), np.unique(path)[1:], strict=False)), path.max() + 1]
    assert cost(forest.threshold) == min(map(cost, cuts))


def test_one_row_of_a_labelled_id(spark, make_docs, monkeypatch):
    """An id on many rows brings one of them to the fit."""
    seen = []
    fit = quality.fit
    monkeypatch.setattr(quality, "fit", lambda rows, every: seen.append(len(every)) or fit(rows, every))
    texts = [(i, " ".join(f"w{i}x{k}" for k in range(60 + i))) for i in range(6)]
    docs = make_docs([*texts, *[(3, t + f" and {j}") for j in range(40) for _, t in texts[:2]]])
    labels = spark.createDataFrame([(i, int(i != 5)) for i in range(6)], "doc_id bigint, quality int")
    forest = quality.train(docs, labels)
    assert seen == [6] and len(forest.trees) == quality.TREES


def test_awkward_rows(spark, awkward, no_docs):
    labels = spark.createDataFrame([(0, 0, 0), (5, 1, 0), (8, 1, 1), (99, 1, 0), (None, 1, 0), (6, None, 0)],
                                   "doc_id bigint, quality int, toxic int")
    rows = quality.quality(awkward, labels).collect()
    assert len(rows) == awkward.count()
    for r in rows:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)
    kept = quality.keep_good(awkward, labels)
    assert kept.columns == awkward.columns and kept.count() == sum(r.kept for r in rows)
    assert quality.quality(no_docs, labels).count() == 0
    assert quality.quality(awkward, labels.filter("false")).count() == len(rows)
