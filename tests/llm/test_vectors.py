"""Hard negatives and near-duplicate vectors against brute force."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from veilframe.llm import covertree as C
from veilframe.llm import negatives as N

SCHEMA = "vec_id bigint, embedding array<float>, label int, key string, rank string"


def frame(spark, rows, kind="float"):
    schema = SCHEMA.replace("array<float>", f"array<{kind}>")
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], y, "k", "r")
                                  for i, v, y in rows], schema)


def clusters(seed, n, dim=8, groups=6, spread=0.08):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dim))
    points = centres[rng.integers(0, groups, n)] + spread * rng.normal(size=(n, dim))
    far = rng.random(n) < 0.5
    points[far] = rng.normal(size=(far.sum(), dim))
    points = points.astype(np.float32)
    points[-n // 6:] = points[0]                       # a group of exact copies
    return [(int(i), points[i].tolist(), int(rng.integers(0, 4))) for i in range(n)]


ODD = [(1001, None, 1), (1002, [], 1), (1003, [0.0] * 8, 2), (1004, [math.nan] + [1.0] * 7, 1),
       (1005, [math.inf] + [1.0] * 7, 1), (1006, [None] + [1.0] * 7, 1), (1007, [1.0, 2.0], 1), (1100, [2.0, 4.0], 1),
       (None, [1.0] * 8, 1), (None, [1.0] * 8, 1), (1200, [1.0] * 8, None), (1300, [1.0] * 8, 3), (1300, [1.0] * 8, 3),
       (1301, [1e30] * 8, 3), (1302, [1e-30] * 8, 2)]


# Near duplicates -----------------------------------------------------------------------

def brute_near(rows, cosine=0.95):
    """Sorted ``(vec_id, n_links, component_id, kept)``."""
    unit = []
    for _, v, _ in rows:
        ok = v and all(x is not None and math.isfinite(x) for x in v) and any(v)
        unit.append(C.unit(np.array([v], np.float32).astype(float))[0] if ok else None)
    n = len(rows)
    up = list(range(n))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    links = [0] * n
    for i in range(n):
        for j in range(i):
            if (unit[i] is not None and unit[j] is not None and len(unit[i]) == len(unit[j])
                    and float(unit[i] @ unit[j]) >= cosine):
                links[i] += 1
                links[j] += 1
                up[root(i)] = root(j)
    sets = {}
    for i in range(n):
        sets.setdefault(root(i), []).append(i)
    out = []
    for members in sets.values():
        ids = [rows[i][0] for i in members if rows[i][0] is not None]
        low = min(ids) if ids else None
        out += [(rows[i][0], links[i], low, rows[i][0] is not None and rows[i][0] == low) for i in members]
    return sorted(out, key=repr)


def near(df, **kw):
    return sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in C.near_vectors(df, **kw).collect()), key=repr)


def test_near_vectors(spark):
    rows = clusters(1, 400) + ODD
    assert near(frame(spark, rows)) == brute_near(rows)


def test_near_vectors_over_many_blocks(spark, monkeypatch):
    """Small blocks, runs and nodes, so that every level of both trees is used."""
    for name, value in (("BLOCK", 16), ("RUN", 2), ("FAN_OUT", 2), ("PIVOTS", 20)):
        monkeypatch.setattr(C, name, value)
    rows = clusters(2, 300, spread=0.2)
    assert near(frame(spark, rows, "double"), cosine=0.9) == brute_near(rows, 0.9)


def test_near_vectors_empty(spark):
    assert near(frame(spark, [])) == []
    assert near(frame(spark, [(5, None, 1)])) == [(5, 0, 5, True)]


def test_hot_group_is_not_written_out_as_pairs(spark):
    """Near copies: their links are counted by whole nodes, far fewer rows than pairs."""
    rng = np.random.default_rng(3)
    rows = [(i, (np.ones(8) + 0.002 * rng.normal(size=8)).tolist(), 0) for i in range(3000)]
    assert {(n, c) for _, n, c, _ in near(frame(spark, rows))} == {(2999, 0)}


def tree_of(seed, n, dim):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, dim))
    points = centres[rng.integers(0, 5, n)] + rng.choice([0.001, 0.05, 0.5], n)[:, None] * rng.normal(size=(n, dim))
    return C.cover_tree(C.unit(points))


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 60), st.integers(1, 60), st.integers(2, 6), st.floats(0.5, 0.999))
def test_traversal(seed, n, m, dim, cosine):
    a, b = tree_of(seed, n, dim), tree_of(seed + 1, m, dim)
    links_a, links_b, parent = np.zeros(n, int), np.zeros(m, int), np.arange(n + m)
    C.Meeting(cosine).meet(a, b, np.ones(n), np.full(m, 2.0), links_a, links_b, parent, 0, n)
    want = a.points @ b.points.T >= cosine
    sure = np.abs(a.points @ b.points.T - cosine) > 1e-12
    if sure.all():
        assert links_a.tolist() == (want.sum(1) * 2).tolist() and links_b.tolist() == want.sum(0).tolist()
        check = np.arange(n + m)
        C.unite(check, *[x + at for x, at in zip(np.nonzero(want), (0, n), strict=True)])
        assert parent.tolist() == check.tolist()


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 80), st.integers(2, 6))
def test_cover_tree(seed, n, dim):
    """Nets are nested, cover their nodes, halve their radius and keep centres apart."""
    tree = tree_of(seed, n, dim)
    apart = np.sqrt(np.maximum(2 - 2 * tree.points @ tree.points.T, 0))
    for i in range(1, len(tree.node)):
        centres, above = np.unique(tree.node[i]), np.unique(tree.node[i - 1])
        assert set(above) <= set(centres) and (tree.node[i][centres] == centres).all()
        for c in centres:
            members = np.flatnonzero(tree.node[i] == c)
            assert len(set(tree.node[i - 1][members])) == 1
            assert apart[c, members].max() <= tree.radius[i][c] + 1e-7
        if i < len(tree.node) - 1:
            assert tree.radius[i].max() <= 2.0 ** (1 - i)


# Hard negatives ------------------------------------------------------------------------

def brute_negatives(rows):
    usable = []
    for i, v, y in rows:
        if i is None or y is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        y = (y + 1) % 10 if i % 7 == 0 else y
        usable.append((i, y, [math.floor(256 * float(np.float32(x))) for x in v]))
    anchors = {}
    for i, y, v in usable:
        if i % 100 == 0:
            code = [x >= 0 for x in v[:N.ORDER_BITS]]
            anchors[i] = min(anchors.get(i, (len(v), code, y, v)), (len(v), code, y, v))

    def score(a, b):
        return min(max(sum(p * q for p, q in zip(a, b, strict=True)), -2**63), 2**63 - 1)

    out = []
    for i, (dim, _, y, v) in anchors.items():
        met = sorted((-score(v, w), j, label) for j, label, w in usable if len(w) == dim)
        positives = [(j, -s) for s, j, label in met if label == y and j != i][:5]
        for j, p in positives:
            fits = [(k, -s) for s, k, label in met if label != y and 30 * p <= -100 * s <= 90 * p][:10]
            out += [(i, j, n, k, p, s) for n, (k, s) in enumerate(fits, 1)]
    return sorted(out)


def negatives(df):
    done = N.hard_negatives(df)
    assert done.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in done.collect())


def labelled(seed, n):
    """Many anchors and ties: small whole components, ids in steps of 25."""
    rng = np.random.default_rng(seed)
    points = rng.integers(-2, 5, (n, 6)) / 8
    return [(25 * i, points[i].tolist(), int(rng.integers(0, 3))) for i in range(n)]


def test_hard_negatives(spark):
    rows = labelled(4, 400) + ODD
    want = brute_negatives(rows)
    assert len(want) > 500 and negatives(frame(spark, rows)) == want


def test_hard_negatives_in_many_rounds_and_groups(spark, monkeypatch):
    for name, value in (("GROUP", 7), ("ROUND", 20)):
        monkeypatch.setattr(N, name, value)
    rows = [(100 * i, v, y) for i, (_, v, y) in enumerate(clusters(5, 60))]
    assert negatives(frame(spark, rows)) == brute_negatives(rows)


def test_hard_negatives_empty(spark):
    assert negatives(frame(spark, [])) == [] and negatives(frame(spark, [(100, [1.0], 1)])) == []


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 30), st.integers(1, 50), st.integers(1, 5))
def test_bounds_hold(seed, n, m, dim):
    """Known scores are exact, and no score within a window stays unknown."""
    rng = np.random.default_rng(seed)
    centre = rng.integers(-300, 300, dim)
    anchors = (centre + rng.integers(-3, 4, (n, dim))).astype(float)
    x = rng.integers(-300, 300, (m, dim)).astype(float)
    group = N.spanning_tree(np.arange(n), np.zeros(n, int), anchors)
    assert sorted(group.ids) == list(range(n)) and all(group.parent[k] < k for k in range(1, n))
    least, most = sorted(rng.integers(-10**5, 10**5, 2))
    scores, known = N.bounded_scores(group, x, lambda members, low, high: (high >= least) & (low <= most))
    exact = group.points @ x.T
    assert (scores[known] == exact[known]).all()
    assert known[(exact >= least) & (exact <= most)].all()


def test_bounds_spare_work():
    rng = np.random.default_rng(0)
    centre = 200 * rng.normal(size=32)
    group = N.spanning_tree(np.arange(50), np.zeros(50, int), np.floor(centre + rng.normal(size=(50, 32))))
    x = np.floor(200 * rng.normal(size=(1000, 32)))
    best = np.sort(group.points[0] @ x.T)[-20]
    _, known = N.bounded_scores(group, x, lambda members, low, high: high >= best)
    assert known[1:].mean() < 0.2


def test_large_components():
    a, x = np.array([[2.0**40, 1.0]]), np.array([[2.0**40, 3.0], [1.0, 2.0]])
    assert N.products(a, x).tolist() == [[2**63 - 1, 2**40 + 2]]


@pytest.mark.parametrize("size", [1, 3])
def test_best_keeps_ties_by_id(size):
    best = N.Best(1, size)
    scores, ids = np.array([[5.0] * 40]), np.arange(40)[::-1]
    best.add_all(np.ones((1, 40), bool), scores, ids, np.array([0]))
    best.add_all(np.ones((1, 1), bool), np.array([[6.0]]), np.array([99]), np.array([0]))
    assert best.rows[0] == [(-6, 99), (-5, 0), (-5, 1)][:size]
