"""Hard negatives by bounds along spanning trees of anchors.

Scores are inner products. In a group of anchors that lie close together, the root's scores
are worked out for every candidate. Along an edge of the group's minimum spanning tree a score
changes by at most the edge's length times the candidate's norm (Cauchy-Schwarz), which bounds
the scores at the child by those at the parent. Only candidates whose bounds overlap a window
that is still open are scored there; the others pass their bounds on.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilframe.llm.common import materialise, pieces
from veilframe.llm.vectors import MATRIX_ROWS, matrices, ranked

SCALE = 256
#: Ids of anchors are divisible by ANCHOR_STEP; labels are shifted where ids are by SHIFT_STEP.
ANCHOR_STEP, SHIFT_STEP, LABELS = 100, 7, 10
POSITIVES, NEGATIVES = 5, 10
#: Window of a negative's score in percent of its positive's.
LOWEST, HIGHEST = 30, 90
#: Anchors of a spanning tree, and anchors (or bytes of them) that are sent out at once.
GROUP, ROUND, ROUND_BYTES = 512, 8192, 32 << 20
#: Sign bits of the order in which anchors are put into groups.
ORDER_BITS = 16
EXACT = float(1 << 53)
LONG = (1 << 63) - 1
#: A share of candidates from which a dense product is cheaper than picking rows.
DENSE = 0.1


@dataclass
class Group:
    """Anchors of one vector length in the order of their spanning tree, parents first."""

    ids: np.ndarray
    labels: np.ndarray
    points: np.ndarray          # whole numbers as double, or Python ints where these do not fit
    parent: np.ndarray
    edge: np.ndarray
    depth: list                 # members of each depth of the tree


def spanning_tree(ids, labels, points) -> Group:
    """Prim's tree over the distances of the anchors."""
    n = len(ids)
    with np.errstate(over="ignore", invalid="ignore"):
        square = np.einsum("ij,ij->i", points, points)
        apart = np.sqrt(np.maximum(square[:, None] + square - 2 * points @ points.T, 0))
    apart = np.nan_to_num(apart, nan=np.inf, posinf=np.inf)
    order, parent = [0], np.zeros(n, np.int64)
    to_tree, from_node = apart[0].copy(), np.zeros(n, np.int64)
    out = np.zeros(n, bool)
    out[0] = True
    for _ in range(n - 1):
        nearest = int(np.where(out, np.inf, to_tree).argmin())
        if out[nearest]:
            nearest = int(np.flatnonzero(~out)[0])
        out[nearest] = True
        parent[nearest] = from_node[nearest]
        order.append(nearest)
        closer = apart[nearest] < to_tree
        to_tree[closer], from_node[closer] = apart[nearest][closer], nearest
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    up = place[parent[order]]
    difference = points[order] - points[np.array(order)[up]]
    with np.errstate(over="ignore"):
        edge = np.sqrt(np.einsum("ij,ij->i", difference, difference))
    level = np.zeros(n, np.int64)
    for k in range(1, n):
        level[k] = level[up[k]] + 1
    return Group(np.asarray(ids)[order], np.asarray(labels)[order], points[order], up, edge,
                 [np.flatnonzero(level == d) for d in range(level.max() + 1)])


def products(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers; what does not fit a long is cut to its ends."""
    most = (np.abs(a).max(initial=0.0) * np.abs(x).max(initial=0.0)) * max(a.shape[1], 1)
    if most < EXACT:
        return (a @ x.T)
    whole = [[int(v) for v in row] for row in x]
    out = [[min(max(sum(p * q for p, q in zip(row, other, strict=True)), -LONG - 1), LONG) for other in whole]
           for row in ([int(v) for v in r] for r in a)]
    return np.array(out, object).reshape(len(a), len(x))


def bounded_scores(group: Group, x: np.ndarray, overlaps) -> tuple[np.ndarray, np.ndarray]:
    """``(scores, known)`` of a group against candidates; a score is only known where needed.

    ``overlaps(members, low, high)`` tells for which candidates the bounds meet an open window.
    """
    n, m = len(group.ids), len(x)
    largest = np.abs(group.points).max(initial=0.0) * np.abs(x).max(initial=0.0) * max(x.shape[1], 1)
    if not largest < EXACT:
        return products(group.points, x), np.ones((n, m), bool)
    norm = np.sqrt(np.einsum("ij,ij->i", x, x))
    low, high, known = np.empty((n, m)), np.empty((n, m)), np.zeros((n, m), bool)
    for members in group.depth:
        if members[0] == 0:
            need = np.ones((1, m), bool)
        else:
            slack = group.edge[members, None] * norm * (1 + 1e-9) + 1e-3
            low[members] = low[group.parent[members]] - slack
            high[members] = high[group.parent[members]] + slack
            need = overlaps(members, low[members], high[members])
        share = need.mean(axis=1)
        dense = members[share > DENSE]
        if len(dense):
            low[dense] = high[dense] = group.points[dense] @ x.T
            known[dense] = True
        for k in np.flatnonzero((share > 0) & (share <= DENSE)):
            some = np.flatnonzero(need[k])
            low[members[k], some] = high[members[k], some] = x[some] @ group.points[members[k]]
            known[members[k], some] = True
    return low, known


class Best:
    """The best rows of each slot: highest scores first, ties by smaller id."""

    def __init__(self, slots: int, size: int):
        self.size = size
        self.rows: list[list[tuple[int, int]]] = [[] for _ in range(slots)]
        self.worst = np.full(slots, -np.inf)

    def add(self, slot: int, scores, ids) -> None:
        found = self.rows[slot] + [(-int(s), int(i)) for s, i in zip(scores, ids, strict=True)]
        found.sort()
        self.rows[slot] = found[:self.size]
        if len(found) >= self.size:
            self.worst[slot] = -self.rows[slot][-1][0]

    def add_all(self, picked: np.ndarray, scores: np.ndarray, ids: np.ndarray, slots: np.ndarray) -> None:
        """Add the picked cells of a score matrix; row k goes to ``slots[k]``."""
        for k in np.flatnonzero(picked.any(axis=1)):
            at = np.flatnonzero(picked[k])
            if len(at) > 4 * self.size and scores.dtype != object:
                cut = np.partition(scores[k, at], len(at) - self.size)[len(at) - self.size]
                at = at[scores[k, at] >= cut]
                if len(at) > 4 * self.size:       # many equal scores: the smallest ids of them
                    at = at[np.lexsort((ids[at], -scores[k, at]))[:self.size]]
            self.add(slots[k], scores[k, at], ids[at])


def _usable(df: DataFrame, vec_id: str, vector: str, label: str) -> DataFrame:
    """``vec_id, label, embedding`` of the rows that may take part, labels shifted."""
    shifted = F.when(F.col("vec_id") % SHIFT_STEP == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label"))
    return (df.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(label).cast("bigint").alias("label"),
                      F.col(vector).alias("embedding"))
            .filter("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL")
            .select("vec_id", shifted.alias("label"), "embedding"))


def _whole(part: pa.RecordBatch):
    """``(ids, labels, points)`` of each vector length in a batch, points as whole numbers."""
    ids, labels = part.column("vec_id").to_numpy(), part.column("label").to_numpy()
    for rows, matrix in matrices(part.column("embedding")):
        with np.errstate(over="ignore"):
            points = np.floor(SCALE * matrix)
        fits = np.isfinite(points).all(axis=1)
        yield ids[rows[fits]], labels[rows[fits]], points[fits]


def _anchors(rows: DataFrame) -> DataFrame:
    """One row per anchor id, ordered so that close vectors are neighbours."""
    def run(batches):
        for batch in batches:
            for part in pieces(batch, MATRIX_ROWS):
                for ids, labels, points in _whole(part):
                    bits = points[:, :ORDER_BITS] >= 0
                    code = bits @ (1 << np.arange(bits.shape[1], dtype=np.int64)[::-1])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids), pa.array(labels), pa.array(np.full(len(ids), points.shape[1], np.int64)),
                         pa.array(code.astype(np.int64)), pa.array(list(points), pa.list_(pa.float64()))],
                        names=["vec_id", "label", "dim", "code", "point"])

    kept = rows.filter(f"vec_id % {ANCHOR_STEP} = 0").mapInArrow(
        run, "vec_id bigint, label bigint, dim bigint, code bigint, point array<double>")
    least = F.min(F.struct("dim", "code", "label", "point")).alias("a")
    return kept.groupBy("vec_id").agg(least).select("vec_id", "a.*")


def _groups(anchors: DataFrame, first: int, after: int) -> list[Group]:
    """Spanning trees of one round's anchors; a round is bounded, so it is worked out on the driver."""
    table = anchors.filter(F.col("rank").between(first, after - 1)).orderBy("rank").toArrow()
    dims = table.column("dim").to_numpy()
    ids, labels = table.column("vec_id").to_numpy(), table.column("label").to_numpy()
    points = table.column("point")
    out = []
    for dim in np.unique(dims):
        rows = np.flatnonzero(dims == dim)
        for at in range(0, len(rows), GROUP):
            some = rows[at:at + GROUP]
            matrix = np.array(points.take(pa.array(some)).to_pylist(), np.float64).reshape(len(some), int(dim))
            out.append(spanning_tree(ids[some], labels[some], matrix))
    return out


def _found(rows: DataFrame, scan) -> DataFrame:
    """``anchor_id, slot, id, score`` that ``scan`` keeps of each partition."""
    def run(batches):
        state = scan()
        for batch in batches:
            for part in pieces(batch, MATRIX_ROWS):
                for block in _whole(part):
                    state.take(*block)
        yield from state.result()

    return rows.mapInArrow(run, "anchor_id bigint, slot int, id bigint, score bigint")


class _Scan:
    """Best rows of every anchor of a round over the candidates of one task."""

    def __init__(self, groups: list[Group], slots: int, size: int):
        self.groups, self.slots = groups, slots
        self.best = [Best(len(g.ids) * slots, size) for g in groups]

    def result(self):
        for g, best in zip(self.groups, self.best, strict=True):
            flat = [(int(g.ids[k // self.slots]), k % self.slots, i, -s)
                    for k, kept in enumerate(best.rows) for s, i in kept]
            columns = list(zip(*flat, strict=True)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64()),
                                                strict=True)],
                names=["anchor_id", "slot", "id", "score"])


class _Positives(_Scan):
    """The highest scores of other rows with the anchor's label."""

    def __init__(self, groups):
        super().__init__(groups, 1, POSITIVES)

    def take(self, ids, labels, x):
        for g, best in zip(self.groups, self.best, strict=True):
            if g.points.shape[1] != x.shape[1]:
                continue
            fits = (g.labels[:, None] == labels) & (g.ids[:, None] != ids)

            def overlaps(members, low, high, best=best, fits=fits):
                return fits[members] & (high >= best.worst[members, None])

            scores, known = bounded_scores(g, x, overlaps)
            picked = known & fits
            if scores.dtype != object:
                picked &= scores >= best.worst[:, None]
            best.add_all(picked, scores, ids, np.arange(len(g.ids)))


class _Negatives(_Scan):
    """The highest scores of other labels within the window of each positive."""

    def __init__(self, groups, windows):
        super().__init__(groups, POSITIVES, NEGATIVES)
        self.windows = windows

    def take(self, ids, labels, x):
        for g, best, (least, most) in zip(self.groups, self.best, self.windows, strict=True):
            if g.points.shape[1] != x.shape[1]:
                continue
            fits = g.labels[:, None] != labels
            worst = best.worst.reshape(len(g.ids), POSITIVES)
            floor = np.maximum(least.astype(float), worst)

            def overlaps(members, low, high, floor=floor, most=most, fits=fits):
                hit = np.zeros(low.shape, bool)
                for k in range(POSITIVES):
                    hit |= (high >= floor[members, k, None]) & (low <= most[members, k, None].astype(float))
                return hit & fits[members]

            scores, known = bounded_scores(g, x, overlaps)
            known &= fits
            if not known.any():
                continue
            for k in range(POSITIVES):
                picked = known & (scores >= least[:, k, None]).astype(bool) & (scores <= most[:, k, None]).astype(bool)
                if scores.dtype != object:
                    picked &= scores >= worst[:, k, None]
                best.add_all(picked, scores, ids, np.arange(len(g.ids)) * POSITIVES + k)


def _first(found: DataFrame, keys: list[str], size: int) -> DataFrame:
    """The first ``size`` rows per key over all tasks, each of which sent at most as many."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "id")
    return found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= size)


def _windows(groups: list[Group], positives: list) -> list:
    """Per group the lowest and highest negative score for each positive; no positive, no window."""
    at = {int(i): (n, k) for n, g in enumerate(groups) for k, i in enumerate(g.ids)}
    out = [(np.full((len(g.ids), POSITIVES), 1, object), np.full((len(g.ids), POSITIVES), 0, object))
           for g in groups]
    for row in positives:
        n, k = at[row["anchor_id"]]
        score = row["score"]
        out[n][0][k, row["place"] - 1] = -(-LOWEST * score // 100)
        out[n][1][k, row["place"] - 1] = HIGHEST * score // 100
    top = float(1 << 62)
    if all(abs(v) < top for pair in out for side in pair for v in side.flat):
        out = [(a.astype(np.int64), b.astype(np.int64)) for a, b in out]
    return out


def hard_negatives(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding",
                   label: str = "label") -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Anchors are rows whose id is divisible by ANCHOR_STEP. Each component becomes
    floor(SCALE * x), and a score is the exact inner product of these. An anchor's positives
    are its first POSITIVES rows of its label, the highest scores first, ties by smaller id;
    for each, the first NEGATIVES rows of other labels within its window are returned.

    Anchors are sent to the executors in rounds of at most ROUND anchors and ROUND_BYTES, and
    each round scans the table twice, for positives and for negatives; only the best rows of
    each task are shuffled. Every row of the table meets every anchor.

    Rows with a null id, label or vector, or a component that is null or not finite (also after
    scaling), take no part. Vectors of different lengths do not meet. A row is never positive of
    an anchor of its own id; other rows that repeat an id or a whole row count each. Of anchors
    that share an id the least by length, order code, label and vector is taken. Scores beyond a
    long are cut to its ends. An anchor without positives, a positive without negatives and an
    empty table give no rows; other columns are ignored.
    """
    rows = _usable(df, vec_id, vector, label)
    anchors = materialise(ranked(_anchors(rows), "dim", "code", "vec_id"))
    many, wide = anchors.agg(F.count(F.lit(1)), F.max("dim")).first()
    step = max(1, min(ROUND, ROUND_BYTES // (8 * max(wide or 1, 1))))
    parts = []
    for first in range(0, many, step):
        groups = _groups(anchors, first, first + step)
        found = _first(_found(rows, lambda groups=groups: _Positives(groups)), ["anchor_id"], POSITIVES)
        positives = materialise(found.select("anchor_id", "place", F.col("id").alias("positive_id"),
                                             F.col("score").alias("positive_score")))
        windows = _windows(groups, positives.select(
            "anchor_id", "place", F.col("positive_score").alias("score")).collect())
        near = _found(rows, lambda groups=groups, windows=windows: _Negatives(groups, windows))
        best = _first(near.withColumn("slot", F.col("slot") + 1), ["anchor_id", "slot"], NEGATIVES)
        joined = best.select("anchor_id", F.col("slot").alias("place"), F.col("place").alias("rank"),
                             F.col("id").alias("negative_id"), F.col("score").alias("negative_score")).join(
            positives, ["anchor_id", "place"])
        parts.append(materialise(joined) if many > step else joined)
    out = parts[0] if parts else df.sparkSession.createDataFrame(
        [], "anchor_id bigint, place int, rank int, negative_id bigint, negative_score bigint, "
            "positive_id bigint, positive_score bigint")
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id",
                      "positive_score", "negative_score")


#: The same rows for DuckDB.
SQL = f"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % {SHIFT_STEP} = 0 THEN (CAST(label AS BIGINT) + 1) % {LABELS} ELSE label END
    AS label, list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS e
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same,
    CAST(list_dot_product(a.e, b.e) AS BIGINT) AS score
  FROM v AS a JOIN v AS b ON a.vec_id % {ANCHOR_STEP} = 0 AND a.vec_id <> b.vec_id),
p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= {POSITIVES})
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id
    ORDER BY score DESC, id) AS INTEGER) AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same
  AND {LOWEST} * positive_score <= 100 * score AND 100 * score <= {HIGHEST} * positive_score
QUALIFY rank <= {NEGATIVES}"""
