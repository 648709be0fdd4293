"""Near-duplicate vectors by cosine: dual traversal of cover trees.

Unit vectors are as far apart as sqrt(2 - 2 cos), so "cosine of at least c" is a ball of fixed
radius. The vectors are ordered along a small tree of pivots and cut into blocks; each block
gets a cover tree, whose levels are nested nets with halving radii. Runs of blocks are
leaves of a wider tree, whose levels are tables. Two nodes are compared only while their
covering radii let them hold a pair within the ball; two nodes that must link entirely are
counted as a whole, so a group of near copies is never written out as pairs.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import materialise, pieces
from veilframe.llm.graph import components
from veilframe.llm.vectors import MATRIX_ROWS, matrices, ranked
from veilframe.session import join_hot_split

THRESHOLD = 0.95
#: Vectors of a block, blocks of a run, and runs of a node one level up.
BLOCK, RUN, FAN_OUT = 1024, 8, 64
#: Vectors from which the pivots are made; they decide the order of the rows, not the result.
PIVOTS = 1024
#: Levels of a block's tree besides root and leaves: radii 1, 1/2, … 1/256.
LEVELS = 9
#: Rounding slack of distances, and of cosines in single precision.
SLACK, COARSE = 1e-6, 1e-5


def unit(matrix: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled by their largest component first, so nothing overflows."""
    scaled = matrix / np.abs(matrix).max(axis=1, keepdims=True)
    return scaled / np.sqrt(np.einsum("ij,ij->i", scaled, scaled))[:, None]


@dataclass
class Tree:
    """``node[i][x]``: centre, at level i, of the node that holds vector x;
    ``radius[i][c]``: distance from centre c to the farthest vector of its node, 0 elsewhere."""

    points: np.ndarray
    node: np.ndarray
    radius: np.ndarray


def cover_tree(points: np.ndarray) -> Tree:
    """Nested nets: each level splits the nodes of the one above into balls of half the radius.

    A node's centre stays a centre below; further centres are the vectors farthest from all
    centres so far, so centres of a level are more than its radius apart within a node.
    """
    m = len(points)
    near = np.sqrt(np.maximum(2.0 - 2.0 * (points @ points.T), 0.0))
    np.fill_diagonal(near, 0.0)
    nodes, radii = [np.zeros(m, np.int32)], [np.zeros(m)]
    radii[0][0] = near[0].max()
    for i in range(LEVELS):
        above, reach = nodes[-1], 2.0 ** -i
        below, radius = above.copy(), np.zeros(m)
        order = np.argsort(above, kind="stable")
        for group in np.split(order, np.flatnonzero(np.diff(above[order])) + 1):
            centre = above[group[0]]
            to_own, owner = near[centre, group], np.full(len(group), centre, np.int32)
            while to_own.max() > reach:
                far = group[to_own.argmax()]
                to_far = near[far, group]
                closer = to_far < to_own
                owner[closer], to_own = far, np.minimum(to_own, to_far)
            below[group] = owner
            np.maximum.at(radius, owner, to_own)
        nodes.append(below)
        radii.append(radius)
        if len(np.unique(below)) == m:
            break
    nodes.append(np.arange(m, dtype=np.int32))
    radii.append(np.zeros(m))
    return Tree(points, np.array(nodes, np.int32), np.array(radii))


def unite(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the sets of ``a[k]`` and ``b[k]``; ``parent`` points at each set's least member."""
    while len(a):
        a, b = parent[a], parent[b]
        apart = a != b
        a, b = a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(parent, up := parent[parent]):
            parent[:] = up


class Meeting:
    """Dual traversal of two blocks: link counts and joined sets of their vectors."""

    def __init__(self, cosine: float):
        self.cosine, self.ball = cosine, float(np.sqrt(2.0 - 2.0 * cosine))

    def meet(self, a: Tree, b: Tree, copies_a, copies_b, links_a, links_b, parent, at_a, at_b):
        """Add to ``links_a`` and ``links_b`` and unite in ``parent`` what links between the blocks.

        ``copies`` counts the rows of each vector, ``at`` is where the block lies in ``parent``.
        """
        thin_a, thin_b = a.points.astype(np.float32), b.points.astype(np.float32)
        ua, ub, alive = np.zeros(1, np.int64), np.zeros(1, np.int64), np.ones((1, 1), bool)
        last = max(len(a.node), len(b.node)) - 1
        for level in range(1, last + 1):
            la, lb = min(level, len(a.node) - 1), min(level, len(b.node) - 1)
            ca, up_a = self.children(a, level, ua)
            cb, up_b = self.children(b, level, ub)
            cos = thin_a[ca] @ thin_b[cb].T
            ra, rb = a.radius[la][ca], b.radius[lb][cb]
            wide_a, wide_b = ra > 0, rb > 0
            possible = cos >= self.cosine - COARSE
            if wide_a.any():
                possible[wide_a] = cos[wide_a] >= self.least(ra[wide_a, None] + rb)
            if wide_b.any():
                possible[:, wide_b] = cos[:, wide_b] >= self.least(ra[:, None] + rb[wide_b])
            if not alive.all():
                possible &= alive[up_a][:, up_b]
            x, y = np.divmod(np.flatnonzero(possible), len(cb))
            near = cos[x, y].astype(np.float64)
            both = ra[x] + rb[y]
            leaf = ~(wide_a[x] | wide_b[y])
            whole = leaf & (near >= self.cosine + COARSE)
            unsure = np.flatnonzero(leaf & ~whole)
            for part in np.array_split(unsure, len(unsure) // 65536 + 1):
                exact = np.einsum("ij,ij->i", a.points[ca[x[part]]], b.points[cb[y[part]]])
                whole[part] = exact >= self.cosine
            inner = self.ball - both - SLACK
            whole |= ~leaf & (inner > 0) & (near >= 1.0 - np.square(np.maximum(inner, 0)) / 2 + COARSE)
            if whole.any():
                self.link(a, b, la, lb, ca[x[whole]], cb[y[whole]], copies_a, copies_b,
                          links_a, links_b, parent, at_a, at_b)
            rest = ~leaf & ~whole
            if not rest.any():
                return
            ua, ia = np.unique(ca[x[rest]], return_inverse=True)
            ub, ib = np.unique(cb[y[rest]], return_inverse=True)
            alive = np.zeros((len(ua), len(ub)), bool)
            alive[ia, ib] = True

    def least(self, radii):
        """The cosine below which two nodes of these radii together cannot hold a link."""
        return (1.0 - np.square(np.minimum(self.ball + radii + SLACK, 2.0)) / 2 - COARSE).astype(np.float32)

    @staticmethod
    def children(tree: Tree, level: int, above: np.ndarray):
        """Centres at ``level`` below the nodes ``above`` of the level before, and the place of each
        one's parent there; leaves stay themselves when the other tree is deeper."""
        if level >= len(tree.node):
            return above, np.arange(len(above))
        centres = np.unique(tree.node[level])
        owner = tree.node[level - 1][centres]
        at = np.minimum(np.searchsorted(above, owner), len(above) - 1)
        mine = above[at] == owner
        return centres[mine], at[mine]

    @staticmethod
    def link(a, b, la, lb, x, y, copies_a, copies_b, links_a, links_b, parent, at_a, at_b):
        """All vectors of node x[k] link with all of node y[k]."""
        in_a, in_b = a.node[la], b.node[lb]
        weight_a = np.bincount(in_a, copies_a, len(in_a))
        weight_b = np.bincount(in_b, copies_b, len(in_b))
        links_a += np.bincount(x, weight_b[y], len(in_a))[in_a].astype(np.int64)
        if links_b is not None:
            links_b += np.bincount(y, weight_a[x], len(in_b))[in_b].astype(np.int64)
        for tree_node, centres, at in ((in_a, x, at_a), (in_b, y, at_b)):
            members = np.flatnonzero(np.isin(tree_node, centres))
            unite(parent, members + at, tree_node[members] + at)
        unite(parent, x + at_a, y + at_b)


# Spark -------------------------------------------------------------------------------

def _keyed(df: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """``vec_id, key, dim, vec``: key tells different vectors apart and is null for those that
    link with nothing."""
    single = dict(df.dtypes)[vector] == "array<float>"
    kind = np.dtype("<f4" if single else "<f8")

    def run(batches):
        for batch in batches:
            for part in pieces(batch, MATRIX_ROWS):
                keys, dims, blobs = ([None] * part.num_rows for _ in range(3))
                for rows, matrix in matrices(part.column(1)):
                    flat = np.ascontiguousarray(matrix + 0.0, kind)       # -0.0 becomes 0.0
                    for r, row in zip(rows[matrix.any(axis=1)], flat[matrix.any(axis=1)], strict=True):
                        blobs[r] = row.tobytes()
                        dims[r] = matrix.shape[1]
                        keys[r] = hashlib.blake2b(blobs[r], digest_size=16).hexdigest()
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(keys, pa.string()), pa.array(dims, pa.int32()),
                     pa.array(blobs, pa.binary())], names=["vec_id", "key", "dim", "vec"])

    kept = df.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(vector).alias("embedding"))
    return kept.mapInArrow(run, "vec_id bigint, key string, dim int, vec binary")


def _points(blobs, dim: int) -> np.ndarray:
    raw = b"".join(blobs)
    kind = "<f4" if len(raw) == 4 * dim * len(blobs) else "<f8"
    return unit(np.frombuffer(raw, kind).reshape(len(blobs), dim).astype(np.float64))


def _pivots(vectors: DataFrame) -> dict[int, np.ndarray]:
    """Per length, at most PIVOTS vectors in the depth-first order of their cover tree."""
    rows = vectors.orderBy("key").limit(PIVOTS).select("dim", "vec").collect()
    out = {}
    for dim in {r["dim"] for r in rows}:
        points = _points([r["vec"] for r in rows if r["dim"] == dim], dim)
        tree = cover_tree(points)
        out[dim] = points[np.lexsort(tree.node[::-1])]
    return out


def _placed(vectors: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """``vectors`` with the nearest pivot and the cosine to it."""
    def run(batches):
        for batch in batches:
            for part in pieces(batch, MATRIX_ROWS):
                cell, close = np.zeros(part.num_rows, np.int32), np.zeros(part.num_rows)
                dims = part.column("dim").to_numpy()
                blobs = part.column("vec").to_pylist()
                for dim in np.unique(dims):
                    if int(dim) in pivots:
                        rows = np.flatnonzero(dims == dim)
                        cos = _points([blobs[r] for r in rows], int(dim)) @ pivots[int(dim)].T
                        cell[rows] = cos.argmax(axis=1)
                        close[rows] = cos.max(axis=1)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell), pa.array(close)],
                                                 names=[*part.schema.names, "cell", "close"])

    return vectors.mapInArrow(run, "key string, dim int, vec binary, copies bigint, cell int, close double")


_BLOCKS = ("dim int, run bigint, block bigint, keys array<string>, copies array<bigint>, vecs array<binary>, "
           "depth int, node binary, radius binary, centre array<double>, reach double")


def _blocks(vectors: DataFrame) -> DataFrame:
    """A row per block with its tree, and the centre and covering radius of its run."""
    def run(key, table):
        dim, number = key[0].as_py(), key[1].as_py()
        table = table.sort_by("rank")
        points = _points(table.column("vec").to_pylist(), dim)
        centre = points.mean(axis=0)
        reach = float(np.sqrt(np.square(points - centre).sum(axis=1)).max())
        keys, copies = table.column("key").to_pylist(), table.column("copies").to_pylist()
        vecs = table.column("vec").to_pylist()
        rows = []
        for at in range(0, len(points), BLOCK):
            cut = slice(at, at + BLOCK)
            tree = cover_tree(points[cut])
            rows.append({"dim": dim, "run": number, "block": at // BLOCK, "keys": keys[cut],
                         "copies": copies[cut], "vecs": vecs[cut], "depth": len(tree.node),
                         "node": tree.node.astype("<i4").tobytes(),
                         "radius": tree.radius.astype("<f8").tobytes(),
                         "centre": centre.tolist(), "reach": reach})
        return pa.Table.from_pylist(rows, schema=_ARROW_BLOCKS)

    return (vectors.withColumn("run", F.expr(f"rank div {BLOCK * RUN}"))
            .groupBy("dim", "run").applyInArrow(run, _BLOCKS))


_ARROW_BLOCKS = pa.schema([
    ("dim", pa.int32()), ("run", pa.int64()), ("block", pa.int64()), ("keys", pa.list_(pa.string())),
    ("copies", pa.list_(pa.int64())), ("vecs", pa.list_(pa.binary())), ("depth", pa.int32()),
    ("node", pa.binary()), ("radius", pa.binary()), ("centre", pa.list_(pa.float64())), ("reach", pa.float64())])


def _upper(nodes: DataFrame) -> DataFrame:
    """The level above: FAN_OUT nodes in a row, centred at their mean."""
    def run(key, table):
        dim, number = key[0].as_py(), key[1].as_py()
        centres = np.array(table.column("centre").to_pylist(), np.float64)
        centre = centres.mean(axis=0)
        reach = np.sqrt(np.square(centres - centre).sum(axis=1)) + table.column("reach").to_numpy()
        return pa.table({"dim": pa.array([dim], pa.int32()), "id": pa.array([number], pa.int64()),
                         "centre": pa.array([centre.tolist()], pa.list_(pa.float64())),
                         "reach": pa.array([float(reach.max())])})

    return (nodes.withColumn("up", F.expr(f"id div {FAN_OUT}")).groupBy("dim", "up")
            .applyInArrow(run, "dim int, id bigint, centre array<double>, reach double"))


def _run_pairs(runs: DataFrame, last: int, ball: float) -> DataFrame:
    """``(dim, a, b)``, a <= b: runs that may hold a link, found from the top level down.

    Each level is an equi-join of the surviving pairs to their children on both sides, pruned by
    the covering radii.
    """
    levels = [runs]
    while last > 0:
        levels.append(materialise(_upper(levels[-1])))
        last //= FAN_OUT
    top = levels.pop()
    pairs = top.select("dim", F.col("id").alias("a"), F.col("id").alias("b"))
    while levels:
        below = levels.pop().withColumn("up", F.expr(f"id div {FAN_OUT}"))
        left = below.select("dim", F.col("up").alias("a"), F.col("id").alias("a2"),
                            F.col("centre").alias("ca"), F.col("reach").alias("ra"))
        right = below.select("dim", F.col("up").alias("b"), F.col("id").alias("b2"),
                             F.col("centre").alias("cb"), F.col("reach").alias("rb"))
        apart = "sqrt(aggregate(zip_with(ca, cb, (x, y) -> (x - y) * (x - y)), 0D, (s, v) -> s + v))"
        met = pairs.join(left, ["dim", "a"]).join(right, ["dim", "b"])
        pairs = materialise(met.filter("a2 <= b2").filter(f"{apart} <= ra + rb + {ball + SLACK!r}")
                            .select("dim", F.col("a2").alias("a"), F.col("b2").alias("b")))
    return pairs


def _links(blocks: DataFrame, pairs: DataFrame, cosine: float) -> DataFrame:
    """``(key, links, head)`` per vector and pair of runs: rows linked in the other run, and the
    first vector of its set there."""
    columns = ["keys", "copies", "vecs", "depth", "node", "radius"]

    def side(end: str) -> DataFrame:
        met = pairs if end == "a" else pairs.filter("a < b")
        # fresh names on both sides: a cogroup of one table with itself is ambiguous otherwise
        return met.join(blocks.withColumnRenamed("run", end), ["dim", end]).select(
            *[F.col(c).alias(c) for c in ("dim", "a", "b", "block", *columns)])

    def load(table):
        table = table.sort_by("block")
        out = []
        for row in table.to_pylist():
            points = _points(row["vecs"], row["dim"])
            shape = (row["depth"], len(points))
            out.append((row["keys"], np.array(row["copies"], np.float64),
                        Tree(points, np.frombuffer(row["node"], "<i4").reshape(shape),
                             np.frombuffer(row["radius"], "<f8").reshape(shape))))
        return out

    def run(left, right):
        mine = load(left)
        other = load(right)
        everyone = mine + other
        starts = np.cumsum([0] + [len(k) for k, _, _ in everyone])
        parent = np.arange(starts[-1])
        links = [np.zeros(len(k), np.int64) for k, _, _ in everyone]
        meeting = Meeting(cosine)
        n = len(mine)
        for i in range(n):
            for j in range(n, len(everyone)) if other else range(i, n):
                meeting.meet(everyone[i][2], everyone[j][2], everyone[i][1], everyone[j][1], links[i],
                             None if i == j else links[j], parent, starts[i], starts[j])
        keys = np.array([k for ks, _, _ in everyone for k in ks], object)
        count = np.concatenate(links)
        some = np.flatnonzero(count)
        return pa.table({"key": pa.array(keys[some], pa.string()), "links": pa.array(count[some]),
                         "head": pa.array(keys[parent[some]], pa.string())})

    return (side("a").groupBy("dim", "a", "b").cogroup(side("b").groupBy("dim", "a", "b"))
            .applyInArrow(run, "key string, links bigint, head string"))


def near_vectors(df: DataFrame, cosine: float = THRESHOLD, vec_id: str = "vec_id",
                 vector: str = "embedding") -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row: near-duplicate classes of vectors.

    Two rows link if the cosine of their vectors, in double precision, is at least ``cosine``
    (over 0). Equal vectors are one node of the trees with a count. Vectors that are null or
    zero, or that hold a null or non-finite component, link with nothing, and vectors of
    different lengths do not link with each other. Repeated ids are rows of their own; a row
    without an id links like any other, is never kept, and gives its component no id: a
    component without any id has a null one. An empty table gives no rows; other columns
    are ignored.
    """
    if not 0 < cosine <= 1:
        raise ValueError("the cosine must be over 0 and at most 1")
    keyed = _keyed(df, vec_id, vector)
    vectors = materialise(keyed.filter("key IS NOT NULL").groupBy("key").agg(
        F.first("dim").alias("dim"), F.first("vec").alias("vec"),
        F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("least")))
    pivots = _pivots(vectors)
    order = ranked(_placed(vectors.select("key", "dim", "vec", "copies"), pivots), "dim", "cell", "close", "key")
    blocks = materialise(_blocks(order))
    runs = blocks.filter("block = 0").select("dim", F.col("run").alias("id"), "centre", "reach")
    last = runs.agg(F.max("id")).first()[0]
    ball = float(np.sqrt(2.0 - 2.0 * cosine))
    pairs = _run_pairs(runs, last or 0, ball)
    found = materialise(_links(blocks, pairs, cosine))

    links = found.groupBy("key").agg(F.sum("links").alias("links"))
    sets = components(found.filter("key <> head").select(F.col("key").alias("a"), F.col("head").alias("b")))
    named = (sets.join(vectors.select(F.col("key").alias("node"), "least"), "node")
             .groupBy("component").agg(F.min("least").alias("lowest")))
    heads = sets.join(named, "component").select(F.col("node").alias("key"), "lowest")
    done = materialise(
        vectors.select("key", "copies", "least").join(links, "key", "left").join(
            heads.withColumn("_set", F.lit(True)), "key", "left")
        .select("key", "copies", F.coalesce(F.col("links") - 1, F.col("copies") - 1).alias("n_links"),
                F.when(F.col("_set"), F.col("lowest")).otherwise(F.col("least")).alias("lowest")))
    rows = join_hot_split(keyed.select("vec_id", "key"), done, "key", "copies")
    component = F.when(F.col("key").isNull(), F.col("vec_id")).otherwise(F.col("lowest"))
    return rows.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


#: The same rows for DuckDB: every pair compared, components by repeated reaching.
SQL = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, sqrt(list_sum(list_transform(embedding, lambda x:
    CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) AS norm FROM embeddings),
ok AS (SELECT * FROM v WHERE norm > 0 AND isfinite(norm) AND len(list_filter(e, lambda x: x IS NULL)) = 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok AS a JOIN ok AS b ON a.vec_id <> b.vec_id
    AND len(a.e) = len(b.e) AND list_dot_product(a.e, b.e) / (a.norm * b.norm) >= {THRESHOLD}),
reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings
  UNION SELECT r.a, l.b FROM reach AS r JOIN links AS l ON l.a = r.b),
counted AS (SELECT a, count(*) AS n FROM links GROUP BY a),
least AS (SELECT a, min(b) AS c FROM reach GROUP BY a)
SELECT v.vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, c AS component_id, v.vec_id = c AS kept
FROM v JOIN least ON least.a = v.vec_id LEFT JOIN counted ON counted.a = v.vec_id"""
