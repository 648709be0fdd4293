"""Quality rules: an isolation forest on rule statistics.

Every document becomes a few numbers (see ``FEATURES``). Random trees split the space of these
numbers at random places, as deep as a small sample of good rows reaches; a document that
ends after few splits, alone or where no good row is, is an anomaly. The path length below
which this holds is set where labelled rows of both kinds are told apart best, with good
rows weighing more.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import labelled, map_texts, pieces, utf8

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = b"#*$%&|<>"
WINDOW = 3
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
              "n_capitals", "n_lines")
#: Bounds of the fit, documented parameters: labelled rows used to grow the trees and to set
#: the threshold, trees, good rows per tree, splits on a path.
LABEL_ROWS, TREES, TREE_ROWS, MAX_DEPTH = 8_000, 100, 256, 40
#: A wrongly dropped good row counts as much as so many wrongly kept bad rows.
GOOD_WEIGHT = 5.0

_CAPITALS = bytes(range(65, 91))
_NOT_HEADS = bytes(range(128, 192))
_SPACE_BYTES = b" \t\n\x0b\x0c\r"


def _without(data: bytes, drop: bytes) -> int:
    return len(data) - len(data.translate(None, drop))


def statistics(text: str | None) -> tuple[int, ...]:
    """The STATISTICS of one text; all 0 for null and empty texts."""
    data = utf8(text) if text else b""
    words = data.split()
    n = len(words)
    if not n:
        return 0, 0, _without(data, SYMBOLS), 0, 0, 0, data.count(b"\n") + 1
    chars = len(data) - _without(data, _NOT_HEADS + _SPACE_BYTES)
    seen: set[bytes] = set()
    dups = 0
    for line in data.split(b"\n"):
        if line in seen:
            dups += 1
        elif line.strip():
            seen.add(line)
    return (n, chars, _without(data, SYMBOLS), dups, _repeat_words(words),
            _without(data, _CAPITALS), data.count(b"\n") + 1)


def _repeat_words(words: list[bytes]) -> int:
    """Words that lie in a window of three words which occurs at least twice."""
    grams = list(zip(words, words[1:], words[2:], strict=False))
    found = Counter(grams)
    if len(found) == len(grams):
        return 0
    covered = bytearray(len(words))
    for i, gram in enumerate(grams):
        if found[gram] > 1:
            covered[i:i + WINDOW] = b"\x01\x01\x01"
    return sum(covered)


#: What the forest sees, computed from the statistics; roots and logs stretch the low end,
#: where the shares of most documents lie.
FEATURES = ("word_length", "symbols", "repeats", "dup_lines", "capitals")


def features(stats: np.ndarray) -> np.ndarray:
    """``(rows, len(FEATURES))`` from rows of STATISTICS; no word gives zeros."""
    s = stats.astype(float)
    n = np.maximum(s[:, 0], 1)
    return np.column_stack([
        np.log1p(s[:, 1] / n), np.log1p(50 * s[:, 2] / n), np.sqrt(s[:, 4] / n),
        np.sqrt(s[:, 3] / np.maximum(s[:, 6], 1)), np.sqrt(s[:, 5] / np.maximum(s[:, 1], 1))])


def _mean_path(n: int) -> float:
    """Mean depth of an unsuccessful search among n rows, the usual correction of leaves."""
    if n < 2:
        return 0.0
    return 2.0 * (np.log(n - 1) + 0.5772156649) - 2.0 * (n - 1) / n


@dataclass
class Tree:
    feature: np.ndarray   # -1 for a leaf
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    depth: np.ndarray     # of a leaf, corrected by the rows that it holds

    def paths(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), dtype=np.int64)
        while True:
            f = self.feature[at]
            inner = f >= 0
            if not inner.any():
                return self.depth[at]
            lower = x[np.arange(len(x)), np.maximum(f, 0)] < self.cut[at]
            at = np.where(inner, np.where(lower, self.left[at], self.right[at]), at)


def _grow(x: np.ndarray, low: np.ndarray, high: np.ndarray, rng: np.random.Generator) -> Tree:
    """Random splits of the box ``low … high``, followed as long as a node holds rows."""
    nodes: list[list[float]] = []

    def grow(rows: np.ndarray, low: np.ndarray, high: np.ndarray, depth: int) -> int:
        me = len(nodes)
        nodes.append([-1, 0.0, 0, 0, depth + _mean_path(len(rows))])
        if len(rows) < 2 or depth >= MAX_DEPTH or not (wide := np.flatnonzero(high > low)).size:
            return me
        f = int(rng.choice(wide))
        cut = float(rng.uniform(low[f], high[f]))
        below = rows[:, f] < cut
        upper, lower = high.copy(), low.copy()
        upper[f] = lower[f] = cut
        nodes[me][:2] = [f, cut]
        nodes[me][2] = grow(rows[below], low, upper, depth + 1)
        nodes[me][3] = grow(rows[~below], lower, high, depth + 1)
        return me

    grow(x, low, high, 0)
    a = np.array(nodes)
    return Tree(a[:, 0].astype(np.int64), a[:, 1], a[:, 2].astype(np.int64),
                a[:, 3].astype(np.int64), a[:, 4])


@dataclass
class Forest:
    trees: list[Tree]
    threshold: float = -1.0

    def path(self, x: np.ndarray) -> np.ndarray:
        """Mean path length; short means isolated."""
        if not self.trees or not len(x):
            return np.full(len(x), np.inf)
        return sum(t.paths(x) for t in self.trees) / len(self.trees)


def fit(rows: np.ndarray, every: np.ndarray, seed: int = 11) -> Forest:
    """A forest over good rows of STATISTICS, in the box that ``every`` known row spans; no
    rows give a forest that isolates nothing."""
    x = features(rows) if len(rows) else np.empty((0, len(FEATURES)))
    box = features(every) if len(every) else x
    rng = np.random.default_rng(seed)
    trees = []
    for _ in range(TREES if len(x) else 0):
        pick = rng.choice(len(x), size=min(TREE_ROWS, len(x)), replace=False)
        trees.append(_grow(x[pick], box.min(0), box.max(0), rng))
    return Forest(trees)


def calibrate(forest: Forest, rows: np.ndarray, good: np.ndarray) -> Forest:
    """Set the threshold at which the fewest labelled rows, good ones weighing GOOD_WEIGHT,
    are on the wrong side. Without rows of both labels nothing is an anomaly."""
    if not len(rows) or good.all() or not good.any():
        return forest
    path = forest.path(features(rows))
    order = np.argsort(path, kind="stable")
    p, g = path[order], good[order].astype(float)
    lost = np.concatenate([[0.0], np.cumsum(g)]) * GOOD_WEIGHT
    missed = (1 - g).sum() - np.concatenate([[0.0], np.cumsum(1 - g)])
    cost = lost + missed
    usable = np.concatenate([[True], p[1:] > p[:-1], [True]])
    best = int(np.argmin(np.where(usable, cost, np.inf)))
    if best == 0:
        forest.threshold = -1.0
    else:
        forest.threshold = float(p[-1] + 1e-9 if best == len(p) else (p[best - 1] + p[best]) / 2)
    return forest


def _stats_of(rows: list) -> np.ndarray:
    return np.array([statistics(t) for t in rows], dtype=float).reshape(-1, len(STATISTICS))


def train(docs: DataFrame, labels: DataFrame) -> Forest:
    """Build the trees from labelled good rows and set the threshold with rows of both labels.

    At most LABEL_ROWS ids, the first by a hash, and one row of each: of an id on several rows
    that with the least statistics. Only these few numbers reach the driver.
    """
    rows = labelled(docs, labels, "quality", LABEL_ROWS)
    counted = map_texts(rows, ["doc_id", "y"], "text",
                        ",".join(f"{s} bigint" for s in STATISTICS), _stats_factory)
    one = (counted.groupBy("doc_id").agg(F.min(F.struct(*STATISTICS, "y")).alias("least"))
           .select("doc_id", "least.*"))
    got = one.toPandas().sort_values("doc_id")
    stats = got[list(STATISTICS)].to_numpy(dtype=float).reshape(-1, len(STATISTICS))
    good = got["y"].to_numpy() == 1
    usable = ~base_failed(stats)
    return calibrate(fit(stats[good & usable], stats[usable]), stats[usable], good[usable])


def _stats_factory():
    def run(texts):
        stats = [statistics(t) for t in texts]
        return [(list(c), pa.int64()) for c in zip(*stats, strict=True)] if stats else \
            [([], pa.int64()) for _ in STATISTICS]

    return run


def base_failed(stats: np.ndarray) -> np.ndarray:
    return (stats[:, 0] < MIN_WORDS) | (100 * stats[:, 4] > MAX_REPEAT_PERCENT * stats[:, 0])


def judge(docs: DataFrame, forest: Forest) -> DataFrame:
    """``doc_id``, the first five STATISTICS, ``base_failed``, ``path_length``, ``kept`` per row.

    Whole texts are read. Null and empty texts have no words and fail the base rules;
    repeated rows are judged alike; an empty table gives an empty result.
    """
    def make():
        def run(texts):
            stats = _stats_of(texts)
            path = forest.path(features(stats))
            failed = base_failed(stats)
            kept = ~failed & (path >= forest.threshold)
            first = [(stats[:, i].astype(np.int64), pa.int64()) for i in range(5)]
            return [*first, (failed, pa.bool_()), (path, pa.float64()), (kept, pa.bool_())]

        return run

    names = ",".join(f"{s} bigint" for s in STATISTICS[:5])
    return map_texts(docs, ["doc_id"], "text",
                     f"{names},base_failed boolean,path_length double,kept boolean", make)


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``judge`` with a forest that is fitted on the labelled rows of ``docs``. Without labels
    nothing is isolated; null and repeated ids, null texts and empty tables as in ``judge``."""
    return judge(docs, train(docs, labels))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the base rules and the forest keep; columns are unchanged.

    Null, empty and wordless texts go; repeated rows stay or go together, whatever their ids; an
    empty table stays empty.
    """
    forest = train(docs, labels)
    column = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            for part in pieces(batch):
                stats = _stats_of(part.column(column).to_pylist())
                kept = ~base_failed(stats) & (forest.path(features(stats)) >= forest.threshold)
                yield part.filter(pa.array(kept))

    return docs.mapInArrow(run, docs.schema)
