"""Toxicity: a factorisation machine over hashed terms.

A document is the set of its hashed terms: lower-case words and word stems (the first four
characters of longer words, so that unseen endings are still recognised). The model learns
a weight per term and a small vector per term whose products weigh pairs of terms, so two
terms may count together what neither counts alone.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import crc_mod, labelled, map_texts, utf8

#: Documented bounds of the fit: labelled rows used at most, and bytes of such a row's text.
#: Scoring has no such bound.
TRAIN_ROWS, TRAIN_BYTES = 6_000, 65_536
BUCKETS = 1 << 16
MIN_ROWS = 5
FACTORS = 4
EPOCHS = 10
#: ASCII characters other than letters and digits part words; all other characters belong to them.
PARTS = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256))
STEM = 4
CACHE = 200_000
#: Pairs without meaning that pass for telling ones, expected in a fit at most, and terms a
#: side when pairs are counted.
CHANCE_PAIRS, PAIR_BLOCK = 0.01, 1_000


@dataclass
class Machine:
    """Bias, weights and factors; only buckets with a learned weight are stored."""
    bias: float
    index: np.ndarray      # bucket -> row of w and v, or the last row, which is zero
    w: np.ndarray
    v: np.ndarray

    def logit(self, rows: np.ndarray) -> float:
        v = self.v[rows]
        sums = v.sum(axis=0)
        return float(self.bias + self.w[rows].sum() + 0.5 * (sums @ sums - (v * v).sum()))


def _term_ids(word: bytes) -> list[int]:
    ids = [xxhash.xxh32_intdigest(b"w" + word) % BUCKETS]
    if len(word) > STEM:
        stem = word.decode("utf-8", "replace")[:STEM]
        ids.append(xxhash.xxh32_intdigest(b"s" + stem.encode()) % BUCKETS)
    return ids


class Terms:
    """Distinct hashed terms of a text; words seen before are looked up, in bounded memory."""

    def __init__(self, row_of: np.ndarray | None = None):
        self.row_of = row_of
        self.none = None if row_of is None else int(row_of.max())
        self.seen: dict[bytes, tuple[int, ...]] = {}

    def of_word(self, word: bytes) -> tuple[int, ...]:
        ids = _term_ids(word)
        if self.row_of is not None:
            ids = [r for r in (int(self.row_of[i]) for i in ids) if r != self.none]
        if len(self.seen) >= CACHE:
            self.seen.clear()
        self.seen[word] = tuple(ids)
        return self.seen[word]

    def __call__(self, text: str | None) -> np.ndarray:
        out: set[int] = set()
        seen = self.seen
        for word in set(utf8((text or "").lower()).translate(PARTS).split()):
            ids = seen.get(word)
            if ids is None:
                ids = self.of_word(word)
            if ids:
                out.update(ids)
        return np.fromiter(out, dtype=np.int64, count=len(out))


def _sums(of: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Column sums of the rows of ``values`` by their group ``of``."""
    return np.stack([np.bincount(of, column, n) for column in values.T], axis=1)


def _in_pairs(sets: list[np.ndarray], y: np.ndarray, count: np.ndarray,
              ones: np.ndarray) -> np.ndarray:
    """Whether a bucket is in a pair whose share of ones is beyond those of both terms and of
    all rows, so far that among all pairs at most CHANCE_PAIRS would be by chance alone.

    A pair with k ones of n rows is as far from a share e by chance with at most
    exp(-n KL(k/n, e)) (Chernoff). The terms left out at first are in too few rows for any
    pair of theirs to get there. All others are met with each other, in blocks.
    """
    usual = count >= MIN_ROWS
    need = max(np.log(usual.sum() ** 2 / (2 * CHANCE_PAIRS)), 1.0) if usual.any() else 1.0
    share = y.mean()
    able = (ones * -np.log(share) >= need) | (count * -np.log1p(-share) >= need)
    terms = np.flatnonzero(usual & able)
    place = np.full(BUCKETS, -1)
    place[terms] = np.arange(terms.size)
    row = np.repeat(np.arange(len(sets)), [s.size for s in sets])
    column = place[np.concatenate(sets)]
    order = np.argsort(column, kind="stable")[np.count_nonzero(column < 0):]
    row, column = row[order], column[order]
    own = ones[terms] / count[terms]
    found = np.zeros(terms.size, dtype=bool)

    def dense(start: int) -> np.ndarray:
        low, high = np.searchsorted(column, [start, start + PAIR_BLOCK])
        block = np.zeros((len(sets), min(PAIR_BLOCK, terms.size - start)), dtype=np.float32)
        block[row[low:high], column[low:high] - start] = 1
        return block

    for i in range(0, terms.size, PAIR_BLOCK):
        left = dense(i)
        for j in range(i, terms.size, PAIR_BLOCK):
            right = left if i == j else dense(j)
            n, k = left.T @ right, left[y == 1].T @ right[y == 1]
            a, b = np.nonzero((n >= MIN_ROWS) & ((k * -np.log(share) >= need)
                                                 | ((n - k) * -np.log1p(-share) >= need)))
            n, k = n[a, b].astype(float), k[a, b].astype(float)
            sides = np.stack([own[i + a], own[j + b], np.full(a.size, share)])
            of = k / n
            e = np.clip(np.clip(of, sides.min(axis=0), sides.max(axis=0)), 1e-9, 1 - 1e-9)
            far = n * (of * np.log(np.maximum(of, 1e-300) / e)
                       + (1 - of) * np.log(np.maximum(1 - of, 1e-300) / (1 - e))) >= need
            far &= i + a != j + b
            found[i + a[far]] = found[j + b[far]] = True
    out = np.zeros(BUCKETS, dtype=bool)
    out[terms[found]] = True
    return out


def fit(rows: list[tuple[str | None, int]], seed: int = 7) -> Machine:
    """Fit on ``(text, label)`` rows by mini-batch gradient steps with per-weight rates.

    Rows without a text count as empty; without rows of both labels the machine answers
    with the share of ones (0 for no rows).
    """
    terms = Terms()
    sets = [terms(text) for text, _ in rows]
    y = np.array([label for _, label in rows], dtype=float)
    share = float(y.mean()) if y.size else 0.0
    base = float(np.log((share + 1e-3) / (1 - share + 1e-3)))
    empty = Machine(base, np.zeros(BUCKETS, np.int64), np.zeros(1), np.zeros((1, FACTORS)))
    if share in (0.0, 1.0):
        return empty
    count = np.bincount(np.concatenate(sets), minlength=BUCKETS)
    ones = np.bincount(np.concatenate([s for s, t in zip(sets, y, strict=True) if t]),
                       minlength=BUCKETS)
    # a term in at least MIN_ROWS rows whose share of ones, or that of a pair it is in, is
    # clearly not what it would be by chance
    spread = np.sqrt(share * (1 - share) / np.maximum(count, 1))
    telling = np.abs(ones / np.maximum(count, 1) - share) > 3 * spread
    kept = np.flatnonzero((count >= MIN_ROWS) & (telling | _in_pairs(sets, y, count, ones)))
    index = np.full(BUCKETS, kept.size, dtype=np.int64)
    index[kept] = np.arange(kept.size)
    sets = [np.sort(r[r < kept.size]) for r in (index[s] for s in sets)]
    sizes = np.array([r.size for r in sets])

    rng = np.random.default_rng(seed)
    bias, w = base, np.zeros(kept.size + 1)
    v = rng.normal(0, 0.02, (kept.size + 1, FACTORS))
    v[-1] = 0
    gw, gv, gb = np.full(w.size, 1e-6), np.full(v.shape, 1e-6), 1e-6
    rate, decay = 0.1, 1e-4
    weight = np.where(y == 1, 0.5 / share, 0.5 / (1 - share))
    for _ in range(EPOCHS):
        for start in range(0, len(rows), 64):
            batch = slice(start, min(start + 64, len(rows)))
            n = batch.stop - batch.start
            of = np.repeat(np.arange(n), sizes[batch])
            flat = np.concatenate(sets[batch])
            vr = v[flat]
            sums = _sums(of, vr, n)
            z = (bias + np.bincount(of, w[flat], n)
                 + 0.5 * ((sums * sums).sum(axis=1) - _sums(of, vr * vr, n).sum(axis=1)))
            g = weight[batch] * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[batch]) / n
            gb += g.sum() ** 2
            bias -= rate * g.sum() / np.sqrt(gb)
            if flat.size:
                at, place = np.unique(flat, return_inverse=True)
                gr = np.bincount(place, g[of], at.size) + decay * w[at]
                gw[at] += gr * gr
                w[at] -= rate * gr / np.sqrt(gw[at])
                gr = _sums(place, g[of, None] * (sums[of] - vr), at.size) + decay * v[at]
                gv[at] += gr * gr
                v[at] -= rate * gr / np.sqrt(gv[at])
    return Machine(bias, index, w, v)


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """At most TRAIN_ROWS labelled rows that are not held out, in the order of a hash of
    their id: every lang and source is met in its own share. Of the rows that repeat an id
    the one whose text has the smallest hash is taken; the others never reach the driver."""
    rows = labelled(docs, labels, "toxic", TRAIN_ROWS, crc_mod(F.col("doc_id"), 5) != 0)
    short = rows.filter(F.coalesce(F.octet_length("text"), F.lit(0)) <= TRAIN_BYTES)
    return short.groupBy("doc_id", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text"))


def train(docs: DataFrame, labels: DataFrame) -> Machine:
    rows = training_rows(docs, labels).select("doc_id", "text", "y").toPandas()
    rows = rows.sort_values(["doc_id", "text"]).sample(frac=1.0, random_state=3)
    return fit(list(zip(rows["text"], rows["y"].astype(int), strict=True)))


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``.

    The whole text is scored. Null and empty texts get the score of no terms, below 0.5
    unless ones prevail; repeated rows get equal scores; an empty table an empty result.
    """
    def make():
        terms = Terms(machine.index)

        def run(texts):
            z = np.array([machine.logit(terms(t)) for t in texts], dtype=float)
            return [(1 / (1 + np.exp(-np.clip(z, -30, 30))), pa.float64())]

        return run

    scored = map_texts(docs, ["doc_id"], "text", "score double", make)
    return scored.select("doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "score",
                         F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``score`` with a machine fitted on ``labels``. Labels that are null, of no document or of no id
    are not learned from; without any, every row gets 0. An empty table gives an empty result."""
    return score(docs, train(docs, labels))
