"""Find the values of a table anywhere inside texts, also glued to other letters.

A value is anchored by one of its minimisers. In a class, for values of at least L characters,
every run of W neighbouring grams (of K characters, K + W - 1 = L) selects its lowest hash; a
text that holds a value holds its runs, so it selects the same grams. Of a value's minimisers
the one that the fewest values share is its anchor, so values with a common beginning do not
meet each other's texts. Places that meet an anchor are compared character by character.

Values counted small go to the tasks, which then look at each text in place. Otherwise selected
grams and anchors are joined, and only texts in which an anchor was met are shuffled and compared.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilframe.session import (HOT_KEY_SHARE, join_checked, join_null_safe, packed, small_enough,
                               union_parts)

#: Length classes: shortest value, characters of a gram, grams of a run.
CLASSES = ((32, 17, 16), (16, 9, 8), (8, 5, 4), (4, 3, 2), (2, 2, 1), (1, 1, 1))
#: Values, and characters of them, that are sent to every task at most.
VALUE_LIMIT, CHAR_LIMIT = 100_000, 4_000_000
#: Characters that are looked at together; what a run can reach is added on both sides.
SEGMENT, REACH = 1 << 18, 64
FILTER_BITS = 20
FEW = 8
#: Longest value that goes to every task.
LONGEST = 1000
#: Longest value that is compared in a window of the text around its anchor.
WINDOW = 256
#: Copies of an anchor whose gram is known, or may be, in a large share of the places.
SALTS = 16
#: Column of a table of values that tells how often they occur, if it is known.
OCCURRENCES = "occurrences"
Occurrence = tuple[int, str, str | None]      # start, value, payload
#: Bits of the table of anchors that each task has, at most.
MOST_BITS = 1 << 28
_TURNS = tuple(map(np.uint64, (1, 11, 19, 29)))
#: Bits of that table for an anchor, of which each sets as many as there are turns.
ANCHOR_BITS = 32
_SEPARATOR = "\U0010ffff"
_BASE, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


_powers: list[np.ndarray] = []


def _powers_of_base(n: int) -> tuple[np.ndarray, np.ndarray]:
    """``_BASE`` and its inverse by 2**64, to the powers 0 to ``n - 1``."""
    if not _powers or len(_powers[0]) < n:
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        _powers[:] = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, b, np.uint64)]))
                      for b in (_BASE, inverse)]
    return _powers[0][:n], _powers[1][:n]


def gram_hashes(points: np.ndarray, k: int) -> np.ndarray:
    """A mixed 64-bit hash of every ``k`` neighbouring characters, from sums over the characters so far."""
    n = len(points) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    powers, inverses = _powers_of_base(len(points))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(points * inverses)])
    out = sums[k:] - sums[:-k]
    out *= powers[k - 1:]
    out ^= out >> np.uint64(31)
    out *= _MIX
    out ^= out >> np.uint64(29)
    return out


def _sliding(values: np.ndarray, width: int, combine) -> np.ndarray:
    """``combine`` over every ``width`` neighbours, by doubling."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = combine(out[:-step], out[step:])
        have += step
    return out


def selected(hashes: np.ndarray, run: int, allowed: np.ndarray | None = None) -> np.ndarray:
    """Which grams are the lowest of some run of ``run`` grams; equal ones all are.

    ``allowed`` tells which runs count, by their first gram.
    """
    if len(hashes) < run:
        return np.zeros(len(hashes), bool)
    lows = _sliding(hashes, run, np.minimum)
    seen = np.ones(len(lows), bool) if allowed is None else allowed
    none = np.zeros(run - 1, np.uint64)
    lows = np.concatenate([none, np.where(seen, lows, 0).astype(np.uint64), none])
    covered = np.concatenate([none, seen, none]).astype(bool)
    return (hashes == _sliding(lows, run, np.maximum)) & _sliding(covered, run, np.logical_or)


def minimisers(value: str) -> list[tuple[int, int, int]]:
    """``(class, gram, offset)`` of a value's selected grams in every class it is long enough for."""
    points, out = code_points(value), []
    for number, (least, k, run) in enumerate(CLASSES):
        if len(points) >= least:
            hashes = gram_hashes(points, k)
            at = np.flatnonzero(selected(hashes, run))
            out += [(number, g, o) for g, o in zip(hashes[at].view(np.int64).tolist(), at.tolist(), strict=True)]
    return out


def met_grams(text: str, k: int, run: int, likely) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``places, hashes`` of the selected grams that ``likely`` lets pass, a segment at a time."""
    for at in range(0, len(text), SEGMENT):
        low = max(at - REACH, 0)
        hashes = gram_hashes(code_points(text[low:at + SEGMENT + REACH]), k)
        near = np.flatnonzero(likely(hashes))
        near = near[(near + low >= at) & (near + low < at + SEGMENT)]
        if len(near):
            near = near[selected(hashes, run)[near]]
            yield near + low, hashes[near]


class Matcher:
    """All occurrences of a set of values in texts. ``entries`` are ``(value, class, gram, offset)``."""

    def __init__(self, entries: list[tuple[str, int, int, int]]):
        self.values = [e[0] for e in entries]
        classes: dict[int, list[tuple[int, int, int]]] = {}
        for n, (_, number, gram, offset) in enumerate(entries):
            classes.setdefault(number, []).append((gram, offset, n))
        self.tables = []
        for number, rows in classes.items():
            rows.sort()
            grams = np.array([r[0] for r in rows], np.int64).view(np.uint64)
            order = np.argsort(grams, kind="stable")
            table = np.zeros(1 << FILTER_BITS, bool)
            table[grams & np.uint64((1 << FILTER_BITS) - 1)] = True
            self.tables.append((CLASSES[number], np.packbits(table), grams[order],
                                np.array([rows[i][1:] for i in order], np.int64)))

    def find(self, texts: list[str]) -> Iterator[tuple[int, int, int]]:
        """``(text number, start, value number)`` of every occurrence, in no order."""
        lengths = np.array([len(t) for t in texts], np.int64) + 1
        starts = np.cumsum(lengths) - lengths
        joined = _SEPARATOR.join(texts)
        for (_, k, run), bits, grams, entries in self.tables:
            table = np.unpackbits(bits).view(bool)
            for places, hashes in met_grams(joined, k, run,
                                            lambda h, t=table: t[h & np.uint64((1 << FILTER_BITS) - 1)]):
                first = np.searchsorted(grams, hashes, "left")
                last = np.searchsorted(grams, hashes, "right")
                for place, a, b in zip(places.tolist(), first.tolist(), last.tolist(), strict=True):
                    for offset, n in entries[a:b].tolist():
                        number = int(np.searchsorted(starts, place, "right")) - 1
                        start = place - offset - int(starts[number])
                        if start >= 0 and texts[number].startswith(self.values[n], start):
                            yield number, start, n


def chosen(found: Iterable[Occurrence]) -> list[Occurrence]:
    """Occurrences that do not overlap, in text order: longer values first, then from the left.

    What is taken is never shorter than what is tried, so two places tell of any overlap.
    """
    found = sorted(found, key=lambda f: (-len(f[1]), f[0]))
    taken = bytearray(max((start + len(value) for start, value, _ in found), default=0))
    out = []
    for one in found:
        start, end = one[0], one[0] + len(one[1])
        if not taken[start] and not taken[end - 1]:
            taken[start:end] = b"\x01" * (end - start)
            out.append(one)
    return sorted(out)


def replaced(text: str, found: Iterable[Occurrence]) -> str:
    """The text with the chosen values replaced by their payloads."""
    pieces, at = [], 0
    for start, value, new in chosen(found):
        pieces += [text[at:start], new]
        at = start + len(value)
    return "".join([*pieces, text[at:]])


def values_in(text: str, found: Iterable[Occurrence]) -> list[str]:
    """The distinct values that occur."""
    return sorted({value for _, value, _ in found})


# Spark -------------------------------------------------------------------------------

def anchors(values: DataFrame, value: str, payload: str) -> DataFrame:
    """``value, payload, class, gram, offset``: each value with the minimiser that the fewest share.

    Long grams go before short ones while at most FEW values share them. Empty values are left out; of rows that repeat a value the lowest payload stays.
    Only the grams that more share are joined to the values' own. If these are many, a table of their bits tells in
    the tasks which grams are none of them, and a value goes on with the first such one alone.
    """
    def grams(free: AnchorBits | None):
        @F.pandas_udf("array<struct<class:int,gram:bigint,offset:int>>")
        def own(column: pd.Series) -> pd.Series:
            out: list[list] = [[] for _ in range(len(column))]
            for numbers, texts in _portions(column):
                rows = value_grams(texts)
                if free is not None:
                    rows = _first_free(rows, free)
                for owner, number, offset, gram in rows.tolist():
                    out[numbers[owner]].append({"class": number, "gram": gram, "offset": offset})
            return pd.Series(out, dtype=object)
        return own

    def exploded(free: AnchorBits | None = None) -> DataFrame:
        return distinct.select("value", "payload", F.explode(grams(free)("value")).alias("m")).select(
            "value", "payload", "m.*")

    distinct = (values.select(F.col(value).alias("value"), F.col(payload).alias("payload"))
                .filter("length(value) > 0").groupBy("value").agg(F.min("payload").alias("payload")))
    shared = packed(exploded().groupBy("class", "gram").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > FEW))
    best = F.min(F.struct(F.coalesce("n", F.lit(FEW)).alias("n"), "class", "offset", "gram", "payload")).alias("m")
    few = small_enough(shared)
    rows = exploded(None if few else anchor_bits(shared))
    return (join_checked(rows, shared, ["class", "gram"], small=few).groupBy("value").agg(best)
            .select("value", "m.payload", "m.class", "m.gram", "m.offset"))


def _first_free(rows: np.ndarray, shared: AnchorBits) -> np.ndarray:
    """``value_grams`` with the first gram alone that is not in ``shared``, of values that have one."""
    free = np.zeros(len(rows), bool)
    for number in range(len(CLASSES)):
        own = np.flatnonzero(rows[:, 1] == number)
        free[own] = ~shared.has(rows[own, 3].view(np.uint64), number)
    kept = rows[free]
    kept = kept[np.lexsort(kept[:, ::-1].T)]
    first = kept[np.concatenate([[True], kept[1:, 0] != kept[:-1, 0]])] if len(kept) else kept
    return np.concatenate([first, rows[~np.isin(rows[:, 0], first[:, 0])]])


def few_values(values: DataFrame, value: str, payload: str) -> list[tuple[str, str | None]] | None:
    """Distinct values with their lowest payloads, or None if there are too many for every task.

    The table is read once; at most VALUE_LIMIT + 1 values of bounded length reach the driver.
    """
    rows = (values.filter(F.length(value) > 0).groupBy(F.col(value).alias("value"))
            .agg(F.min(payload).alias("payload")).limit(VALUE_LIMIT + 1)
            .select(F.when(F.length("value") <= LONGEST, F.col("value")), "payload").collect())
    if len(rows) > VALUE_LIMIT or any(r[0] is None for r in rows) or sum(len(r[0]) for r in rows) > CHAR_LIMIT:
        return None
    return [tuple(r) for r in rows]


def value_grams(values: list[str]) -> np.ndarray:
    """Rows ``owner, class, offset, gram`` of all values' minimisers.

    Of values of two characters or more no single character is rarer than a pair with it, so
    single characters are left out there.
    """
    lengths = np.array([len(v) for v in values], np.int64)
    starts = np.cumsum(lengths + 1) - lengths - 1
    owner = np.repeat(np.arange(len(values)), lengths + 1)
    owner[starts + lengths] = -1                          # separators
    points = code_points(_SEPARATOR.join([*values, ""]))
    found = [np.zeros((0, 4), np.int64)]
    for number, (least, k, run) in enumerate(CLASSES):
        hashes = gram_hashes(points, k)
        if len(hashes) < run:
            continue
        inside = (owner[:len(owner) - least + 1] >= 0) & (owner[:len(owner) - least + 1] == owner[least - 1:])
        if least == 1:
            inside &= lengths[owner] == 1
        at = np.flatnonzero(selected(hashes, run, inside))
        found.append(np.stack([owner[at], np.full(len(at), number), at - starts[owner[at]],
                               hashes[at].view(np.int64)], axis=1))
    return np.concatenate(found)


def anchored(values: list[str]) -> list[tuple[str, int, int, int]]:
    """``anchors`` of few values: ``(value, class, gram, offset)``."""
    if not values:
        return []
    rows = value_grams(values)
    shared = np.zeros(len(rows), np.int64)
    for number in range(len(CLASSES)):
        own = rows[:, 1] == number
        _, which, counts = np.unique(rows[own, 3], return_inverse=True, return_counts=True)
        shared[own] = counts[which]
    table = np.column_stack([rows[:, 0], np.maximum(shared, FEW), rows[:, 1:]])
    table = table[np.lexsort(table[:, 3::-1].T)]
    first = np.concatenate([[True], table[1:, 0] != table[:-1, 0]])
    return [(values[v], c, g, o) for v, _, c, o, g in table[first].tolist()]


def with_occurrences(df: DataFrame, text: str, values: DataFrame, value: str, payload: str,
                     finish: Callable[[str, list[Occurrence]], object], kind: str, name: str, nothing: Column) -> DataFrame:
    """Add ``name``: what ``finish`` makes of a text and the occurrences in it; null for a null text.

    Every row is looked at by itself, so keys play no part and may be null or repeated. With
    few values nothing is shuffled. ``nothing`` is what a text without occurrences gives.
    """
    few = few_values(values, value, payload)
    if few is None:
        return _joined(df, text, values, value, payload, finish, kind, name, nothing)
    # called nondeterministic, it is not pushed into a union, where Spark 4.1 fails to extract it
    return df.withColumn(name, _in_place(few, finish, kind).asNondeterministic()(F.col(text)))


def row_values(df: DataFrame, keys: list[str], text: str, values: DataFrame, value: str) -> DataFrame:
    """``(*keys, value)``: each value that occurs in the text of a row, once a row.

    Many values are compared in the characters around each anchor, which are all that is shuffled of a text.
    """
    few = few_values(values, value, value)
    if few is not None:
        work = _in_place(few, values_in, "array<string>").asNondeterministic()
        return df.select(*keys, work(F.col(text)).alias("_values")).select(*keys, F.explode("_values").alias(value))
    table = packed(anchors(values, value, value).drop("payload"), "value").withColumn("payload", F.col("value"))
    around = _around(table)
    if None in around.values():
        found = _joined(df.select(*keys, F.col(text).alias("_whole")), "_whole", values, value, value, values_in,
                        "array<string>", "_values", F.expr("cast(array() AS array<string>)"))
        return found.select(*keys, F.explode("_values").alias(value))
    own = [f"_key{k}" for k in range(len(keys))]
    rows = df.select(F.monotonically_increasing_id().alias("_row"), *[F.col(k).alias(o) for k, o in zip(keys, own, strict=True)],
                     F.col(text).alias("_text"))
    met = _places(rows, table, around, hot_grams(values, value))
    return met.select("_row", *own, F.col("value").alias("_value")).distinct().select(
        *[F.col(o).alias(k) for k, o in zip(keys, own, strict=True)], F.col("_value").alias(value))


def _in_place(rows: list[tuple], finish, kind: str):
    matcher = Matcher(anchored([v for v, _ in rows]))
    known = dict(rows)
    payloads = [known[v] for v in matcher.values]

    @F.pandas_udf(kind)
    def work(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for column in batches:
            out: list = [None] * len(column)
            for numbers, texts in _portions(column):
                found: list[list] = [[] for _ in texts]
                for k, start, n in matcher.find(texts):
                    found[k].append((start, matcher.values[n], payloads[n]))
                for number, whole, occurrences in zip(numbers, texts, found, strict=True):
                    out[number] = finish(whole, occurrences)
            yield pd.Series(out, dtype=object)

    return work


def _portions(column: pd.Series) -> Iterator[tuple[list[int], list[str]]]:
    """Texts that are not null in portions of about SEGMENT characters."""
    numbers, texts, size = [], [], 0
    for k, whole in enumerate(column):
        if whole is None:
            continue
        numbers.append(k)
        texts.append(whole)
        size += len(whole)
        if size >= SEGMENT:
            yield numbers, texts
            numbers, texts, size = [], [], 0
    if texts:
        yield numbers, texts


@dataclass(frozen=True)
class AnchorBits:
    """Some bits for each anchor, in a table of at most MOST_BITS; what lacks one of them is none."""

    classes: list[int]
    words: np.ndarray

    def has(self, hashes: np.ndarray, number: int) -> np.ndarray:
        size = np.uint64(len(self.words) * 64)
        met = np.ones(len(hashes), bool)
        for turn in _TURNS:
            at = np.flatnonzero(met)
            bit = ((hashes[at] >> turn) + np.uint64(number)) % size
            met[at] = (self.words[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1) == 1
        return met


def anchor_bits(table: DataFrame) -> AnchorBits:
    """The grams of ``anchors`` as bits; what reaches the driver is bounded whatever their number."""
    counted = packed(table.select("class", "gram").distinct())
    classes = counted.groupBy("class").agg(F.count(F.lit(1)).alias("n")).collect()
    words = min(max(sum(r["n"] for r in classes) * ANCHOR_BITS // 64, 1), MOST_BITS // 64)
    # the same as in has(): after an unsigned shift no number is negative
    bits = F.explode(F.array(*[F.expr(f"pmod(shiftrightunsigned(gram, {int(t)}) + class, {words * 64}L)")
                               for t in _TURNS])).alias("bit")
    rows = (counted.select(bits).groupBy(F.expr("bit div 64").alias("word"))
            .agg(F.expr("bit_or(shiftleft(1L, cast(bit % 64 AS int)))").alias("bits"))).toArrow()
    out = np.zeros(words, np.uint64)
    out[rows["word"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    return AnchorBits(sorted(r["class"] for r in classes), out)


def has_bit(bits: AnchorBits, key: Column) -> Column:
    """Whether a number is, or may be, one of those of which ``bits`` were made as grams of class 0."""
    @F.pandas_udf("boolean")
    def met(keys: pd.Series) -> pd.Series:
        return pd.Series(bits.has(keys.to_numpy(np.int64).view(np.uint64), 0))

    return met.asNondeterministic()(key)


@dataclass(frozen=True)
class HotGrams:
    """Grams of frequent values by class, or None if it is not known how frequent values are."""

    grams: dict[int, np.ndarray] | None

    def salts(self, grams: np.ndarray, number: int) -> np.ndarray:
        """Which copy of its anchor a place meets."""
        own = (np.arange(len(grams)) % SALTS).astype(np.int32)
        if self.grams is None:
            return own
        return np.where(np.isin(grams.view(np.int64), self.grams.get(number, [])), own, 0).astype(np.int32)


def hot_grams(values: DataFrame, value: str) -> HotGrams:
    """All grams of the values with over 1/HOT_KEY_SHARE of all occurrences, which are HOT_KEY_SHARE at most."""
    if OCCURRENCES not in values.columns:
        return HotGrams(None)
    total = values.agg(F.sum(OCCURRENCES)).first()[0] or 0
    often = values.filter(F.col(OCCURRENCES) > max(total // HOT_KEY_SHARE, 1)).filter(F.length(value) <= LONGEST)
    texts = [r[0] for r in often.select(value).limit(HOT_KEY_SHARE).collect() if r[0]]
    rows = value_grams(texts) if texts else np.zeros((0, 4), np.int64)
    return HotGrams({n: np.unique(rows[rows[:, 1] == n, 3]) for n in np.unique(rows[:, 1]).tolist()})


def _around(table: DataFrame) -> dict[int, tuple[int, int] | None]:
    """By class, how far values reach before and after their anchor; None if that is over WINDOW."""
    reach = table.groupBy("class").agg(F.max("offset").alias("before"),
                                       F.max(F.length("value") - F.col("offset")).alias("after")).collect()
    return {r["class"]: (r["before"], r["after"]) if r["before"] + r["after"] <= WINDOW else None for r in reach}


def _places(rows: DataFrame, table: DataFrame, around: dict[int, tuple[int, int] | None], hot: HotGrams) -> DataFrame:
    """``start, value, payload`` of the values in ``_text``, with the other columns of ``rows``.

    A place goes with the characters around it, in which its value is compared; of classes without a window
    all places that met an anchor come out. A gram of many places is dealt over SALTS copies of its anchors.
    """
    likely = anchor_bits(table)
    kept = [f for f in rows.schema.fields if f.name != "_text"]

    def postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for numbers, texts in _portions(batch.column("_text").to_pylist()):
                lengths = np.array([len(t) for t in texts], np.int64) + 1
                starts = np.cumsum(lengths) - lengths
                joined = _SEPARATOR.join(texts)
                for number in likely.classes:
                    _, k, run = CLASSES[number]
                    for places, grams in met_grams(joined, k, run, lambda h, c=number: likely.has(h, c)):
                        at = np.searchsorted(starts, places, "right") - 1
                        places = places - starts[at]
                        near, before = [None] * len(at), 0
                        if around[number] is not None:
                            before, after = around[number]
                            near = [texts[n][max(p - before, 0):p + after]
                                    for n, p in zip(at.tolist(), places.tolist(), strict=True)]
                        take = pa.array(np.array(numbers)[at])
                        yield pa.RecordBatch.from_arrays(
                            [*[batch.column(f.name).take(take) for f in kept],
                             pa.array(np.full(len(at), number, np.int32)), pa.array(grams.view(np.int64)),
                             pa.array(hot.salts(grams, number)), pa.array(places.astype(np.int32)),
                             pa.array(np.minimum(places, before).astype(np.int32)), pa.array(near, pa.string())],
                            names=[*[f.name for f in kept], "class", "gram", "_salt", "_place", "_at", "_near"])

    found = rows.mapInArrow(postings, T.StructType([
        *kept, T.StructField("class", T.IntegerType()), T.StructField("gram", T.LongType()),
        *[T.StructField(n, T.IntegerType()) for n in ("_salt", "_place", "_at")],
        T.StructField("_near", T.StringType())]))
    copies = F.sequence(F.lit(0), F.lit(SALTS - 1))
    if hot.grams is not None:
        often = [(int(n), int(g)) for n, own in hot.grams.items() for g in own.tolist()]
        listed = table.sparkSession.createDataFrame(often, "class int, gram bigint").withColumn("_often", F.lit(True))
        table = table.join(F.broadcast(listed), ["class", "gram"], "left")
        copies = F.when(F.col("_often"), copies).otherwise(F.array(F.lit(0)))
    # the optimizer's size of the table leaves copies out
    met = found.join(table.withColumn("_salt", F.explode(copies)).hint("merge"), ["class", "gram", "_salt"])
    return (met.filter("_place >= offset AND (_near IS NULL OR substring(_near, _at - offset + 1, length(value)) = value)")
            .select(*[f.name for f in kept], (F.col("_place") - F.col("offset")).alias("start"), "value", "payload"))


def _joined(df: DataFrame, text: str, values: DataFrame, value: str, payload: str, finish, kind: str, name: str,
            nothing: Column) -> DataFrame:
    """The same through joins: selected grams to anchors, then the places that met to their texts.

    Grams that are no anchor's, by a table of bits, go no further; by another, texts without any value stay where
    they are. Texts are told apart by two hashes of their content; equal texts have equal occurrences.
    """
    @F.arrow_udf(kind)
    def compared(texts: pa.Array, places: pa.Array) -> pa.Array:
        out = []
        for whole, met in zip(texts, places, strict=True):
            whole, found = whole.as_py(), met.values
            if whole is None:
                out.append(None)
                continue
            rows = [] if found is None else zip(*(found.field(c).to_pylist() for c in ("start", "value", "payload")),
                                                strict=True)
            out.append(finish(whole, [r for r in rows if whole.startswith(r[1], r[0])]))
        return pa.array(out, pa.list_(pa.string()) if kind.startswith("array") else pa.string())

    keys = ["_text1", "_text2"]
    keyed = df.withColumns({"_text1": F.xxhash64(F.col(text)), "_text2": F.xxhash64(F.col(text), F.lit(1))})
    table = packed(anchors(values, value, payload), "value", "payload")
    rows = keyed.filter(F.col(text).isNotNull()).select(*keys, F.col(text).alias("_text"))
    found = _places(rows, table, _around(table), hot_grams(values, value))
    holding = has_bit(anchor_bits(found.select(F.lit(0).alias("class"), F.col("_text1").alias("gram"))), F.col("_text1"))
    met = found.groupBy(*keys).agg(F.collect_set(F.struct("start", "value", "payload")).alias("_met"))
    tagged = keyed.withColumn("_holds", holding)
    changed = (join_null_safe(tagged.filter("_holds").drop("_holds"), met, keys)
               .withColumn(name, compared(F.col(text), F.col("_met"))).drop("_met", *keys))
    return union_parts(changed, tagged.filter("NOT _holds").drop("_holds", *keys).withColumn(name, nothing))
