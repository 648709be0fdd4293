"""SimHash near-duplicates: byte-position inverted index with count filtering.

Two fingerprints that differ in at most two bits agree in at least six of their eight
bytes. The index posts every distinct fingerprint under six choices of four byte positions;
their complements cover every pair of positions, so a linked pair meets in at least one
posting list. For a pair that meets, the shared positional bytes are tallied, pairs with
fewer than six are dropped, and the rest is verified by its Hamming distance.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import lower_words, map_texts, materialise
from veilframe.llm.graph import components

SHINGLE = 3
SEED = 42
MAX_BITS = 2
MIN_SHARED_BYTES = 6
#: Byte positions left out of the six posting keys. Every two of the eight
#: positions lie together in one of them.
LEFT_OUT = ((0, 1, 2, 3), (4, 5, 6, 7), (0, 1, 4, 5), (0, 1, 6, 7), (2, 3, 4, 5), (2, 3, 6, 7))
#: Posting lists up to this length are compared pair by pair, longer ones by flipped bits.
PAIRWISE = 48


def _fingerprint_factory():
    shifts = np.arange(64, dtype=np.uint64)

    def one(text):
        words = lower_words(text)
        if not words:
            return 0
        if len(words) < SHINGLE:
            grams = [b" ".join(words)]
        else:
            grams = map(b" ".join, zip(words, words[1:], words[2:], strict=False))
        digest = xxhash.xxh64_intdigest
        h = np.array([digest(g, SEED) for g in grams], dtype=np.uint64)
        counts = np.zeros(64, dtype=np.int64)
        for start in range(0, h.size, 65_536):
            part = h[start:start + 65_536]
            bits = np.unpackbits(part.astype("<u8").view(np.uint8), bitorder="little")
            counts += bits.reshape(-1, 64).sum(axis=0, dtype=np.int64)
        value = int((np.uint64(1) << shifts[2 * counts > h.size]).sum(dtype=np.uint64))
        return _signed(value)

    def run(texts):
        return [([one(t) for t in texts], pa.int64())]

    return run


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, fp`` per row; the 64 bits of the fingerprint as a long."""
    return map_texts(docs, ["doc_id"], "text", "fp bigint", _fingerprint_factory)


def _byte(x: Column, position: int) -> Column:
    return F.shiftrightunsigned(x, 8 * position).bitwiseAND(F.lit(255))


def shared_bytes(a: Column, b: Column) -> Column:
    """How many of the eight positional bytes agree."""
    diff = a.bitwiseXOR(b)
    total = F.lit(0)
    for p in range(8):
        total = total + F.when(_byte(diff, p) == 0, 1).otherwise(0)
    return total


def _mask(left_out: tuple[int, ...]) -> int:
    mask = sum(255 << (8 * p) for p in range(8) if p not in left_out)
    return _signed(mask)


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def links(fps: DataFrame) -> DataFrame:
    """Links ``(a, b)`` over distinct fingerprints ``fp`` whose components are those of all
    pairs within MAX_BITS.

    Short posting lists give every such pair. In a long list, whose members agree in four
    bytes, each member also takes the 32 values one bit away in the other bytes; members that
    take a common value are within two bits of each other, and are linked to the smallest
    of them, so a list of n members costs 33 n rows and no n * n pairs.
    """
    posts = fps.select("fp", F.explode(F.array(*[
        F.struct(F.lit(i).alias("k"), F.col("fp").bitwiseAND(F.lit(_mask(out))).alias("key"))
        for i, out in enumerate(LEFT_OUT)])).alias("p")).select("fp", "p.k", "p.key")
    sizes = posts.groupBy("k", "key").agg(F.count("*").alias("n")).filter("n > 1")
    posts = materialise(posts.join(sizes, ["k", "key"]))
    short = posts.filter(F.col("n") <= PAIRWISE)
    lists = short.groupBy("k", "key").agg(F.sort_array(F.collect_list("fp")).alias("fps"))
    pairs = (lists.select(F.posexplode("fps").alias("i", "a"), "fps")
             .select("a", F.explode(F.slice("fps", F.col("i") + 2, PAIRWISE)).alias("b")))
    pairs = pairs.filter(shared_bytes(F.col("a"), F.col("b")) >= MIN_SHARED_BYTES)

    long = posts.filter(F.col("n") > PAIRWISE)
    flips = F.lit(None)
    for i, out in enumerate(LEFT_OUT):
        ones = F.array(F.lit(0).cast("long"), *[F.lit(_signed(1 << (8 * p + bit)))
                                                for p in out for bit in range(8)])
        flips = F.when(F.col("k") == i, ones).otherwise(flips)
    near = long.select("fp", "k", F.explode(flips).alias("flip")).select(
        "fp", "k", F.col("fp").bitwiseXOR(F.col("flip")).alias("value"))
    smallest = near.groupBy("k", "value").agg(F.min("fp").alias("low"), F.count("*").alias("m"))
    smallest = smallest.filter("m > 1").drop("m")
    stars = near.join(smallest, ["k", "value"]).filter("fp <> low").select(
        F.col("low").alias("a"), F.col("fp").alias("b"))
    stars = stars.filter(shared_bytes(F.col("a"), F.col("b")) >= MIN_SHARED_BYTES)

    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS
    return pairs.unionByName(stars).filter(close).distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, fingerprint, component_id, n_links`` for every row of ``docs``.

    Equal fingerprints are merged first, so copies never meet pair by pair, and a group of
    any size is one node. ``component_id`` is the smallest doc_id reachable over links;
    ``n_links`` counts the other fingerprints of the component. Texts that are null or
    have no word have fingerprint zero and are linked like any other. Rows without a doc_id
    keep their fingerprint and take part in links; an id of a component with no other id is
    null. Repeated rows come out repeated; an empty table gives an empty result.
    """
    prints = materialise(fingerprints(docs))
    of = _classes(prints)
    return (prints.join(of, prints["fp"] == of["node"])
            .select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
                    "component_id", "n_links"))


def _classes(prints: DataFrame) -> DataFrame:
    """``node, component, component_id, n_links`` for every fingerprint of ``prints(doc_id, fp)``."""
    nodes = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    found = materialise(components(links(nodes.select("fp"))))
    member = nodes.join(found, nodes["fp"] == found["node"], "left").select(
        "fp", "first_id", F.coalesce("component", "fp").alias("component"))
    ids = member.groupBy("component").agg(F.min("first_id").alias("component_id"),
                                          (F.count("*") - 1).alias("n_links"))
    return materialise(member.join(ids, "component").select(
        F.col("fp").alias("node"), "component", "component_id", "n_links"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` for each component: that of the smallest doc_id, of rows that share it, or of
    a component without ids, that of the smallest text hash, and of equal rows any one.

    Rows without an id go like any other where their component has another row. An empty table
    gives none. Columns are unchanged, whatever their names.
    """
    digest = F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    prints = materialise(map_texts(docs.select("doc_id", "text", digest.alias("digest")), ["doc_id", "digest"], "text",
                                   "fp bigint", _fingerprint_factory))
    of = _classes(prints)
    rows = (prints.join(of, prints["fp"] == of["node"]).groupBy("component", "doc_id", "digest")
            .agg(F.count("*").alias("n")))
    stay = materialise(rows.groupBy("component").agg(F.min(F.struct(
        F.col("doc_id").isNull().alias("none"), "doc_id", "digest", "n")).alias("w")).select(
        F.col("w.doc_id").alias("_id"), F.col("w.digest").alias("_digest"), F.col("w.n").alias("_n")))
    packed = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("key"), digest.alias("digest"))
    kept = packed.join(stay, packed["key"].eqNullSafe(stay["_id"]) & (packed["digest"] == stay["_digest"]))
    if not stay.filter("_n > 1").isEmpty():
        kept = kept.filter("_n = 1").unionByName(kept.filter("_n > 1").dropDuplicates(["key", "digest"]))
    return kept.select("row.*")
