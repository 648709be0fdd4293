import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from veilframe.llm import graph, simhash


def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[j:j + 3]) for j in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(values, ids):
    """Smallest id reachable over values within two bits."""
    parent = list(range(len(values)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    v = np.array(values, dtype=np.uint64)
    for i in range(len(v)):
        for j in np.flatnonzero(np.bitwise_count(v ^ v[i]) <= 2):
            a, b = sorted((find(i), find(int(j))))
            parent[b] = a
    low = {}
    for i, x in enumerate(ids):
        r = find(i)
        low[r] = min(x, low.get(r, x))
    return [low[find(i)] for i in range(len(ids))]


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_fingerprints_and_components(make_docs):
    rng = random.Random(1)
    base = [" ".join(rng.choice("abcdefghij") * rng.randint(1, 5) for _ in range(rng.randint(1, 90)))
            for _ in range(40)]
    near = [t.rsplit(" ", 1)[0] + " Zz" for t in base]
    texts = [*base, *near, *base[:10], None, "", "  ", "ONE", "one", "É é"]
    got = {r.doc_id: r for r in simhash.near_duplicates(make_docs(texts)).collect()}
    prints = [brute_print(t) for t in texts]
    assert [got[i].fingerprint for i in range(len(texts))] == [f"{p:016x}" for p in prints]
    assert [got[i].component_id for i in range(len(texts))] == brute_components(prints, range(len(texts)))


def test_links_of_long_posting_lists(spark):
    """More fingerprints around one value than a list compares pair by pair, and chains."""
    rng = random.Random(3)
    values = {0, (1 << 64) - 1}
    for base in (rng.getrandbits(64) for _ in range(3)):
        for _ in range(250):
            v = base
            for _ in range(rng.randint(0, 3)):
                v ^= 1 << rng.randrange(64)
            values.add(v)
        values.update(base ^ (rng.getrandbits(16) << 16) for _ in range(200))
    values = sorted(values)
    fps = spark.createDataFrame([(signed(v),) for v in values], "fp bigint")
    found = {r.node: r.component for r in graph.components(simhash.links(fps)).collect()}
    groups = {}
    for v, c in zip(values, brute_components(values, values), strict=True):
        groups.setdefault(c, set()).add(signed(v))
    mine = {}
    for v in values:
        mine.setdefault(found.get(signed(v), signed(v)), set()).add(signed(v))
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, mine.values()))


def test_components_of_chains_and_stars(spark):
    rows = ([(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 400)]
            + [(5000, 5000), (None, 1)])
    got = {r.node: r.component for r in graph.components(
        spark.createDataFrame(rows, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(301)}, **{1000 + i: 1000 for i in range(400)}}


def test_awkward_rows(awkward, no_docs):
    rows = simhash.near_duplicates(awkward).collect()
    assert len(rows) == awkward.count()
    zero = {r.doc_id for r in rows if r.fingerprint == "0" * 16}
    assert {0, 1, 2} <= zero and {r.component_id for r in rows if r.doc_id in (0, 1, 2)} == {0}
    assert simhash.near_duplicates(no_docs).count() == 0
    kept = simhash.keep_one(awkward)
    assert kept.columns == awkward.columns
    assert kept.filter("doc_id IN (6, 7)").count() == 1
    assert [r.text for r in kept.filter(F.col("doc_id").isNull()).collect()] == ["no id"]
    assert kept.filter("doc_id = 3").count() == 1
    assert simhash.keep_one(no_docs).count() == 0


def test_copies_without_ids_go(make_docs):
    """One row of each component stays, whatever their ids."""
    text = "some words that many rows share and that make a fingerprint " * 3
    other = "quite another text with other words in it so that it stands alone " * 3
    rows = [(None, text)] * 50 + [(9, text)] * 20 + [(4, text)] * 5 + [(None, other)] * 30
    kept = simhash.keep_one(make_docs(rows, extra=True)).collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=repr) == sorted([(4, text), (None, other)], key=repr)
