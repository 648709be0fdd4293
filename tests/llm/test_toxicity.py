import random
import zlib

import numpy as np

from veilframe.llm import toxicity


def rows_of(n, seed):
    """Toxic only where an insult meets a group name, or the slur is there; alone they are harmless."""
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        words = [f"w{rng.randrange(40)}" for _ in range(rng.randint(5, 30))]
        insult, group, slur = rng.random() < .5, rng.random() < .5, rng.random() < .1
        words += ["insult"] * insult + ["group"] * group + [f"slurry{rng.randrange(9)}"] * slur
        rng.shuffle(words)
        out.append((" ".join(words), int(insult and group or slur)))
    return out


def test_logit_is_that_of_all_pairs():
    machine = toxicity.fit(rows_of(600, 1))
    terms = toxicity.Terms(machine.index)
    rows = terms(rows_of(1, 2)[0][0] + " insult group")
    pairs = sum(float(machine.v[a] @ machine.v[b]) for i, a in enumerate(rows) for b in rows[i + 1:])
    assert abs(machine.logit(rows) - (machine.bias + machine.w[rows].sum() + pairs)) < 1e-6


def test_learns_pairs_on_held_out_rows():
    machine = toxicity.fit(rows_of(3_000, 5))
    terms = toxicity.Terms(machine.index)
    test = rows_of(600, 6)
    hits = [(machine.logit(terms(t)) >= 0) == bool(y) for t, y in test]
    assert np.mean(hits) > 0.97


def neutral_rows(n, seed):
    """Both words have the base share of 0.2 alone; only the pair, or a third word, is toxic."""
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        words = [f"w{rng.randrange(400)}" for _ in range(rng.randint(5, 60))]
        insult, group = rng.random() < .2, rng.random() < .2
        slur = not insult and not group and rng.random() < .25
        words += ["insult"] * insult + ["group"] * group + ["slur"] * slur
        rng.shuffle(words)
        out.append((" ".join(words), int(insult and group or slur)))
    return out


def test_learns_pairs_of_terms_that_are_neutral_alone():
    terms = toxicity.Terms((machine := toxicity.fit(neutral_rows(4_000, 1))).index)
    test = neutral_rows(1_500, 2)
    hits = [((machine.logit(terms(t)) >= 0) == bool(y), {"insult", "group"} <= set(t.split())) for t, y in test]
    assert sum(pair for _, pair in hits) > 40
    assert np.mean([hit for hit, pair in hits if pair]) > 0.95 and np.mean([hit for hit, _ in hits]) > 0.97


def test_rows_and_held_out(spark, make_docs, awkward, no_docs):
    data = rows_of(400, 9)
    docs = make_docs([t for t, _ in data])
    labels = spark.createDataFrame([(i, 1, y) for i, (_, y) in enumerate(data)] + [(None, 1, 1), (3, 1, None)],
                                   "doc_id bigint, quality int, toxic int")
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == 400 and all(0 <= r.score <= 1 and r.predicted == (r.score >= .5) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert toxicity.training_rows(docs, labels).filter("crc32(CAST(CAST(doc_id AS string) AS binary)) % 5 = 0").count() == 0
    assert toxicity.toxicity(awkward, labels).count() == awkward.count()
    assert toxicity.toxicity(no_docs, labels).count() == 0
    unlabelled = toxicity.toxicity(awkward, labels.filter("false")).collect()
    assert {r.predicted for r in unlabelled} == {0}


def test_one_training_row_of_a_repeated_id(spark, make_docs):
    rows = [(1, f"text {i}") for i in range(300)] + [(2, None), (2, None), (3, "x"), (6, "y" * 70_000), (6, "short")]
    labels = spark.createDataFrame([(i, 1, i % 2) for i in (1, 2, 3, 4, 6)], "doc_id bigint, quality int, toxic int")
    free = {i for i in (1, 2, 3, 6) if zlib.crc32(str(i).encode()) % 5}
    kept = toxicity.training_rows(make_docs(rows), labels).collect()
    got = {r.doc_id: (r.text, r.y) for r in kept}
    assert len(kept) == len(got) and set(got) == free and 1 in free
    assert all(t == {2: None, 3: "x", 6: "short"}.get(i, t) and y == i % 2 for i, (t, y) in got.items())
