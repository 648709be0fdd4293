import math
import zlib
from collections import Counter, defaultdict

from veilframe.llm import language


def brute_length(counts, unit, order=language.ORDER):
    """Escape method C, walked byte by byte over plain counts."""
    nodes = defaultdict(Counter)
    for word, n in counts.items():
        data = b" " + word + b" "
        for i in range(1, len(data)):
            for k in range(min(order, i) + 1):
                nodes[data[i - k:i]][data[i]] += n
    bits, data = 0.0, b" " + unit + b" "
    for i in range(1, len(data)):
        for k in range(min(order, i), -1, -1):
            node = nodes.get(data[i - k:i])
            if node is None:
                continue
            total = sum(node.values()) + len(node)
            if data[i] in node:
                bits += math.log2(total / node[data[i]])
                break
            bits += math.log2(total / len(node))
        else:
            bits += 8
    return bits


COUNTS = {"en": Counter({b"the": 9, b"then": 3, b"of": 5, b"other": 2}),
          "fr": Counter({b"le": 9, b"les": 3, "été".encode(): 2, b"autre": 4})}


def test_code_lengths():
    trees = language.build(COUNTS)
    for unit in (b"the", b"thethe", b"le", "été".encode(), b"zzz", b"x", b"otherles", bytes(range(128, 160))):
        got = trees.code_length(unit)
        for j, lang in enumerate(trees.languages):
            assert abs(got[j] - brute_length(COUNTS[lang], unit)) < 1e-3


def test_scorer_with_small_memory(monkeypatch):
    trees = language.build(COUNTS)
    text = " ".join(f"the{i % 17} of{i % 5} " + "y" * (i % 60) for i in range(300))
    monkeypatch.setattr(language, "SLICE", 20)
    monkeypatch.setattr(language, "CACHE", 30)
    got = language.Scorer(trees)(text)
    want = sum(trees.code_length(u) for u in language.units(text))
    assert abs(got - want).max() < 0.5


def test_held_out_accuracy(spark):
    words = {"en": "the of and to in that is was for with other then".split(),
             "fr": "le la les des une est pour dans avec autre été".split()}
    rows = [(i, " ".join(words[lang][(i * 7 + k * k) % len(words[lang])] for k in range(20)), lang)
            for i in range(120) for lang in [("en", "fr")[i % 2]]]
    rows += [(200, None, "en"), (201, "", "fr"), (202, "12 34", "fr"), (203, "the of", None), (None, "le la", "fr")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = {r.doc_id: r for r in language.language(df).collect()}
    assert len(got) == len(rows)
    for i, text, lang in rows[:120]:
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
        assert got[i].lang_pred == lang and 0 <= got[i].score <= 1
    assert {got[i].lang_pred for i in (200, 201, 202)} == {"und"} and got[203].lang_pred == "en"


def test_awkward_rows(awkward, no_docs):
    assert language.language(awkward).count() == awkward.count()
    assert language.language(no_docs).count() == 0
    unlearned = language.language(awkward.withColumn("lang", awkward.lang.substr(9, 1)).replace("", None, "lang"))
    assert {r.lang_pred for r in unlearned.collect()} == {"und"}


def test_every_language_is_learned(spark, monkeypatch):
    """More languages than one table holds; the rare ones, last by name, are found too."""
    rows = [(i * 100 + k, f"word{i:02d}x other{i:02d}y more{i:02d}z", f"l{i:02d}")
            for i in range(60) for k in range(12 if i < 50 else 4)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").coalesce(2)
    trees = language.train(df)
    assert [lang for t in trees for lang in t.languages] == [f"l{i:02d}" for i in range(60)] and len(trees) == 2
    want = {i: lang for i, _, lang in rows}
    got = language.identify(df, trees).collect()
    assert all(r.lang_pred == want[r.doc_id] for r in got) and len(got) == len(rows)
    # blocks give what one table gives
    monkeypatch.setattr(language, "LANGUAGES", 100)
    one = {r.doc_id: r for r in language.language(df).collect()}
    assert all(r.lang_pred == one[r.doc_id].lang_pred and abs(r.score - one[r.doc_id].score) < 1e-3 for r in got)


def test_unusable_texts_take_no_place(spark, monkeypatch):
    """Null, blank and long texts leave their places to others; only long texts are taken whole."""
    monkeypatch.setattr(language, "TRAIN_DOCS", 5)
    monkeypatch.setattr(language, "TRAIN_BYTES", 40)
    free = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 != 2]
    bad = [None, "", " \n", "y " * 30]
    rows = [(i, f"en{i}" if k % 10 == 0 else bad[k % 4], "en") for k, i in enumerate(free[:100])]
    rows += [(i, f"fr{i} " * 20, "fr") for i in free[100:110]] + [(i, f"de{i}" + " z" * 30 * (i % 2), "de") for i in free[110:114]]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    words = defaultdict(set)
    for r in language.training_words(df).collect():
        words[r.lang].add((bytes(r.word), r.n))
    assert len(words["en"]) == 5 and all(w.startswith(b"en") and n == 1 for w, n in words["en"])
    assert len(words["fr"]) == 5 and all(n == 20 for _, n in words["fr"])
    assert {w for w, _ in words["de"]} - {b"z"} == {f"de{i}".encode() for i in free[110:114]}
