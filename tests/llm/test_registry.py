"""Registered queries against DuckDB where SQL can say them, and the pipeline against its stages."""

import hashlib
import os

import duckdb
import public_tokenizers
import pytest
import sentencepiece

import __spark_entry__ as entry
import corpus_pipeline
from tools.check import rows
from veilframe.llm import registry

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def test_registered():
    assert set(registry.QUERIES) | {"pipeline"} <= set(entry.queries())
    assert [int(n[2:].split("_")[0]) for n in registry.QUERIES] == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for view in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {view} AS SELECT * FROM '{FOLDER}/{view}.parquet'")
    df = registry.QUERIES[name](spark, FOLDER)
    cur = con.execute(registry.ORACLE[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.columns, df.collect()) == rows(columns, cur.fetchall())


@pytest.mark.parametrize("name", ["op2_toxicity", "op6_quality_rules", "op8_language_id", "op9_warc"])
def test_rows_are_whole(spark, name):
    table, key = ("pages", "page_id") if name == "op9_warc" else ("documents", "doc_id")
    want = spark.read.parquet(f"{FOLDER}/{table}.parquet").select(key)
    got = registry.QUERIES[name](spark, FOLDER).select(key)
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0


def test_pipeline(spark):
    """Every stage against plain Python over what its predecessor kept."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    before = docs
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, FOLDER).checkpoint()
        assert after.columns == columns
        check(name, [r.asDict() for r in before.collect()], [r.asDict() for r in after.collect()])
        before = after
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(registry.PIECE_MODEL))
    want = {(r.doc_id, hashlib.sha256(",".join(map(str, library.encode(r.text or ""))).encode()).hexdigest())
            for r in before.collect()}
    done = corpus_pipeline.run(spark, FOLDER)
    assert {(r.doc_id, r.ids_sha256) for r in done.collect()} == want
    assert done.count() == before.count()


def check(name, before, after):
    import test_lines
    import test_quality
    import test_simhash

    if name == "quality_rules":
        whole = {r["doc_id"]: r for r in before}
        assert all(whole[r["doc_id"]] == r for r in after)
        for r in after:
            n, _, _, _, repeats = test_quality.brute(r["text"])
            assert n >= 50 and 100 * repeats <= 50 * n
    elif name == "line_dedup":
        want = {i: s for i, _, _, s in test_lines.brute([(r["doc_id"], r["text"]) for r in before])}
        assert {r["doc_id"]: hashlib.sha256(r["text"].encode()).hexdigest() for r in after} == want
        assert all(r["n_chars"] == len(r["text"]) for r in after)
    elif name == "near_dedup":
        ids = [r["doc_id"] for r in before]
        low = test_simhash.brute_components([test_simhash.brute_print(r["text"]) for r in before], ids)
        assert {r["doc_id"] for r in after} == {i for i, c in zip(ids, low, strict=True) if i == c}
    else:
        import test_mixing

        want = test_mixing.brute([(r["doc_id"], r["text"], r["lang"], r["source"]) for r in before], test_mixing.Mix())
        assert sorted(r["doc_id"] for r in after) == sorted(i for (i, _), n in want.items() for _ in range(n))
