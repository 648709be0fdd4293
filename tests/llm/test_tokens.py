import public_tokenizers

from veilframe.llm import tokens

ARGS = (public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def test_lengths_and_histogram(awkward):
    encoding = tokens.load(*ARGS)
    counted = tokens.lengths(awkward, *ARGS)
    want = [len(encoding.encode_ordinary(r.text or "")) for r in awkward.collect()]
    assert sorted(r.n_tokens for r in counted.collect()) == sorted(want)
    rows = tokens.histogram(counted).collect()
    assert {r.context_limit for r in rows} == set(want)
    for r in rows:
        k = r.context_limit
        assert (r.n_docs, r.n_tokens) == (want.count(k), k * want.count(k))
        assert r.docs_at_most == sum(x <= k for x in want) == len(want) - r.docs_longer
        assert r.total_tokens == sum(want)
        assert r.truncated_tokens == sum(min(x, k) for x in want)


def test_many_blocks_and_nothing(spark, no_docs):
    values = [(i * 7919) % 100_000 for i in range(3_000)] * 2
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "n_tokens bigint")
    rows = tokens.histogram(df).collect()
    for r in rows[::97]:
        assert r.truncated_tokens == sum(min(v, r.context_limit) for v in values)
    assert tokens.histogram(tokens.lengths(no_docs, *ARGS)).count() == 0


def test_texts_are_encoded_once(spark, make_docs, monkeypatch):
    """The answer's plan starts from the written histogram."""
    rows = tokens.histogram(tokens.lengths(make_docs(["a b", "c"]), *ARGS))
    plan = rows._jdf.queryExecution().toString()
    assert "MapInArrow" not in plan and "ExistingRDD" in plan
