import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture()
def make_docs(spark):
    """Documents from texts, or from (doc_id, text) pairs; extra columns have clashing names."""
    def make(rows, extra=False):
        pairs = [r if isinstance(r, tuple) else (i, r) for i, r in enumerate(rows)]
        full = [(i, t, "en", f"src{(i or 0) % 3}", None if t is None else len(t)) for i, t in pairs]
        df = spark.createDataFrame(full, SCHEMA)
        if extra:
            for name in ("key", "row", "keep_id", "hash", "salt", "fp", "drop", "component_id", "tokens",
                         "kept", "score", "id"):
                df = df.selectExpr("*", f"'x' AS `{name}`")
        return df
    return make


AWKWARD = [None, "", " \t\n", "one", "two words", "É x y", "same\nsame\nsame", "same\nsame\nsame",
           "a " * 30_000, "nul\x00 byte", "x" * 5_000]


@pytest.fixture()
def awkward(make_docs):
    """Null ids, null and empty texts, long texts, repeated rows, clashing extra columns."""
    rows = [*enumerate(AWKWARD), (None, "no id"), (None, None), (3, "one"), (3, "one")]
    return make_docs(rows, extra=True)


@pytest.fixture()
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
