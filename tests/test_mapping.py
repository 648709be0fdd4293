import pytest
from pyspark.sql import functions as F

from veilframe.functions import checksums as C
from veilframe.operators import mapping as M

KEY = M.derive_key("secret", b"s" * 32, iterations=1000)
OTHER = M.derive_key("other", b"s" * 32, iterations=1000)


def spans(spark, values, entity="LOCATION"):
    rows = [(i, 0, 0, entity, v) for i, v in enumerate(values)]
    return spark.createDataFrame(
        rows, "doc_id int, chunk_ord int, start int, entity_type string, original string")


def test_fakes_stay_unique_in_a_small_pool(spark):
    """An unknown entity has only one fake."""
    for entity in ("LOCATION", "STAFF_ID"):
        rows = M.build_mapping(spans(spark, [f"Place {i}" for i in range(200)], entity), "s", KEY)
        fakes = [r.fake_value for r in rows.collect()]
        assert len(set(fakes)) == len(fakes) == 200


def test_many_people_and_places_get_plain_fakes(spark):
    for entity, n in (("PERSON", 100_000), ("LOCATION", 400)):
        df = spark.range(n).selectExpr("cast(id AS int) AS doc_id", "0 AS chunk_ord", "0 AS start",
                                       f"'{entity}' AS entity_type", "concat('v', id) AS original")
        rows = M.build_mapping(df, "s", KEY)
        assert rows.select("fake_value").distinct().count() == n
        assert rows.filter("fake_value RLIKE '-[0-9a-f]{12}'").count() == 0


def test_fake_never_equals_a_real_value(spark):
    cities = ["Bath", "York", "Derby", "Leeds", "Perth", "Truro", "Exeter"] * 3
    rows = M.build_mapping(spans(spark, cities), "s", KEY).collect()
    assert len(rows) == 7 and not {r.fake_value for r in rows} & set(cities)


def test_first_entity_decides(spark):
    df = spark.createDataFrame(
        [(2, 0, 0, "UK_PHONE", "x"), (1, 1, 5, "DATE_TIME", "x"), (1, 1, 9, "UK_NI", "x")],
        "doc_id int, chunk_ord int, start int, entity_type string, original string")
    row = M.originals(df).first()
    assert (row.entity_type, row.occurrences, row.first_doc) == ("UK_NI", 3, "1")


def test_first_write_wins(spark):
    a = M.build_mapping(spans(spark, ["a", "b"]), "s", KEY, salt="1")
    b = M.build_mapping(spans(spark, ["b", "c"]), "s", KEY, salt="2")
    merged = {r.original_hash: r.fake_value for r in M.insert_if_absent(a, b).collect()}
    old = {r.original_hash: r.fake_value for r in a.collect()}
    assert len(merged) == 3 and all(merged[h] == f for h, f in old.items())


def test_encryption_layout_and_wrong_key(spark):
    rows = M.build_mapping(spans(spark, ["abc"]), "s", KEY)
    assert len(rows.first().real_value_encrypted) == 12 + 3 + 16
    assert M.replacements(rows, "s", KEY).first().real_value == "abc"
    with pytest.raises(M.MappingError):
        M.check_key(rows, "s", OTHER)
    with pytest.raises(Exception, match="decrypted"):
        M.replacements(rows, "s", OTHER).collect()
    M.check_key(rows, "s", KEY)


def test_key_is_not_in_plans(spark):
    rows = M.replacements(M.build_mapping(spans(spark, ["abc"]), "s", KEY), "s", KEY)
    import contextlib
    import io
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        rows.explain(True)
    assert KEY.hex() not in out.getvalue().lower()


def test_lookup_sessions_purge(spark):
    both = (M.build_mapping(spans(spark, ["a"]), "s1", KEY)
            .unionByName(M.build_mapping(spans(spark, ["b"]), "s2", KEY)))
    hashes = spark.createDataFrame([("a",), ("b",)], "v string").select(
        F.expr(C.hex_hash("v")).alias("original_hash"))
    found = [r.fake_value for r in M.lookup(hashes, both, "s1").collect()]
    assert sorted(f is None for f in found) == [False, True]
    assert sorted(r.session_id for r in M.sessions(both).collect()) == ["s1", "s2"]
    assert [r.session_id for r in M.purge(both, "s1").collect()] == ["s2"]


def test_write_and_append(spark, tmp_path):
    path = str(tmp_path / "mapping")
    for s in ("s1", "s2"):
        M.write_mapping(M.build_mapping(spans(spark, ["a"]), s, KEY), path)
    stored = spark.read.parquet(path)
    assert stored.count() == 2 and stored.select("record_id").distinct().count() == 2
    assert M.purge_to(stored, "s1", str(tmp_path / "kept")) == 1
    assert spark.read.parquet(str(tmp_path / "kept")).count() == 1


def test_iterations():
    assert M.KDF_ITERATIONS == 600_000 and len(KEY) == 32
