"""Work that grows with the tables: how rows are dealt out, what is broadcast, joined and parsed."""

import gc
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilframe.operators import substrings as Z
from veilframe.operators.pseudonymise import restore_documents
from veilframe.session import join_checked, spread
from veilframe.sources import email as EM
from veilframe.streaming import jobs as J


def test_copies_of_a_salted_table_are_not_broadcast(spark, tmp_path):
    """A file's size says nothing of the copies made for the join."""
    path = str(tmp_path / "names")
    spark.range(500).select(F.concat(F.lit("name "), "id").alias("phrase"), "id").write.parquet(path)
    names = spark.read.parquet(path)
    left = names.select("phrase", (F.col("id") % 7).alias("n")).union(names.select("phrase", F.lit(1)))
    joined = join_checked(left, names, ["phrase"], "inner", small=False)
    assert "Broadcast" not in joined._jdf.queryExecution().executedPlan().toString()
    assert joined.count() == 1000 and joined.columns == ["phrase", "n", "id"]


def partitions_with_rows(df):
    return df.groupBy(F.spark_partition_id()).count().count()


def test_rows_of_joins_and_unions_are_dealt_out(spark, tmp_path):
    """The estimate of a join of small files is huge, yet all its rows come from one split."""
    path = str(tmp_path / "t")
    spark.range(2000).coalesce(1).select("id", F.repeat(F.lit("x"), 500).alias("text")).write.parquet(path)
    rows = spark.read.parquet(path)
    cores = spark.sparkContext.defaultParallelism
    joined = rows.join(spark.range(3).withColumnRenamed("id", "k"), F.expr("id % 3 = k")).crossJoin(
        spark.range(2).withColumnRenamed("id", "z"))
    for df in (joined, rows.unionByName(rows)):
        dealt = spread(df, "id")
        assert partitions_with_rows(dealt) == cores
        assert dealt.count() == df.count()


@pytest.mark.parametrize("parts", [1, 3])
def test_a_table_is_streamed_as_file_and_as_folder(spark, tmp_path, parts):
    base = tmp_path / "data"
    rows = spark.range(50).withColumn("text", F.lit("mail a@b.org"))
    rows.repartition(parts).write.parquet(str(base / "docs.parquet"))
    if parts == 1:
        (one,) = (base / "docs.parquet").glob("part-*")
        (tmp_path / "single").mkdir()
        base = tmp_path / "single"
        (base / "docs.parquet").write_bytes(one.read_bytes())
    rows.write.parquet(str(base / "other.parquet"))
    source = J.read_stream(spark, str(base), rows.schema, table="docs.parquet")
    J.scrub_stream(source, "id", "text", str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted(r.id for r in out) == list(range(50)) and {r.scrubbed_text for r in out} == {"mail [EMAIL_ADDRESS_1]"}


MAIL = ("From: c{0}@example.com\nTo: desk@example.com\nCc: é{0}@example.org\nSubject: Account {0} of {0}\n"
        "Content-Type: text/plain; charset=\"utf-8\"\n\nCall {0}.\n")


def test_header_classes_do_not_grow_with_the_mails():
    def classes():
        return sum(isinstance(o, type) and o.__name__.startswith("_") and "Header" in o.__name__
                   for o in gc.get_objects())

    gc.collect()
    gc.disable()
    try:
        before = classes()
        for n in range(50):
            mail = MAIL.format(n).encode()
            chunks = EM._parse(mail)["chunks"]
            assert [c["text"] for c in chunks if c["part"] in ("from", "subject", "body0")] == [
                f"c{n}@example.com", f"Account {n} of {n}", f"Call {n}.\n"]
            EM._write(mail, [{**c, "text": "x"} for c in chunks])
        assert classes() - before < 20
    finally:
        gc.enable()


def test_a_header_read_twice_is_written_alike():
    long = "Subject: " + " ".join(["wörd", "plain", "=?utf-8?q?h=C3=A9?="] * 20)
    mail = f"From: a@b.org\n{long}\nContent-Type: text/html; charset=latin-1; x=\"{'y' * 90}\"\n\nhé\n".encode()
    chunks = [{"part": "from", "text": "x"}]
    first = EM._write(mail, chunks)
    assert EM._write(mail, chunks) == first
    assert EM._parse(mail) == EM._parse(mail)


def test_few_grams_that_are_no_anchor_reach_the_join(spark):
    """All grams of a text were joined before, several for each of its characters."""
    values = [f"07700 9{n:05d} and more" for n in range(0, 3000, 3)] + ["é", "E1"]
    table = Z.anchors(spark.createDataFrame([(v,) for v in values], "v string"), "v", "v")
    bits = Z.anchor_bits(table)
    for r in table.collect():
        assert bits.has(np.array([r.gram], np.int64).view(np.uint64), r["class"]).all()
    others = np.random.default_rng(1).integers(0, 1 << 63, 100_000, dtype=np.int64).view(np.uint64)
    assert max(bits.has(others, c).mean() for c in bits.classes) < 0.05


def test_long_texts_are_joined_in_segments(spark, monkeypatch):
    """A text of any length, in pieces, gives back what is restored in place."""
    pairs = spark.createDataFrame([(f"fake {n} of all", f"real {n}") for n in range(400)] + [("ä", "b")],
                                  "fake_value string, real_value string")
    rows = [(n, " and ".join(f"fake {(k * 7 + n) % 450} of all" for k in range(300)) + "ä" * n) for n in range(3)]
    texts = spark.createDataFrame([*rows, (9, None), (9, ""), (1, rows[1][1])], "n int, t string")

    def done():
        return sorted((r.n, r.restored_text or "") for r in restore_documents(texts, "n", "t", pairs).collect())

    want = done()
    monkeypatch.setattr(Z, "VALUE_LIMIT", 0)
    monkeypatch.setattr(Z, "SEGMENT", 500)
    assert done() == want


def test_choosing_takes_a_byte_a_character():
    """A file is one text; a set of all its taken places took about a hundred bytes for each."""
    found = [(k * 100, "x" * 90, "y") for k in range(5_000)]
    tracemalloc.start()
    try:
        assert Z.chosen(found + [(5, "x" * 8, "z")]) == found
        assert tracemalloc.get_traced_memory()[1] < 4_000_000
    finally:
        tracemalloc.stop()
