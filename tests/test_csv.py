"""CSV files in many splits against the standard library; large files in folder jobs."""

import csv
import random

import pytest
from pyspark.sql import functions as F

from veilframe.operators import mapping as M
from veilframe.plans.batch import FILE_TOO_LARGE, restore_folder, scrub_csv, scrub_folder
from veilframe.sources import csvsplit, files


def write(path, rows, end="\n", head=("id", "note", "mail")):
    with open(path, "w", newline="", encoding="utf-8") as f:
        csv.writer(f, lineterminator=end).writerows([list(head), *rows])


def messy(seed, n):
    rng = random.Random(seed)
    words = ["a", 'say "hi"', "two\nlines", "\n", "é,日", "", "x\r\ny", '"', '""\n""', "last\n"]
    return [[str(i), "".join(rng.choices(words, k=rng.randint(0, 4))), f"c{i}@example.com"] for i in range(n)]


def read_back(path):
    with open(path, newline="", encoding="utf-8") as f:
        return list(csv.reader(f))


@pytest.fixture()
def small_splits(spark):
    """Many splits per file."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_split_files_as_the_standard_library(spark, tmp_path, small_splits, monkeypatch, end):
    monkeypatch.setattr(csvsplit, "RUN", 3)
    for k in range(3):
        write(tmp_path / f"{k}.csv", messy(k, 150), end)
    lines = csvsplit._lines(spark, str(tmp_path))
    assert lines.select("file", "split").distinct().count() > 20
    rows = files.read_csv(spark, str(tmp_path))
    for k in range(3):
        mine = rows.filter(F.col(files.PATH).endswith(f"{k}.csv")).orderBy(files.ROW).collect()
        assert [r[files.ROW] for r in mine] == list(range(1, 151))
        assert [[r.id, r.note or "", r.mail] for r in mine] == read_back(tmp_path / f"{k}.csv")[1:]


def test_row_numbers_do_not_depend_on_splits(spark, tmp_path, small_splits):
    write(tmp_path / "a.csv", messy(7, 200))
    few = sorted((tuple(r) for r in files.read_csv(spark, str(tmp_path)).collect()), key=repr)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10m")
    assert few == sorted((tuple(r) for r in files.read_csv(spark, str(tmp_path)).collect()), key=repr)


def test_odd_files(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿x,y\n1\n\n,\n\"un\nclosed".encode())
    rows = files.read_csv(spark, str(tmp_path)).orderBy(files.ROW).collect()
    assert [(r.x, r.y) for r in rows] == [("1", None), (None, None), (None, None), ("un\nclosed", None)]
    for k, text in enumerate(["x,y\n1,2,3\n", "x,X\n", "", "_source_row\n1\n"]):
        (tmp_path / f"d{k}").mkdir()
        (tmp_path / f"d{k}" / "a.csv").write_text(text)
        with pytest.raises(Exception, match="more cells|repeat|no header|columns named"):
            files.read_csv(spark, str(tmp_path / f"d{k}")).collect()
    (tmp_path / "d0" / "b.csv").write_text("z\n1\n")
    with pytest.raises(ValueError, match="differ"):
        files.read_csv(spark, str(tmp_path / "d0"))


def test_scrub_csv(spark, tmp_path, small_splits):
    write(tmp_path / "a.csv", messy(9, 60))
    rows = scrub_csv(spark, str(tmp_path)).orderBy(files.ROW).collect()
    assert [r.mail for r in rows] == [f"[EMAIL_ADDRESS_{i + 1}]" for i in range(60)]


def test_large_file_is_a_failed_entry(spark, tmp_path):
    (tmp_path / "small.txt").write_text("mail a@b.org")
    (tmp_path / "large.txt").write_text("mail c@d.org " * 100)
    (tmp_path / "large.html").write_text("x" * 1000)
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "100")
    try:
        batch = scrub_folder(spark, str(tmp_path))
        assert [bytes(r.content) for r in batch.outputs.collect()] == [b"mail [EMAIL_ADDRESS_1]"]
        failed = batch.entries.filter("error_flag").collect()
        assert [r.error_message for r in failed] == [FILE_TOO_LARGE] and len(failed[0].source_hash) == 64
        assert batch.rejects.count() == 1
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")


def test_a_thousand_rows_in_a_folder_job(spark, tmp_path):
    """Parts are put in once, not searched for every cell."""
    write(tmp_path / "a.csv", [[str(i), "n", f"c{i}@example.com"] for i in range(5000)])
    out = scrub_folder(spark, str(tmp_path)).outputs.first().content.decode().splitlines()
    assert out[1] == "0,n,[EMAIL_ADDRESS_1]" and out[5000] == "4999,n,[EMAIL_ADDRESS_5000]"


def test_restore_folder(spark, tmp_path):
    """The counterpart of a folder job in pseudonymise mode, through stored files and mapping."""
    key = M.derive_key("secret", b"s" * 32, iterations=1000)
    source, out = tmp_path / "in", tmp_path / "out"
    (source / "sub").mkdir(parents=True)
    (out / "sub").mkdir(parents=True)
    (source / "a.txt").write_text("mail a@b.org, xc@d.orgx\nNI AB123456C")
    (source / "sub" / "t.csv").write_text("x,y\na@b.org,\"1\n2\"\n")
    batch = scrub_folder(spark, str(source), mode="pseudonymise", key=key, session_id="s")
    for r in batch.outputs.collect():
        (out / r.output_path.split("/in/")[1]).write_bytes(bytes(r.content))
    M.write_mapping(batch.mapping, str(tmp_path / "store"))
    store = spark.read.parquet(str(tmp_path / "store"))
    assert b"a@b.org" not in (out / "a_scrubbed.txt").read_bytes()
    done = {r.output_path.split("/out/")[1]: bytes(r.content).decode()
            for r in restore_folder(spark, str(out), store, "s", key).collect()}
    assert done == {"a_scrubbed_restored.txt": (source / "a.txt").read_text(),
                    "sub/t_scrubbed_restored.csv": (source / "sub" / "t.csv").read_text()}
    with pytest.raises(M.MappingError):
        restore_folder(spark, str(out), store, "other", key)
    with pytest.raises(M.MappingError):
        restore_folder(spark, str(out), store, "s", b"x" * 32)
