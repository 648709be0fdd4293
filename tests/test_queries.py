"""Registered queries against their reference SQL at the smallest scale."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check import rows

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")

SAMPLE = ("redact_documents", "detect_planted", "scrub_conversations", "rebuild_table",
          "pseudo_consistent", "map_upsert", "det_person", "chunk_lines", "gen_nhs",
          "audit_export", "rebuild_email", "overlap_pairs", "stream_counts")


def test_every_query_has_reference_sql():
    assert set(entry.registered.QUERIES) == set(entry.registered.ORACLE)
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["doc_id", "scrubbed_text"] and df.count() == 200


@pytest.mark.parametrize("name", SAMPLE)
def test_query(spark, name):
    con = duckdb.connect()
    for f in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{FOLDER}/{f}'")
    df = entry.queries()[name](spark, FOLDER)
    cur = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.columns, df.collect()) == rows(columns, cur.fetchall())
