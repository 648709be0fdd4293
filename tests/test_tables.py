"""Whole tables: sparse joins, and tables with all options of ``scrub``."""

import pytest
from pyspark.sql import functions as F

from veilframe import Gazetteer, session
from veilframe.operators import mapping as M
from veilframe.operators import pseudonymise as P
from veilframe.operators.redact import redact_chunks
from veilframe.plans import batch as B
from veilframe.session import join_sparse

KEY = M.derive_key("secret", b"s" * 32, iterations=1000)
ROWS = [(1, "a@b.org and NI AB123456C", " "), (2, None, None), (2, "tel a@b.org", "x"), (2, "tel a@b.org", "x"),
        (None, " c@d.org ", "a@b.org"), (3, "", "Ann Lee was here")]


def table(spark):
    return spark.createDataFrame(ROWS, "r int, a string, b string")


@pytest.mark.parametrize("most", [100_000, 0])
def test_sparse_join(spark, monkeypatch, most):
    """By broadcast and through the table of bits, with null keys and keys without a partner."""
    monkeypatch.setattr(session, "BROADCAST_ROW_LIMIT", most)
    left = spark.createDataFrame([(i % 7 or None, str(i)) for i in range(100)], "k int, v string")
    right = spark.createDataFrame([(None, "n"), (3, "t"), (99, "u")], "k int, w string")
    got = sorted((r.k or 0, r.v, r.w) for r in join_sparse(left, right, ["k"], right).collect())
    assert got == sorted((i % 7, str(i), {0: "n", 3: "t"}.get(i % 7)) for i in range(100))
    none = join_sparse(left, right.limit(0), ["k"], right.limit(0))
    assert none.filter("w IS NOT NULL").count() == 0 and none.count() == 100


def test_texts_without_spans_are_not_shuffled(spark, monkeypatch):
    texts = [(1, i, f"item {i}" if i % 10 else f"u{i}@b.org") for i in range(200)]
    df = spark.createDataFrame(texts, "d int, o int, t string").repartition(3)
    want = sorted(map(tuple, redact_chunks(df, "d", "o", "t").select("o", "scrubbed_text").collect()))
    monkeypatch.setattr(session, "BROADCAST_ROW_LIMIT", 0)
    monkeypatch.setattr(session, "BITS_PER_KEY", 4096)
    got = sorted(map(tuple, redact_chunks(df, "d", "o", "t").select("o", "scrubbed_text").collect()))
    assert got == want and got[10] == (10, "[EMAIL_ADDRESS_2]") and got[11] == (11, "item 11")


@pytest.mark.parametrize("most", [100_000, 0])
@pytest.mark.parametrize("extra", [False, True])
def test_pseudonymised_table(spark, monkeypatch, most, extra):
    """Null and repeated row numbers, blank cells; restoring gives the stripped cells back."""
    monkeypatch.setattr(session, "BROADCAST_ROW_LIMIT", most)
    names = spark.createDataFrame([("Ann Lee",)], "full_name string")
    how = {"gazetteers": [Gazetteer("PERSON", names, "full_name")]} if extra else {}
    done = B.scrub_cells(table(spark), "r", ["a", "b"], mode="pseudonymise", key=KEY, session_id="s", **how)
    rows = done.texts.collect()
    out = " ".join(f"{r.a} {r.b}" for r in rows)
    assert len(rows) == len(ROWS) and "b.org" not in out and "AB123456C" not in out
    assert ("Ann Lee" not in out) is extra
    assert done.mapping.count() == 3 + extra
    assert sum(r.entity_counts.get("EMAIL_ADDRESS", 0) for r in rows) == 5
    pairs = M.replacements(done.mapping, "s", KEY)
    for c in ("a", "b"):
        back = P.restore_documents(done.texts, "r", c, pairs).collect()
        assert sorted(str(r.restored_text) for r in back) == sorted(
            str(x if x is None or not x.strip() else x.strip()) for x in (row[1 + (c == "b")] for row in ROWS))


def test_later_run_keeps_fakes_and_options_are_tested(spark):
    first = B.scrub_cells(table(spark), "r", ["a"], mode="pseudonymise", key=KEY, session_id="s")
    later = B.scrub_cells(table(spark), "r", ["b"], mode="pseudonymise", key=KEY, session_id="s",
                          mapping=first.mapping)
    fake = first.texts.filter("r = 2 AND a IS NOT NULL").first().a.split()[1]
    assert later.texts.filter("r IS NULL").first().b == fake and later.mapping.count() == 0
    with pytest.raises(ValueError):
        B.scrub_cells(table(spark), "r", ["a"], mode="pseudonymise")
    with pytest.raises(ValueError):
        B.scrub_cells(table(spark), "r", ["a"], mode="other")


def test_redacted_table_counts_and_entities(spark):
    done = B.scrub_cells(table(spark), "r", ["a", "b"], entities="email_address").texts
    rows = done.filter("r = 1").collect()
    assert rows[0].a == "[EMAIL_ADDRESS_3] and NI AB123456C" and rows[0].entity_counts == {"EMAIL_ADDRESS": 1}
    assert done.filter(F.size("entity_counts") == 0).count() == 2
    empty = B.scrub_cells(table(spark).limit(0), "r", ["a"], mode="pseudonymise", key=KEY, session_id="s")
    assert empty.texts.count() == 0 and empty.mapping.count() == 0


def test_csv_pseudonymised(spark, tmp_path):
    (tmp_path / "t.csv").write_text("name,mail\nx,a@b.org\ny,\nz,a@b.org\n")
    done = B.scrub_csv_files(spark, str(tmp_path / "t.csv"), mode="pseudonymise", key=KEY, session_id="s")
    mails = [r.mail for r in done.texts.orderBy(B.FI.ROW).collect()]
    assert mails[0] == mails[2] != "a@b.org" and not mails[1]
