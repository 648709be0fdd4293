import hashlib

import pytest

from veilframe.llm import exact


def brute(rows):
    best, size = {}, {}
    for i, t in rows:
        t = t or ""
        best[t] = max(best.get(t, -1), -1 if i is None else i)
        size[t] = size.get(t, 0) + 1
    return sorted((i, best[t or ""], size[t or ""], i == best[t or ""],
                   hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows)


@pytest.mark.parametrize("hot", [500, 3])
def test_against_brute_force(make_docs, monkeypatch, hot):
    """Once with groups below the hot bound, once with salted groups."""
    monkeypatch.setattr(exact, "HOT_ROWS", hot)
    head = "the same long head of many texts, "
    texts = [head + str(i % 37) for i in range(200)] + [None, "", " ", "a", "A"] + ["hot"] * 120
    rows = list(enumerate(texts))
    got = sorted(tuple(r) for r in exact.exact_duplicates(make_docs(rows)).collect())
    assert got == brute(rows)


def test_awkward_rows(awkward, no_docs, monkeypatch):
    for hot in (500, 1):
        monkeypatch.setattr(exact, "HOT_ROWS", hot)
        rows = exact.exact_duplicates(awkward).collect()
        assert len(rows) == awkward.count()
        kept = [r.text_sha256 for r in rows if r.kept]
        assert len(kept) == len(set(kept)) == len({r.text_sha256 for r in rows})
        assert {r.keep_id for r in rows if r.doc_id in (0, 1)} == {1}
        assert exact.exact_duplicates(no_docs).count() == 0


@pytest.mark.parametrize("part_rows", [20_000, 2])
def test_hot_text_with_null_and_repeated_ids(make_docs, monkeypatch, part_rows):
    """Its rows are spread as well; one row stays, and no row is lost or doubled."""
    monkeypatch.setattr(exact, "HOT_ROWS", 5)
    monkeypatch.setattr(exact, "PART_ROWS", part_rows)
    rows = [(None, "no id")] * 200 + [(7, "one id")] * 200 + [(None, "both"), (3, "both")] * 20 + [
        (i, "ids") for i in range(100)] + [(1, "cold"), (2, "cold")]
    got = exact.exact_duplicates(make_docs(rows)).collect()
    assert len(got) == len(rows)
    want = {"no id": (None, 200), "one id": (7, 200), "both": (3, 40), "ids": (99, 100), "cold": (2, 2)}
    for text, (keep, size) in want.items():
        mine = [r for r in got if r.text_sha256 == hashlib.sha256(text.encode()).hexdigest()]
        assert {(r.keep_id, r.group_size) for r in mine} == {(keep, size)} and len(mine) == size
        assert [r.doc_id for r in mine if r.kept] == [keep]


def test_rows_without_ids_get_many_salts(make_docs, monkeypatch):
    df = make_docs([(None, "t")] * 300).selectExpr(
        "*", "1L AS hot_hash", "true AS repeats", "64L AS parts")
    salts = [r.salt for r in exact._salted(df, True).collect()]
    assert len(salts) == 300 and len(set(salts)) > 40 and min(salts) >= 1 and max(salts) <= 64


def test_plan_has_no_python(make_docs):
    plan = exact.exact_duplicates(make_docs(["a", "b"]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "rangepartitioning" in plan
