"""CSV files in pieces: nothing a task holds grows with the file, and the file comes back whole."""

import csv
import io
import random
import tracemalloc

from veilframe.operators import mapping as M
from veilframe.operators import substrings as Z
from veilframe.plans import batch as B
from veilframe.sources import csvfile as CSV

KEY = M.derive_key("secret", b"s" * 32, iterations=1000)


def messy(n):
    rng = random.Random(n)
    words = ["a", 'say "hi"', "two\nlines", "\n", "é,日", "", " ", "x\r\ny", '"', "NI AB123456C"]
    out = io.StringIO(newline="")
    rows = [["note", "mail"], *[["".join(rng.choices(words, k=rng.randint(0, 4))), f" c{i}@example.com "] for i in range(n)]]
    rows[n // 2:n // 2] = [[], [""], ["only"]]
    csv.writer(out, lineterminator="\n").writerows(rows)
    return out.getvalue().encode()


def test_pieces_are_the_rows_of_the_library():
    content = messy(9_000)
    rows, before = [], 0
    for first, cells, own in CSV._pieces(content):
        assert first == len(rows) and cells == before and sum(map(len, own)) <= CSV.PIECE_CELLS + 2
        before += len(CSV._cells(first, own))
        rows += own
    assert rows == list(csv.reader(io.StringIO(content.decode(), newline="")))
    assert len(list(CSV._pieces(content))) > 4 and list(CSV._pieces(b"")) == [(0, 0, [])]


def test_a_file_is_read_in_bounded_memory():
    """All cells of a file were held at once, each as an object with its name."""
    content = b"a,b\n" + b"".join(b"c%d@example.com,AB123456C\n" % n for n in range(60_000))
    tracemalloc.start()
    try:
        assert sum(len(CSV._cells(first, rows)) for first, _, rows in CSV._pieces(content)) == 120_000
        assert tracemalloc.get_traced_memory()[1] < 6_000_000
    finally:
        tracemalloc.stop()


def test_labels_go_on_from_piece_to_piece(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(messy(6_000))
    (done,) = B.scrub_folder(spark, str(tmp_path)).done.collect()
    old, new = CSV._rows(messy(6_000)), CSV._rows(bytes(done.content))
    mails = [row[1] for row in new[1:] if len(row) > 1]
    assert mails == [f"[EMAIL_ADDRESS_{n + 1}]" for n in range(6_000)] and done.counts["EMAIL_ADDRESS"] == 6_000
    assert [len(r) for r in new] == [len(r) for r in old] and done.error is None


def test_files_in_pieces_come_back(spark, tmp_path, monkeypatch):
    """Through many values as well, which are compared around their anchors before a file's are collected."""
    (tmp_path / "a.csv").write_bytes(messy(5_000))
    (tmp_path / "none.csv").write_bytes(b"x\n")
    (tmp_path / "bad.csv").write_bytes(b"x\n" * 5_000 + b"y" * 200_000 + b"\n")
    batch = B.scrub_folder(spark, str(tmp_path), mode="pseudonymise", key=KEY, session_id="s")
    done = {r.path.split("/")[-1]: r for r in batch.done.collect()}
    assert done["bad.csv"].error == "Error" and done["bad.csv"].content is None
    assert done["none.csv"].error is None and bytes(done["none.csv"].content) == b"x\n" and done["none.csv"].counts == {}
    assert not {f"c{n}@example.com" for n in range(5_000)} & {c for r in CSV._rows(bytes(done["a.csv"].content)) for c in r}
    pairs = M.replacements(batch.mapping, "s", KEY, Z.OCCURRENCES)
    want = [[c.strip() if c.strip() and n else c for c in row] for n, row in enumerate(CSV._rows(messy(5_000)))]
    for limit in (100_000, 0):
        monkeypatch.setattr(Z, "VALUE_LIMIT", limit)
        back = {r.path.split("/")[-1]: bytes(r.content) for r in B.restore_contents(batch.outputs, pairs).collect()}
        assert CSV._rows(back["a.csv"]) == want and back["none.csv"] == b"x\n"
