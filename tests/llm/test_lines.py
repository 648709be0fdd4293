import hashlib

import pytest

from veilframe.llm import lines

BLANKS = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows):
    held = {}
    key = lambda line: line.strip(BLANKS).translate(LOWER)
    for i, t in rows:
        for line in (t or "").split("\n"):
            held.setdefault(key(line), set()).add(i)
    gone = {k: max(v) for k, v in held.items() if len(k) >= 40 and len(v) >= 5}
    out = []
    for i, t in rows:
        own = (t or "").split("\n")
        kept = [line for line in own if gone.get(key(line), i) == i]
        out.append((i, len(own), len(own) - len(kept),
                    hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("batches, in_place", [(1, True), (4, True), (9, False)])
def test_against_brute_force(make_docs, monkeypatch, batches, in_place):
    """Some runs are compacted on the way: FANOUT is below the number of batches. With more
    frequent keys than go to the tasks, rows are joined with the keys they lose."""
    monkeypatch.setattr(lines, "BATCHES", batches)
    if not in_place:
        monkeypatch.setattr(lines, "BROADCAST_KEYS", 0)
    common = [f"Line number {k} that many of the documents share, word for word" for k in range(12)]
    edge = ["é" * 40, "é" * 39, "x" * 40, "x" * 39, "\xa0" + "y" * 39]
    texts = []
    for i in range(60):
        own = [f"own {i}", "", common[i % 12], "  " + common[(i * 5) % 12].upper() + "\t", edge[i % 5], edge[i % 3]]
        texts.append("\n".join(own) + ("\n" if i % 7 == 0 else ""))
    rows = [*enumerate(texts), (100, None), (101, ""), (102, "\n\n")]
    done = lines.dedup_lines(make_docs(rows)).selectExpr(
        "row.doc_id", "n_lines", "n_dropped", "sha2(kept_text, 256) AS s")
    assert sorted(tuple(r) for r in done.collect()) == brute(rows)


def test_batches_are_added_to_stored_runs(spark, make_docs, tmp_path):
    """Every batch sees the lines of all before it; a line keeps the document it was given."""
    store = f"file://{tmp_path}/runs"
    line = "Line number {} that many of the documents share, word for word".format
    held, keeper = {}, {}
    for n in range(5):
        rows = [(100 * n + i, "\n".join([f"own {n} {i}", line(i % 4), line(n)])) for i in range(8)]
        got = {r.doc_id: r.kept_text for r in lines.add_documents(make_docs(rows), store)
               .selectExpr("row.doc_id", "kept_text").collect()}
        for i, text in rows:
            for part in set(text.split("\n")):
                held.setdefault(part, set()).add(i)
        for part, ids in held.items():
            keeper.setdefault(part, max(ids))
        for i, text in rows:
            want = [part for part in text.split("\n")
                    if len(part) < 40 or len(held[part]) < 5 or keeper[part] == i]
            assert got[i] == "\n".join(want)
    levels = lines.Runs.open(spark, store).levels
    assert sum(map(len, levels)) < 5 * lines.BATCHES
    assert all(len(level) < lines.FANOUT for level in levels)


@pytest.mark.parametrize("keys", [150_000, 0])
def test_rows_without_ids_lose_lines_of_their_own(make_docs, monkeypatch, keys):
    """Many rows without an id: no list holds a key of another row's text."""
    monkeypatch.setattr(lines, "BROADCAST_KEYS", keys)
    line = "Line number {} that many of the documents share, word for word".format
    rows = [(None, "\n".join(line(50 * i + k) for k in range(50))) for i in range(4)]
    rows += [(j, "\n".join(line(k) for k in range(200))) for j in range(5)]
    done = lines.dedup_lines(make_docs(rows + rows[:1] * 3)).selectExpr("row.doc_id", "n_dropped").collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_dropped) for r in done) == (
        [(-1, 50)] * 7 + [(0, 200), (1, 200), (2, 200), (3, 200), (4, 0)])


@pytest.mark.parametrize("keys", [150_000, 0])
def test_awkward_rows(make_docs, awkward, no_docs, monkeypatch, keys):
    monkeypatch.setattr(lines, "BROADCAST_KEYS", keys)
    out = lines.without_repeated_lines(awkward)
    assert out.columns == awkward.columns and out.count() == awkward.count()
    assert out.filter("n_chars <> length(text)").count() == 0
    assert lines.without_repeated_lines(no_docs).count() == 0
    long = "one line that is long enough to be looked at, more than forty"
    again = make_docs([(7, long)] * 6 + [(None, long), (None, long), (1, long), (2, long)])
    assert lines.dedup_lines(again).filter("n_dropped > 0").count() == 0    # four documents
    again = again.unionByName(make_docs([(3, long)]))
    done = {r.doc_id: r.n_dropped for r in lines.dedup_lines(again).selectExpr(
        "row.doc_id", "n_dropped").collect()}
    assert done == {7: 0, None: 1, 1: 1, 2: 1, 3: 1}
