"""Fill-in-the-middle texts against a plain version, and the rank index against its offsets."""

import hashlib
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from veilframe.llm import infill as I


def brute(doc_id, text):
    """``(n, form, prefix_chars, middle_chars, output)``."""
    text = text or ""
    tokens = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    n = len(tokens)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[k:k + 8], 16) for k in (0, 8, 16, 24)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if h[3] % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


TEXTS = ["", None, "a", "<", "<P", "x<M>y", "<S>", "<<<<SSS>>P><M", "é日本 abİK", "\U0001f600a\U0001f600", "A" * 3000, "nul\x00b",
         "Letter for J S\nNI AB123456C, j@x.co.uk", "word " * 40_000, "a b" * 10 + " " * 5000 + "b" * 5000]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_fill_in_middle(spark, make_docs):
    rows = [(i, TEXTS[i % len(TEXTS)]) for i in range(150)] + [(None, "no id here"), (None, None), (3, "one two"), (3, "one two")]
    docs = make_docs(rows, extra=True)
    done = I.fill_in_middle(docs).selectExpr("doc_id", "n", "form", "prefix_chars", "middle_chars", "output",
                                             f"{I.restored()} AS back")
    got = sorted((tuple(r) for r in done.collect()), key=repr)
    assert got == sorted(((i, *brute(i, t), t or "") for i, t in rows), key=repr)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    digests = {(r.doc_id, r.output_sha256, r.restored_sha256) for r in I.digests(docs).collect()}
    assert digests == {(i, sha(brute(i, t)[4]), sha(t or "")) for i, t in rows}


def test_empty_table(no_docs):
    assert I.digests(no_docs).count() == 0


def test_rates(make_docs):
    docs = make_docs([(i, "some words to cut, all alike") for i in range(200)])
    assert {r.form for r in I.fill_in_middle(docs, rate=0).collect()} == {"plain"}
    assert {r.form for r in I.fill_in_middle(docs, rate=100, suffix_first=100).collect()} == {"spm"}


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab <PSM>\né\U0001f600"), max_size=40), st.integers(0, 10**6))
def test_markers_and_borders(text, doc_id):
    assert I.rearranged(doc_id, text)[:5] == brute(doc_id, text)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 400), min_size=1, max_size=3000), st.integers(1, 5))
def test_rank_index(gaps, repeat):
    """Every offset is exact, no segment misses one by more than the error, and residuals fit."""
    offsets = np.concatenate([[0], np.cumsum(gaps * repeat)])
    index = I.fit(offsets)
    assert [index[k] for k in range(len(offsets))] == offsets.tolist()
    assert np.abs(offsets - index.predict(np.arange(len(offsets)))).max() <= I.ERROR + 1
    assert index.residual.dtype == np.int8


def test_segments_are_few():
    """A long regular text needs one segment, however many windows it spans."""
    assert len(I.fit(I.borders(I.code_points("word and " * 50_000))).rank0) == 1
