import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece

from veilframe.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def texts():
    rng = random.Random(4)
    letters = [*" abcdetinos▁\n\t=-.é日𝒳\x00 ﻿", "  ", "the", "tion", "ing ", "====", "\r\n"]
    fixed = ["", " ", "  a", "▁", "▁▁ ▁", "<s>", "<unk></s>", "<0x0A>", "日本語テスト", "Ünïcödé", "é"]
    return (fixed + [" " * n for n in range(1, 70)] + [" " * n + "x" for n in range(1, 40)]
            + ["".join(rng.choice(letters) for _ in range(rng.randint(1, 80))) for _ in range(3_000)]
            + ["ab" * 5_000, "".join(rng.choice("abcdefinost") for _ in range(20_000))])


def test_equal_to_the_library(library):
    coder = pieces.Encoder(PATH)
    for t in texts():
        ids = coder.encode(t)
        assert ids == library.encode(t), t
        assert coder.decode(ids) == library.decode(ids)


def test_small_memory(library, monkeypatch):
    monkeypatch.setattr(pieces, "CACHE", 20)
    monkeypatch.setattr(pieces, "PAIRS", 50)
    coder = pieces.Encoder(PATH)
    for t in texts()[:600]:
        assert coder.encode(t) == library.encode(t)


def test_backtracking_is_needed():
    """The longest piece first is not always right, so pieces are taken back on the way."""
    coder = pieces.Encoder(PATH)
    greedy = differ = 0
    for t in texts()[150:700]:
        chunk = t.replace(" ", "▁").replace("\n", "")
        out, pos = [], 0
        while pos < len(chunk):
            piece = max((p for n in range(1, 17) if (p := chunk[pos:pos + n]) in coder.ids), key=len,
                        default=chunk[pos])
            out.append(piece)
            pos += len(piece)
        mine = [s if isinstance(s, str) else coder.pieces[s] for s in coder.segments(chunk)]
        assert mine == coder.remerged(chunk)
        greedy, differ = greedy + 1, differ + (mine != out)
    assert differ > greedy / 10


def test_awkward_rows(library, awkward, no_docs):
    got = pieces.digests(awkward, PATH, with_ids=True).collect()
    want = [library.encode(r.text or "") for r in awkward.collect()]
    assert [r.ids for r in got] == want
    for r, ids in zip(got, want, strict=True):
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    assert pieces.digests(no_docs, PATH).count() == 0
