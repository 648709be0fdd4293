"""SentencePiece encoding and decoding: exact merge-type encoding by backtracking.

A sequence of pieces is the merge encoding of a text exactly if every piece encodes to
itself and every two neighbours do. So the encoder walks the text with the longest piece
from an Aho-Corasick automaton, checks that each new piece is compatible with the one before
(by merging the two again), takes the next shorter piece if not, and steps back when no
piece fits; a bitfield remembers the positions from which no encoding was found.
"""

from __future__ import annotations

import hashlib

import ahocorasick
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import map_texts

SPACE = "▁"
#: Chunks kept per worker in each of two generations, the longest chunk that is kept, and
#: checked pairs kept.
CACHE, CACHED_CHARS, PAIRS = 250_000, 48, 400_000
NONE = -1


class Encoder:
    """Encoder and decoder over the pieces and scores of a merge-type (BPE) model."""

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        m = self.model
        self.ids, self.score, self.byte_ids = {}, {}, {}
        for i in range(m.vocab_size()):
            piece = m.id_to_piece(i)
            if m.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
            elif not (m.is_control(i) or m.is_unknown(i) or m.is_unused(i)):
                self.ids[piece], self.score[piece] = i, m.get_score(i)
        self.unknown = m.unk_id()
        self.pieces = list(self.ids)            # own numbers, in the order of the model
        number = {p: n for n, p in enumerate(self.pieces)}
        self.size = [len(p) for p in self.pieces]
        self.decimal = [str(self.ids[p]) for p in self.pieces]
        self.shorter = [next((number[p[:k]] for k in range(len(p) - 1, 0, -1) if p[:k] in number),
                             NONE) for p in self.pieces]
        self.automaton = ahocorasick.Automaton()
        for piece, n in number.items():
            self.automaton.add_word(piece, n)
        self.automaton.make_automaton()
        self.fits: list[dict[int, bool]] = [{} for _ in range(len(self.pieces) + 1)]
        self.n_fits = 0
        self.cache: dict[str, str] = {}         # chunk -> its ids in decimal, joined
        self.older: dict[str, str] = {}
        self.chunks = self._chunk_pattern()

    def _chunk_pattern(self):
        """Chunks that no piece reaches across, so that they are encoded on their own; the
        whole text is one chunk if a piece has a space after another character."""
        self.words_alone = False
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            return regex.compile(r"(?s).+")
        self.words_alone = not any("\n" in p for p in self.ids)
        inner = "" if any("\n" in p for p in self.ids) else "\n"
        alone = f"|{inner}" if inner else ""
        return regex.compile(f"{SPACE}+[^{SPACE}{inner}]*|[^{SPACE}{inner}]+{alone}")

    def remerged(self, text: str) -> list[str]:
        """Plain merging of a few characters: best score first, leftmost on ties."""
        parts = list(text)
        none = float("-inf")
        score = self.score.get
        scores = [score(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
        while scores and (best := max(scores)) > none:
            at = scores.index(best)
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
            del scores[at]
            if at:
                scores[at - 1] = score(parts[at - 1] + parts[at], none)
            if at < len(scores):
                scores[at] = score(parts[at] + parts[at + 1], none)
        return parts

    def compatible(self, left: int, piece: int) -> bool:
        """Whether the two merge to themselves; without a left one whether the piece does."""
        want = [self.pieces[piece]] if left == NONE else [self.pieces[left], self.pieces[piece]]
        known = self.remerged("".join(want)) == want
        if self.n_fits >= PAIRS:
            for row in self.fits:
                row.clear()
            self.n_fits = 0
        self.n_fits += 1
        self.fits[left][piece] = known
        return known

    def _longest_in_a_row(self, text: str) -> list[int] | None:
        """The longest pieces one after the other, if they cover the text and all fit."""
        size, fits = self.size, self.fits
        out: list[int] = []
        pos, left = 0, NONE
        for end, n in self.automaton.iter_long(text):
            fit = fits[left].get(n)
            if end - size[n] + 1 != pos or not (self.compatible(left, n) if fit is None else fit):
                return None
            out.append(n)
            left, pos = n, end + 1
        return out if pos == len(text) else None

    def segments(self, text: str) -> list[int | str]:
        """The pieces of ``text`` by number; a character that is no piece stands for itself."""
        if (easy := self._longest_in_a_row(text)) is not None:
            return easy
        length = len(text)
        size, shorter, fits, compatible = self.size, self.shorter, self.fits, self.compatible
        longest = [NONE] * length
        for end, n in self.automaton.iter(text):
            longest[end - size[n] + 1] = n      # ends ascend, so the longest comes last
        failed = bytearray((length >> 3) + 1)   # a bit per position that leads nowhere
        any_failed = False
        out: list[int | str] = []
        pos, left, piece, fresh = 0, NONE, NONE, True
        while pos < length:
            if fresh:
                piece = longest[pos]
                if piece == NONE:               # no piece starts here: the character is alone
                    out.append(text[pos])
                    left = NONE
                    pos += 1
                    continue
            row = fits[left]
            while piece != NONE:
                end = pos + size[piece]
                if not (any_failed and failed[end >> 3] >> (end & 7) & 1):
                    fit = row.get(piece)
                    if compatible(left, piece) if fit is None else fit:
                        break
                piece = shorter[piece]
            if piece != NONE:
                out.append(piece)
                pos, left, fresh = end, piece, True
                continue
            any_failed = True
            failed[pos >> 3] |= 1 << (pos & 7)
            piece = out.pop()   # not a lone character: after one, every piece has no left one
            pos -= size[piece]
            left = out[-1] if out and not isinstance(out[-1], str) else NONE
            fresh = False       # its end has failed now, so a shorter one is tried
        return out

    def _joined(self, chunk: str) -> str:
        """Ids of one chunk in decimal, joined."""
        decimal, byte_ids = self.decimal, self.byte_ids
        parts: list[str] = []
        for piece in self.segments(chunk):
            if not isinstance(piece, str):
                parts.append(decimal[piece])
            elif byte_ids:
                parts.extend(str(byte_ids[b]) for b in piece.encode("utf-8", "replace"))
            else:
                parts.append(str(self.unknown))
        return ",".join(parts)

    def _fresh(self, key: str) -> str:
        """Ids of a chunk that is not among the newest ones: ``word`` stands for a space and
        the word, a newline and a word for both without a space, and a blank in front for
        any other chunk."""
        made = self.older.get(key)
        if made is None:
            if key[:1] == " ":
                made = self._joined(key[1:])
            else:
                made = self._joined(key if key[:1] == "\n" else SPACE + key)
        if len(key) <= CACHED_CHARS:
            if len(self.cache) >= CACHE:    # what was not used since the last change is dropped
                self.older, self.cache = self.cache, {}
            self.cache[key] = made
        return made

    def joined_ids(self, text: str | None) -> str:
        """The ids of a text in decimal, joined by commas; empty for a null or empty text."""
        if not text:
            return ""
        plain = self.model.normalize(text)
        marked = plain.replace("\n", SPACE + "\n") if self.words_alone else ""
        if marked[:1] == SPACE and SPACE * 2 not in marked and marked[-1] != SPACE:
            keys = marked[1:].split(SPACE)
        else:
            keys = [" " + chunk for chunk in self.chunks.findall(plain)]
        parts = list(map(self.cache.get, keys))
        if None in parts:
            fresh = self._fresh
            for i, part in enumerate(parts):
                if part is None:
                    parts[i] = fresh(keys[i])
        return ",".join(parts)

    def encode(self, text: str | None) -> list[int]:
        return ids_of(self.joined_ids(text))

    def decode(self, ids: list[int]) -> str:
        return self.model.decode(ids)


def ids_of(joined: str) -> list[int]:
    return list(map(int, joined.split(","))) if joined else []


_loaded: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker process."""
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]


def encode_texts(docs: DataFrame, path: str, with_ids: bool = False,
                 keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, n_tokens, ids_sha256, decoded, and with ``with_ids`` the ids.

    Whole texts, without begin or end ids. Null and empty texts have no ids and decode to
    the empty text; repeated rows are encoded each; an empty table gives an empty result.
    ``path`` names a merge-type model that every worker can read.
    """
    def make():
        coder = encoder(path)

        def run(texts):
            joined = [coder.joined_ids(t) for t in texts]
            ids = [ids_of(j) for j in joined]
            out = [([len(i) for i in ids], pa.int64()),
                   ([hashlib.sha256(j.encode()).hexdigest() for j in joined], pa.string()),
                   ([coder.decode(i) for i in ids], pa.string())]
            return [*out, (ids, pa.list_(pa.int32()))] if with_ids else out

        return run

    schema = "n_tokens bigint,ids_sha256 string,decoded string"
    return map_texts(docs, list(keep), "text", schema + ",ids array<int>" * with_ids, make)


def digests(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` and, if asked for, ``ids``; one row per row of
    ``docs``, as ``encode_texts`` gives them."""
    done = encode_texts(docs, path, with_ids)
    return done.select("doc_id", "n_tokens", "ids_sha256",
                       F.sha2("decoded", 256).alias("decoded_sha256"), *["ids"] * with_ids)
