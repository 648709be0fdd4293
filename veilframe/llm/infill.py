"""Fill-in-the-middle texts, cut through a learned index of token borders.

A cut falls after a given number of tokens, so it needs the character offset of a token's
rank. The offsets of all borders of a text are covered by straight segments that miss none
of them by more than ERROR; what a segment misses is kept as one byte per border. An offset is
then the segment's prediction for the rank, put right by that byte.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import pieces

SEED = 1
#: In a hundred: documents that are rearranged, and of these the ones that begin with the suffix.
RATE, SUFFIX_FIRST = 90, 20
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"
#: Most that a segment may miss an offset by; residuals fit a signed byte.
ERROR = 100
#: Borders looked at together while a segment grows; doubled while it holds.
WINDOW = 512


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def borders(points: np.ndarray) -> np.ndarray:
    """Offsets at which tokens ``[A-Za-z]+|[^A-Za-z]`` begin, and the end of the text."""
    low = points | 32
    letter = (low >= 97) & (low <= 122) & (points < 128)
    begins = np.ones(len(points) + 1, bool)
    begins[1:-1] = ~(letter[1:] & letter[:-1])
    return np.flatnonzero(begins)


@dataclass
class RankIndex:
    """Segment k predicts ``offset[k] + slope[k] * (rank - rank0[k])`` for ranks from rank0[k] on."""

    rank0: np.ndarray
    offset: np.ndarray
    slope: np.ndarray
    residual: np.ndarray

    def predict(self, rank):
        k = np.searchsorted(self.rank0, rank, side="right") - 1
        return self.offset[k] + np.rint(self.slope[k] * (rank - self.rank0[k])).astype(np.int64)

    def __getitem__(self, rank: int) -> int:
        """The exact offset of a border: prediction plus residual."""
        return int(self.predict(rank)) + int(self.residual[rank])


def fit(offsets: np.ndarray) -> RankIndex:
    """Segments in one pass: each starts at a border and takes in the next ones as long as some
    slope passes all of them within the error."""
    rank0, slopes, at, n = [], [], 0, len(offsets)
    while at < n:
        low, high, end, width = -np.inf, np.inf, at + 1, WINDOW
        while end < n:
            more = offsets[end:end + width] - offsets[at]
            steps = np.arange(end - at, end - at + len(more))
            lows = np.maximum(np.maximum.accumulate((more - ERROR) / steps), low)
            highs = np.minimum(np.minimum.accumulate((more + ERROR) / steps), high)
            broken = lows > highs
            good = int(broken.argmax()) if broken.any() else len(more)
            if good:
                low, high = lows[good - 1], highs[good - 1]
            end += good
            if good < len(more):
                break
            width *= 2
        rank0.append(at)
        slopes.append((low + high) / 2 if end > at + 1 else 0.0)
        at = end
    starts = np.array(rank0, np.int64)
    index = RankIndex(starts, offsets[starts], np.array(slopes), np.zeros(0, np.int8))
    index.residual = (offsets - index.predict(np.arange(n))).astype(np.int8)
    return index


def rearranged(doc_id, text: str | None, seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST):
    """``(n, form, prefix_chars, middle_chars, output, segments)`` of one text."""
    text = text or ""
    index = fit(borders(code_points(text)))
    n = len(index.residual) - 1
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k:8 * k + 8], 16) for k in range(4))
    if not text or h3 % 100 >= rate or PREFIX in text or SUFFIX in text or MIDDLE in text:
        return n, PLAIN, None, None, text, len(index.rank0)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    i, j = index[a], index[b]
    prefix, middle, suffix = text[:i], text[i:j], text[j:]
    if h4 % 100 < suffix_first:
        form, output = SPM, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    else:
        form, output = PSM, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"
    return n, form, i, j - i, output, len(index.rank0)


_FIELDS = (("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()),
           ("output", pa.string()), ("segments", pa.int64()))


def fill_in_middle(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *, seed: int = SEED,
                   rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output, segments`` for every row.

    The cuts and the form of a document follow from a hash of seed and id alone. A text that is
    empty or holds a marker stays plain; a null text counts as empty, a null id as empty digits.
    Repeated rows give equal rows; an empty table gives none. A text is worked on in one task,
    in time and memory linear in its length. Other columns are ignored.
    """
    def run(batches):
        for batch in batches:
            for part in pieces(batch):
                done = [rearranged(i, t, seed, rate, suffix_first)
                        for i, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)]
                columns = list(zip(*done, strict=True)) or [[] for _ in _FIELDS]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *(pa.array(c, kind) for c, (_, kind) in zip(columns, _FIELDS, strict=True))],
                    names=["doc_id", *(name for name, _ in _FIELDS)])

    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        run, "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string, "
             "segments bigint")


def restored(output: str = "output", form: str = "form") -> str:
    """SQL expression of the text that an output of a form was made from.

    Markers are found from the left; texts that hold one are always plain, and no marker's end is
    another's beginning, so the first occurrence is the one that was put there.
    """
    def parts(first: str, second: str) -> tuple[str, str, str]:
        begin, skip = len(first) + 1, len(second)
        at = f"locate('{second}', {output}, {begin})"
        end = f"locate('{MIDDLE}', {output}, {at} + {skip})"
        return (f"substring({output}, {begin}, {at} - {begin})",
                f"substring({output}, {at} + {skip}, {end} - {at} - {skip})",
                f"substring({output}, {end} + {len(MIDDLE)})")

    p, s, m = parts(PREFIX, SUFFIX)
    s2, p2, m2 = parts(SUFFIX, PREFIX)
    return (f"CASE {form} WHEN '{PSM}' THEN concat({p}, {m}, {s}) WHEN '{SPM}' THEN concat({p2}, {m2}, {s2}) "
            f"ELSE {output} END")


def digests(docs: DataFrame) -> DataFrame:
    """``fill_in_middle`` with digests of output and restored text in place of the output."""
    done = fill_in_middle(docs)
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                       F.sha2(F.expr(restored()), 256).alias("restored_sha256"))


def _word(k: int) -> str:
    return f"CAST('0x' || substr(h, {8 * k + 1}, 8) AS BIGINT)"


#: The same rows for DuckDB; a text is restored from its own parts.
SQL = f"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
    regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS toks FROM documents),
c AS (
  SELECT *, CAST(len(toks) AS BIGINT) AS n, {_word(0)} % (len(toks) + 1) AS x, {_word(1)} % (len(toks) + 1) AS y,
    CASE WHEN text = '' OR contains(text, '{PREFIX}') OR contains(text, '{SUFFIX}') OR contains(text, '{MIDDLE}')
      OR {_word(2)} % 100 >= {RATE} THEN '{PLAIN}' WHEN {_word(3)} % 100 < {SUFFIX_FIRST} THEN '{SPM}'
      ELSE '{PSM}' END AS form FROM t),
p AS (
  SELECT *, array_to_string(toks[1:least(x, y)], '') AS pre,
    array_to_string(toks[least(x, y) + 1:greatest(x, y)], '') AS mid,
    array_to_string(toks[greatest(x, y) + 1:], '') AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> '{PLAIN}' THEN length(pre) END AS prefix_chars,
  CASE WHEN form <> '{PLAIN}' THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN '{PLAIN}' THEN text WHEN '{PSM}' THEN '{PREFIX}' || pre || '{SUFFIX}' || suf || '{MIDDLE}' || mid
    ELSE '{SUFFIX}' || suf || '{PREFIX}' || pre || '{MIDDLE}' || mid END) AS output_sha256,
  sha256(CASE WHEN form = '{PLAIN}' THEN text ELSE pre || mid || suf END) AS restored_sha256
FROM p"""
