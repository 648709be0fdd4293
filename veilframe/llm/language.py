"""Language identification by prediction by partial matching (PPM).

For each language a variable-order tree of byte contexts is counted once and then frozen. The
code length of a byte is that of the longest context which has seen it, plus the escapes of
the longer contexts that have not (escape method C). A document gets the language whose
tree encodes it in the fewest bits. Contexts start at a word's leading blank, so the code
length of a word is a constant, and words met before are looked up.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilframe.llm.common import crc_mod, map_texts, materialise, pieces, utf8

#: Documented bounds of the fit: whole documents per language (the first by a hash of their
#: id), and bytes of such a document; longer ones are taken, whole, only where a language has
#: fewer documents than that. Every language is learned.
TRAIN_DOCS, TRAIN_BYTES = 400, 65_536
#: Languages in one joint table; its rows grow with its languages too, so more go to further
#: tables, and the shortest code of all tables wins.
LANGUAGES = 50
#: Languages up to which their counts and chosen ids are broadcast, else joined by a shuffle.
BROADCAST_LANGUAGES = 2_000
ORDER = 4
UNKNOWN = "und"
CACHE, CACHED_BYTES, SLICE = 200_000, 48, 50_000


def units(text: str | None) -> list[bytes]:
    return utf8(text.lower()).split() if text else []


@dataclass
class Trees:
    """Joint table of all languages.

    ``rows[context + byte]`` and ``escapes[context]`` are row numbers of ``bits`` (one column
    per language). The first holds whole code lengths, escapes of longer contexts included
    for those languages that need them; the second what a byte costs that no language has
    seen in this context.
    """
    languages: list[str]
    rows: dict[bytes, int]
    escapes: dict[bytes, int]
    bits: np.ndarray

    def path(self, unit: bytes) -> list[int]:
        """Rows whose sum is the code length of a word."""
        out: list[int] = []
        data = b" " + unit + b" "
        rows, escapes = self.rows, self.escapes
        for i in range(1, len(data)):
            for k in range(min(ORDER, i), -1, -1):
                row = rows.get(data[i - k:i + 1])
                if row is not None:
                    out.append(row)
                    break
                row = escapes.get(data[i - k:i])
                if row is not None:
                    out.append(row)
            else:
                out.append(0)       # the uniform code of a byte
        return out

    def code_length(self, unit: bytes) -> np.ndarray:
        return self.bits[self.path(unit)].sum(axis=0, dtype=np.float64)


def build(counts: dict[str, Counter]) -> Trees:
    """Trees from the word counts of each language."""
    languages = sorted(counts)
    seen: list[dict[bytes, dict[int, int]]] = []
    for lang in languages:
        nodes: dict[bytes, dict[int, int]] = defaultdict(lambda: defaultdict(int))
        for unit, n in counts[lang].items():
            data = b" " + unit + b" "
            for i in range(1, len(data)):
                for k in range(min(ORDER, i) + 1):
                    nodes[data[i - k:i]][data[i]] += n
        seen.append(nodes)
    contexts = sorted(set().union(*seen), key=lambda c: (len(c), c)) if seen else []
    size = len(languages)
    table: list[np.ndarray] = [np.full(size, 8.0)]
    rows: dict[bytes, int] = {}
    escapes: dict[bytes, int] = {}

    def whole(context: bytes, byte: int) -> np.ndarray:
        """Code lengths of a byte after a context, from the longest known suffix down."""
        total = np.zeros(size)
        while True:
            row = rows.get(context + bytes([byte]))
            if row is not None:
                return total + table[row]
            if context in escapes:
                total = total + table[escapes[context]]
            if not context:
                return total + table[0]
            context = context[1:]

    for context in contexts:        # short contexts first
        nodes = [s.get(context) for s in seen]
        total = np.array([sum(n.values()) if n else 0 for n in nodes], dtype=float)
        kinds = np.array([len(n) if n else 0 for n in nodes], dtype=float)
        with np.errstate(divide="ignore", invalid="ignore"):
            escape = np.where(kinds > 0, np.log2((total + kinds) / kinds), 0.0)
        made = []
        for byte in sorted(set().union(*(n for n in nodes if n))):
            own = np.array([n.get(byte, 0) if n else 0 for n in nodes], dtype=float)
            below = whole(context[1:], byte) if context else table[0]
            with np.errstate(divide="ignore"):
                direct = np.log2((total + kinds) / np.maximum(own, 1e-300))
            made.append((byte, np.where(own > 0, direct, escape + below)))
        for byte, bits in made:
            rows[context + bytes([byte])] = len(table)
            table.append(bits)
        escapes[context] = len(table)
        table.append(escape)
    return Trees(languages, rows, escapes, np.array(table, dtype=np.float32).reshape(len(table), size))


class Scorer:
    """Code lengths of whole texts; words met before are looked up, in bounded memory."""

    def __init__(self, trees: Trees, most: int | None = None):
        self.trees = trees
        self.most = CACHE if most is None else most
        self.known: dict[bytes, int] = {}
        self.bits = np.zeros((self.most, len(trees.languages)), dtype=np.float32)

    def _add(self, fresh: list[bytes]) -> None:
        paths = [self.trees.path(u) for u in fresh]
        sizes = np.array([len(p) for p in paths])
        flat = np.fromiter((r for p in paths for r in p), dtype=np.int64, count=int(sizes.sum()))
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        at = len(self.known)
        self.bits[at:at + len(fresh)] = np.add.reduceat(self.trees.bits[flat], starts, axis=0)
        self.known.update(zip(fresh, range(at, at + len(fresh)), strict=True))

    def __call__(self, text: str) -> np.ndarray:
        total = np.zeros(len(self.trees.languages))
        words = units(text)
        for start in range(0, len(words), SLICE):
            part = words[start:start + SLICE]
            known = self.known
            fresh = {u for u in part if u not in known}
            long = {u for u in fresh if len(u) > CACHED_BYTES}
            for unit in part if long else ():
                if unit in long:
                    total += self.trees.code_length(unit)
            fresh -= long
            if fresh and len(known) + len(fresh) > self.most:
                known.clear()
                fresh = set(part) - long
            if fresh:
                self._add(list(fresh))
            rows = [known[u] for u in part if u not in long] if long else [known[u] for u in part]
            if rows:
                total += self.bits[rows].sum(axis=0, dtype=np.float64)
        return total


class Blocks:
    """Code lengths over all tables; what the scorers keep of words is shared among them."""

    def __init__(self, trees: list[Trees]):
        self.languages = [lang for t in trees for lang in t.languages]
        self.scorers = [Scorer(t, max(min(SLICE, CACHE), CACHE // len(trees))) for t in trees]

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.languages or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0
        bits = np.concatenate([s(text) for s in self.scorers])
        best = int(np.argmin(bits))
        return self.languages[best], float(1 / np.exp2(np.maximum(bits[best] - bits, -500)).sum())


def training_words(docs: DataFrame) -> DataFrame:
    """``lang, word, n`` over the bounded sample of documents that are not held out."""
    long = F.octet_length("text") > TRAIN_BYTES
    texts = docs.select("doc_id", "lang", "text", long.alias("long")).filter(
        F.col("text").rlike("[^\\x20\\x09-\\x0D]"))
    usable = (texts.filter(F.col("lang").isNotNull() & (crc_mod(F.col("doc_id"), 4) != 2))
              .groupBy("doc_id", "lang").agg(F.min("long").alias("long")))
    sizes = materialise(usable.groupBy(F.col("lang").alias("of")).agg(
        F.count_if("long").alias("n_long"), F.count_if(~F.col("long")).alias("n_short")))
    few = sizes.limit(BROADCAST_LANGUAGES + 1).count() <= BROADCAST_LANGUAGES
    sized = F.broadcast if few else lambda df: df
    # of a large language only the lowest hashes are ranked, about eight times those needed
    share = F.lit(8.0 * TRAIN_DOCS) / F.when(F.col("long"), F.col("n_long")).otherwise(F.col("n_short"))
    wanted = ~F.col("long") | (F.col("n_short") < TRAIN_DOCS)
    low = F.xxhash64("doc_id").cast("double") <= (2.0 * share - 1.0) * 2.0 ** 63
    near = usable.join(sized(sizes), F.col("lang") == F.col("of")).filter(low & wanted)
    order = Window.partitionBy("of").orderBy("long", F.xxhash64("doc_id"), "doc_id")
    ids = (near.withColumn("place", F.row_number().over(order))
           .filter(F.col("place") <= TRAIN_DOCS).select(F.col("doc_id").alias("id"), "of", F.col("long").alias("of_long")))
    rows = texts.join(sized(ids), F.col("doc_id").eqNullSafe(F.col("id"))
                      & (F.col("lang") == F.col("of")) & (F.col("long") == F.col("of_long")))

    def run(batches):
        for batch in batches:
            for part in pieces(batch):
                counts: Counter = Counter()
                for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(),
                                      strict=True):
                    counts.update((lang, u) for u in units(text))
                keys = list(counts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k[0] for k in keys], pa.string()),
                     pa.array([k[1] for k in keys], pa.binary()),
                     pa.array(list(counts.values()), pa.int64())], names=["lang", "word", "n"])

    return (rows.select("lang", "text").mapInArrow(run, "lang string, word binary, n bigint")
            .groupBy("lang", "word").agg(F.sum("n").alias("n")))


def train(docs: DataFrame) -> list[Trees]:
    """Tables of at most LANGUAGES languages each, in the order of their names. The driver holds
    the word counts of one table's languages at a time."""
    words = materialise(training_words(docs))
    languages = sorted(r.lang for r in words.select("lang").distinct().collect())
    found = []
    for start in range(0, len(languages), LANGUAGES):
        block = languages[start:start + LANGUAGES]
        part = words.filter(F.col("lang").isin(block)) if len(languages) > LANGUAGES else words
        counts: dict[str, Counter] = defaultdict(Counter)
        got = part.toArrow()
        for lang, word, n in zip(*(got.column(c).to_pylist() for c in ("lang", "word", "n")),
                                 strict=True):
            counts[lang][word] += n
        found.append(build(counts))
    return found


def identify(docs: DataFrame, trees: list[Trees]) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every row of ``docs``.

    The whole text is scored; the score is the share of the predicted language among the
    probabilities that the trees give the text. Texts that are null or have no letter, and
    all texts if nothing could be learned, are ``und`` with score 0. Ties go to the first
    language by name; repeated rows get equal results; an empty table an empty result.
    """
    def make():
        scorer = Blocks(trees)

        def run(texts):
            found = [scorer.predict(t) for t in texts]
            return [([f[0] for f in found], pa.string()), ([f[1] for f in found], pa.float64())]

        return run

    scored = map_texts(docs, ["doc_id"], "text", "lang_pred string,score double", make)
    return scored.select("doc_id", (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"),
                         "lang_pred", "score")


def language(docs: DataFrame) -> DataFrame:
    """``identify`` with trees learned from the rows that are not held out; null languages and texts
    are not learned from, and an empty table gives an empty result."""
    return identify(docs, train(docs))
