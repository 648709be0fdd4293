"""Line dedup over levelled sorted runs of line hashes.

Documents arrive in batches of descending doc_id. A batch's line hashes are merge-joined with
the runs: hashes that no run holds are new and get their largest doc_id as keeper, the others
only add to the count. The result becomes a new run; when a level holds FANOUT runs they are
compacted into one run of the next level.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

import pyarrow as pa
import xxhash
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.llm.common import map_texts, materialise, pieces, utf8
from veilframe.session import join_checked, join_sparse

MIN_CHARS = 40
MIN_DOCS = 5
BATCHES = 4
FANOUT = 3
#: Frequent keys go to the tasks up to this count (about 4 MB), else they are joined by a shuffle.
BROADCAST_KEYS = 150_000

#: The lists of runs in a store.
LISTED = "commit int, place int, level int, path string"


def line_key(line: bytes) -> bytes | None:
    """128-bit hash of a line without outer blanks and with A-Z lower-cased; None if the
    line is shorter than MIN_CHARS code points."""
    line = line.strip()
    if len(line) < MIN_CHARS:
        return None
    if len(line) < 4 * MIN_CHARS and len(line.decode("utf-8", "replace")) < MIN_CHARS:
        return None
    return xxhash.xxh3_128_digest(line.lower())


def _keys_factory():
    def one(text):
        if not text or len(text) < MIN_CHARS:
            return []
        return list({k for k in map(line_key, utf8(text).split(b"\n")) if k})

    return lambda texts: [([one(t) for t in texts], pa.list_(pa.binary()))]


def line_keys(docs: DataFrame) -> DataFrame:
    """``doc_id, key`` once for each document and key."""
    listed = map_texts(docs, ["doc_id"], "text", "keys array<binary>", _keys_factory)
    return listed.select("doc_id", F.explode("keys").alias("key")).distinct()


class Runs:
    """Levels of sorted runs ``(key, n_docs, keeper)``; a key has a keeper in one row only.

    With a ``store`` the runs are kept in this folder: ``save`` writes those that are not there
    yet and then, as the commit, a numbered list of all; ``open`` goes on from the last list,
    so later documents only bring their own keys.
    """

    def __init__(self, store: str | None = None) -> None:
        self.levels: list[list[DataFrame]] = [[]]
        self.store, self.commits = store, 0
        #: Stored runs and their paths.
        self.stored: list[tuple[DataFrame, str]] = []

    @classmethod
    def open(cls, spark: SparkSession, store: str) -> Runs:
        """The runs as last saved in ``store``; none if nothing was saved there."""
        runs = cls(store)
        try:
            listed = spark.read.schema(LISTED).parquet(f"{store}/lists")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return runs
        runs.commits = listed.agg(F.max("commit")).first()[0] or 0
        rows = listed.filter(F.col("commit") == runs.commits).orderBy("place").collect()
        for r in rows:
            while len(runs.levels) <= r["level"]:
                runs.levels.append([])
            run = spark.read.parquet(f"{store}/{r['path']}")
            runs.stored.append((run, r["path"]))
            runs.levels[r["level"]].append(run)
        return runs

    def save(self) -> None:
        """Write new runs, then the list. A save that fails leaves the list before it in force."""
        rows, stored = [], []
        for level, held in enumerate(self.levels):
            for i, run in enumerate(held):
                path = next((p for r, p in self.stored if r is run), None)
                if path is None:
                    path = f"runs/{uuid.uuid4().hex}"
                    run.write.parquet(f"{self.store}/{path}")
                    run = held[i] = run.sparkSession.read.parquet(f"{self.store}/{path}")
                stored.append((run, path))
                rows.append((self.commits + 1, len(rows), level, path))
        if rows:
            (stored[0][0].sparkSession.createDataFrame(rows, LISTED)
             .coalesce(1).write.mode("append").parquet(f"{self.store}/lists"))
            self.stored, self.commits = stored, self.commits + 1

    def frequent(self) -> DataFrame:
        """``f_key, keeper`` of the keys that at least MIN_DOCS documents hold."""
        return (compact(self.all()).filter(F.col("n_docs") >= MIN_DOCS)
                .select(F.col("key").alias("f_key"), "keeper"))

    def all(self) -> DataFrame | None:
        runs = [run for level in self.levels for run in level]
        return reduce(DataFrame.unionByName, runs) if runs else None

    def add(self, batch: DataFrame) -> None:
        """Merge-anti-join ``batch(doc_id, key)`` with the runs and add what is its own."""
        own = batch.groupBy("key").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("top"))
        known = self.all()
        if known is None:
            new = own.withColumnRenamed("top", "keeper")
        else:
            held = known.filter("keeper IS NOT NULL").select(F.col("key").alias("held"))
            new = own.join(held, F.col("key") == F.col("held"), "left").select(
                "key", "n_docs", F.when(F.col("held").isNull(), F.col("top")).alias("keeper"))
        self._put(0, materialise(new.sortWithinPartitions("key")))

    def _put(self, level: int, run: DataFrame) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= FANOUT:
            merged = compact(reduce(DataFrame.unionByName, self.levels[level]))
            self.levels[level] = []
            self._put(level + 1, materialise(merged.sortWithinPartitions("key")))


def compact(runs: DataFrame) -> DataFrame:
    return runs.groupBy("key").agg(F.sum("n_docs").alias("n_docs"),
                                   F.max("keeper").alias("keeper"))


def batches(keys: DataFrame) -> list[DataFrame]:
    """``keys`` in ranges of descending doc_id; rows without an id come last."""
    steps = [i / BATCHES for i in range(1, BATCHES)]
    cuts = keys.agg(F.percentile_approx("doc_id", steps, 1000)).first()[0] or []
    out, above = [], None
    doc = F.col("doc_id")
    for cut in sorted(set(cuts), reverse=True):
        inside = doc > cut if above is None else (doc > cut) & (doc <= above)
        out.append(keys.filter(inside))
        above = cut
    rest = doc.isNull() if above is None else doc.isNull() | (doc <= above)
    out.append(keys if above is None else keys.filter(rest))
    return out


def frequent_keys(docs: DataFrame) -> DataFrame:
    """``f_key, keeper``: keys of at least MIN_DOCS documents, with the document that keeps them."""
    keys = materialise(line_keys(docs))
    runs = Runs()
    for batch in batches(keys):
        runs.add(batch)
    return materialise(runs.frequent())


def _shorten(text: str | None, gone: Callable[[bytes], bool]) -> tuple[str, int, int]:
    """The text without the lines whose key is ``gone``, its lines, and the lines dropped."""
    lines = (text or "").split("\n")
    kept = [line for line in lines
            if len(line) < MIN_CHARS or (key := line_key(utf8(line))) is None or not gone(key)]
    return "\n".join(kept), len(lines), len(lines) - len(kept)


def _rewrite(packed: DataFrame, shorten: Callable[[pa.RecordBatch], list[tuple[str, int, int]]]) -> DataFrame:
    """``row`` and the three columns that ``shorten`` gives for each row of a batch."""
    schema = packed.schema["row"].dataType.simpleString()

    def run(parts):
        for batch in parts:
            for part in pieces(batch):
                done = shorten(part)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([d[0] for d in done], pa.string()),
                     pa.array([d[1] for d in done], pa.int64()),
                     pa.array([d[2] for d in done], pa.int64())],
                    names=["row", "kept_text", "n_lines", "n_dropped"])

    return packed.mapInArrow(
        run, f"row {schema}, kept_text string, n_lines bigint, n_dropped bigint")


def drop_lines(docs: DataFrame, frequent: DataFrame) -> DataFrame:
    """``row, kept_text, n_lines, n_dropped`` of every row, given materialised ``frequent_keys``.

    Up to BROADCAST_KEYS keys go to the tasks with their keepers, and lines are dropped where
    the texts are. More are joined to the keys of every row: a row's list of lost keys holds keys
    of its own text only, whether its id is null, repeated or its own, and rows without such a
    key are not joined to any.
    """
    text = docs.columns.index("text")
    few = frequent.limit(BROADCAST_KEYS + 1).collect()
    if len(few) <= BROADCAST_KEYS:
        keeper = {bytes(r["f_key"]): r["keeper"] for r in few}
        place = docs.columns.index("doc_id")

        def in_place(part):
            row = part.column(0)
            return [_shorten(t, lambda key, i=i: key in keeper and keeper[key] != i)
                    for t, i in zip(row.field(text).to_pylist(), row.field(place).to_pylist(), strict=True)]

        return _rewrite(docs.select(F.struct("*").alias("row")), in_place)

    packed = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"),
                         F.xxhash64(F.coalesce("text", F.lit(""))).alias("tag"))
    listed = map_texts(packed.select("id", "tag", "row.text"), ["id", "tag"], "text",
                       "keys array<binary>", _keys_factory)
    held = listed.select("id", "tag", F.explode("keys").alias("f_key")).distinct()
    lost = join_checked(held, frequent, ["f_key"], "inner", small=False).filter("NOT (id <=> keeper)")
    lists = materialise(lost.groupBy("id", "tag").agg(F.collect_list("f_key").alias("drop")))
    joined = join_sparse(packed, lists, ["id", "tag"], lists, "size(drop)")

    def by_list(part):
        gone = [set(d or ()) for d in part.column(1).to_pylist()]
        return [_shorten(t, g.__contains__)
                for t, g in zip(part.column(0).field(text).to_pylist(), gone, strict=True)]

    return _rewrite(joined.select("row", "drop"), by_list)


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``row`` (all columns of ``docs`` as struct), ``kept_text``, ``n_lines``, ``n_dropped``.

    A line whose key is found in at least MIN_DOCS documents is dropped everywhere but in
    the document with the largest doc_id holding it; other lines stay, in their order,
    joined by newlines. A null or empty text is one empty line and comes out empty. Rows
    without an id count as one document that is smaller than all others; repeated rows of
    an id are one document, too. An empty table gives an empty result.
    """
    return drop_lines(docs, frequent_keys(docs))


def add_documents(docs: DataFrame, store: str) -> DataFrame:
    """``drop_lines`` of documents that come after those whose runs are in ``store``; theirs are added.

    Lines count over all documents so far. ``docs`` holds other ids than before. A line that an
    earlier document keeps stays there; one that is new or was kept by none goes to the largest
    doc_id of this batch. The runs are saved before the result is read, so a batch whose output
    was lost is made again by ``drop_lines(docs, …)`` and not added twice.
    """
    runs = Runs.open(docs.sparkSession, store)
    for batch in batches(materialise(line_keys(docs))):
        runs.add(batch)
    runs.save()
    return drop_lines(docs, materialise(runs.frequent()))


def without_repeated_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with the new texts, and ``n_chars`` of the new text where that column exists."""
    done = dedup_lines(docs)
    new = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    return done.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


SQL = r"""
WITH rows_ AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
parts AS (SELECT r, doc_id, unnest(string_split(text, chr(10))) AS line,
    generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM rows_),
keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM parts),
frequent AS (SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
marked AS (SELECT k.*, f.key IS NOT NULL AND k.doc_id <> f.keeper AS gone
  FROM keyed k LEFT JOIN frequent f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY r, doc_id
"""
