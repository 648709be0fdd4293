"""Pseudonymise and restore: consistent, reversible replacement through a mapping."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.functions import checksums as C
from veilframe.functions import layout as L
from veilframe.functions import rules as R
from veilframe.functions import spans as S
from veilframe.functions import text as X
from veilframe.functions.arrays import let, var
from veilframe.operators import mapping as M
from veilframe.operators.detect import (chunk_span_rows, pick_rules, span_rows, with_hits,
                                        with_spans)
from veilframe.operators.redact import CHUNK, text_hash
from veilframe.operators.substrings import anchor_bits, has_bit, replaced, with_occurrences
from veilframe.session import (join_checked, join_hot_split, join_null_safe, materialise, packed,
                               small_enough, union_parts)

_PART = "struct(chunk_ord AS ord, start, end, fake_value AS value)"
_KIND = "struct(chunk_ord, start, entity_type)"
_COUNTS = "map<string,bigint>"


def grouped_parts(spans: DataFrame, keys: list[str]) -> DataFrame:
    """``_parts`` and ``entity_counts`` per key; sets, because repeated rows repeat spans."""
    k, e, f = var("k"), var("e"), var("f")
    kinds = f"transform(_kinds, {k} -> {k}.entity_type)"
    counts = (f"map_from_entries(transform(array_sort(array_distinct({kinds})), {e} -> struct({e}, "
              f"cast(size(filter({kinds}, {f} -> {f} = {e})) AS bigint))))")
    return (spans.groupBy(*keys)
            .agg(F.array_sort(F.collect_set(F.expr(_PART))).alias("_parts"),
                 F.collect_set(F.expr(_KIND)).alias("_kinds"))
            .withColumn("entity_counts", F.expr(counts)).drop("_kinds"))


def _no_counts(df: DataFrame) -> DataFrame:
    return df.withColumn("entity_counts", F.expr(f"cast(map() AS {_COUNTS})"))


def _or_empty(df: DataFrame) -> DataFrame:
    return df.withColumn("_parts", F.expr(f"coalesce(_parts, cast(array() AS {L.PARTS_TYPE}))")).withColumn(
        "entity_counts", F.expr(f"coalesce(entity_counts, cast(map() AS {_COUNTS}))"))


def mapped_spans(spans: DataFrame, mapping: DataFrame) -> DataFrame:
    """Span rows with the fake of their original.

    A value with very many occurrences, known from the mapping, is joined by broadcast;
    all others by a shuffle. A value that the mapping does not know, for example because a
    model answered differently this time, becomes ``[TYPE_FAKE]`` and never stays in clear.
    """
    table = mapping.select("original_hash", "fake_value", "occurrences")
    hashed = spans.withColumn("original_hash", F.expr(C.hex_hash("original")))
    unknown = F.concat(F.lit("["), F.coalesce("entity_type", F.lit("UNKNOWN")), F.lit("_FAKE]"))
    return join_hot_split(hashed, table, "original_hash", "occurrences").withColumn(
        "fake_value", F.coalesce("fake_value", unknown))


def pseudonymise_documents(texts: DataFrame, doc: str, text: str, mapping: DataFrame, *,
                           rules: Iterable[R.Rule] | None = None,
                           threshold: float = R.DEFAULT_THRESHOLD,
                           spans: DataFrame | None = None) -> DataFrame:
    """Add ``entity_counts`` and ``scrubbed_text`` to a table with one document per row.

    Only spans are shuffled to the mapping; a group is one document's spans. Texts without
    the signs of any rule are not shuffled at all. ``spans`` are resolved span rows of any
    detector, keyed by ``(doc, CHUNK)`` and used instead of the rules. Every row comes out:
    a null text stays null, and rows with a null or repeated ``doc`` are told apart by
    their text.
    """
    likely = "true"
    if spans is None:
        chosen = pick_rules(None, rules)
        likely = S.may_match(text, chosen)
        spans = span_rows(with_hits(texts.filter(likely).select("*", text_hash(text)), text,
                                    rules=chosen, threshold=threshold), doc, CHUNK)
    parts = grouped_parts(mapped_spans(spans, mapping), [doc, CHUNK])
    some = texts.filter(likely).select("*", text_hash(text))
    changed = (_or_empty(join_null_safe(some, parts, [doc, CHUNK]).drop(CHUNK))
               .withColumn("scrubbed_text", F.expr(L.rebuilt(text, "_parts"))).drop("_parts"))
    rest = (_no_counts(texts.filter(f"NOT coalesce({likely}, false)"))
            .withColumn("scrubbed_text", F.expr(X.normalised(text))))
    return union_parts(changed, rest)


def pseudonymise_chunks(chunks: DataFrame, doc: str, order: str, text: str,
                        mapping: DataFrame, *, rules: Iterable[R.Rule] | None = None,
                        threshold: float = R.DEFAULT_THRESHOLD,
                        spans: DataFrame | None = None) -> DataFrame:
    """``pseudonymise_documents`` for a table in which each row is one chunk."""
    likely = "true"
    if spans is None:
        chosen = pick_rules(None, rules)
        likely = S.may_match(text, chosen)
        spans = chunk_span_rows(
            with_spans(chunks.filter(likely).select("*", text_hash(text)), text, rules=chosen,
                       threshold=threshold), doc, order, CHUNK, text=text)
    keys = [doc, order, CHUNK]
    parts = grouped_parts(mapped_spans(spans.withColumn("chunk_ord", F.lit(0)), mapping), keys)
    some = chunks.filter(likely).select("*", text_hash(text))
    changed = (_or_empty(join_null_safe(some, parts, keys).drop(CHUNK))
               .withColumn("scrubbed_text", F.expr(S.splice(text, "_parts"))).drop("_parts"))
    rest = _no_counts(chunks.filter(f"NOT coalesce({likely}, false)")).withColumn("scrubbed_text", F.col(text))
    return union_parts(changed, rest)


# One detection pass ------------------------------------------------------------------

@dataclass(frozen=True)
class Detected:
    """A table after its only detection pass.

    ``stored`` are the rows with spans, written once: their text sealed, offsets, hashes and usual
    fakes of their spans, and the originals sealed. ``rest`` are all others, which are read again.
    """

    stored: DataFrame
    rest: DataFrame
    text: str
    columns: list[str]
    key: bytes
    whole: bool

    def span_rows(self, *keys: str) -> DataFrame:
        """One row per span with its original; without keys of a chunk's own, chunks are lines."""
        s, o = var("s"), var("o")
        originals = f"from_json({M.decrypt('_originals', self.key)}, 'array<string>')"
        rows = (f"zip_with(_spans, {originals}, ({s}, {o}) -> named_struct('chunk_ord', {s}.ord, 'entity_type', "
                f"{s}.entity, 'start', {s}.start, 'end', {s}.end, 'score', {s}.score, 'rule', {s}.rule, "
                f"'original', {o}))")
        return self.stored.select(*keys, F.expr(f"inline({rows})"))

    def exceptions(self, mapping: DataFrame) -> DataFrame:
        """``_row, _own``: spans whose fake in ``mapping(original_hash, fake_value)`` is not the usual one.

        A value is an exception if its fake was made anew or comes from an earlier run, if its
        entity differs from place to place, or if the mapping does not hold it.
        """
        s = var("s")
        spans = self.stored.select("_row", F.expr("inline(_spans)"))
        usual = spans.groupBy(F.col("hash").alias("original_hash")).agg(
            F.min("fake").alias("low"), F.max("fake").alias("high"), F.count(F.lit(1)).alias("n"))
        odd = materialise(usual.join(mapping.select("original_hash", "fake_value"), "original_hash", "left")
                          .filter("fake_value IS NULL OR low <> high OR low <> fake_value")
                          .select("original_hash", "fake_value", "n", F.lit(True).alias("odd")))
        if odd.isEmpty():
            return odd.select(F.lit(0).cast("bigint").alias("_row"), F.expr(f"cast(array() AS {_OWN})").alias("_own")).limit(0)
        met = join_hot_split(spans.withColumnRenamed("hash", "original_hash"), odd, "original_hash", "n").filter("odd")
        return materialise(met.groupBy("_row").agg(F.collect_list(F.struct(
            "ord", "start", F.coalesce("fake_value", F.concat(F.lit("["), "entity", F.lit("_FAKE]"))).alias("fake")))
            .alias("_own")))

    def pseudonymised(self, mapping: DataFrame) -> DataFrame:
        """All rows with ``entity_counts`` and ``scrubbed_text``. Fakes are worked out in place; only
        exceptions are joined, and no text is shuffled while these are few."""
        own = self.exceptions(mapping)
        rows = self.stored
        if not own.isEmpty():
            rows = join_checked(rows, own, ["_row"])
        else:
            rows = rows.withColumn("_own", F.expr(f"cast(NULL AS {_OWN})"))
        s, x = var("s"), var("x")
        fake = (f"IF(_own IS NULL, {s}.fake, coalesce(get(filter(_own, {x} -> {x}.ord = {s}.ord AND "
                f"{x}.start = {s}.start), 0).fake, {s}.fake))")
        parts = (f"array_sort(transform(_spans, {s} -> named_struct('ord', {s}.ord, 'start', {s}.start, 'end', "
                 f"{s}.end, 'value', {fake})))")
        counts = F.map_from_entries(F.expr(L.entity_counts("array(named_struct('spans', _spans))")))
        new = L.rebuilt if self.whole else S.splice
        opened = rows.withColumns({self.text: F.expr(M.decrypt("_sealed", self.key)), "_parts": F.expr(parts)})
        changed = opened.select(*self.columns, counts.alias("entity_counts"),
                                F.expr(new(f"`{self.text}`", "_parts")).alias("scrubbed_text"))
        plain = X.normalised(f"`{self.text}`") if self.whole else f"`{self.text}`"
        rest = _no_counts(self.rest).withColumn("scrubbed_text", F.expr(plain))
        return union_parts(changed, rest.select(*changed.columns))

    def redacted(self) -> DataFrame:
        """All rows of a table of documents with ``scrubbed_text``, their spans as numbered labels."""
        s = var("s")
        hits = f"transform(_spans, {s} -> named_struct('ord', {s}.ord, 'spans', array({s})))"
        opened = self.stored.withColumns({self.text: F.expr(M.decrypt("_sealed", self.key)),
                                          "_parts": F.expr(L.labelled(L.numbered(hits)))})
        changed = opened.select(*self.columns, F.expr(L.rebuilt(f"`{self.text}`", "_parts")).alias("scrubbed_text"))
        rest = self.rest.withColumn("scrubbed_text", F.expr(X.normalised(f"`{self.text}`")))
        return union_parts(changed, rest.select(*changed.columns))


_OWN = "array<struct<ord:int,start:int,fake:string>>"


def detect_once(df: DataFrame, text: str, key: bytes, salt: str | None, *, chunk: bool = False,
                rules: Iterable[R.Rule] | None = None,
                threshold: float = R.DEFAULT_THRESHOLD) -> Detected:
    """Detect in a table of documents, or with ``chunk`` of single chunks, for ``salt``'s fakes, if it is given.

    Rows need no key: each is worked on by itself, so null and repeated keys are no matter.
    Texts without spans are not written: a table of bits tells most of them from those that
    are, and the few others, told by two hashes of their content, are written as well.
    """
    M.hide_keys(df.sparkSession)
    chosen = pick_rules(None, rules)
    likely = S.may_match(text, chosen)
    if chunk:
        spans = f"IF({X.not_blank(text)}, {S.find_spans(text, chosen, threshold)}, {S.NO_SPANS})"
        hits = f"array(named_struct('ord', 0, 'text', {text}, 'spans', {spans}))"
    else:
        hits = L.hits_of_text(text, chosen, threshold)
    h, s, f, g = var("h"), var("s"), var("f"), var("g")
    flat = (f"flatten(transform({hits}, {h} -> transform({h}.spans, {s} -> named_struct('ord', {h}.ord, 'start', "
            f"{s}.start, 'end', {s}.end, 'entity', {s}.entity, 'score', {s}.score, 'rule', {s}.rule, "
            f"'original', {S.span_text(f'{h}.text', s)}))))")

    def with_fake(value_hash: str) -> str:
        plus = f"{f}.original LIKE '+%'"
        fake = ("cast(NULL AS string)" if salt is None
                else M.usual_fake(f"{f}.entity", value_hash, plus, salt))
        return (f"named_struct('ord', {f}.ord, 'start', {f}.start, 'end', {f}.end, 'entity', {f}.entity, 'score', "
                f"{f}.score, 'rule', {f}.rule, 'hash', {value_hash}, 'fake', {fake})")

    spanned = (f"transform(_flat, {f} -> {with_fake('cast(NULL AS string)')})" if salt is None else
               f"transform(_flat, {f} -> {let(C.hex_hash(f'{f}.original'), with_fake)})")
    keys = {"_text1": F.xxhash64(F.col(f"`{text}`")), "_text2": F.xxhash64(F.col(f"`{text}`"), F.lit(1))}
    found = df.filter(likely).select("*", F.expr(
        f"inline(filter(array(named_struct('_flat', {flat})), {s} -> size({s}._flat) > 0))"))
    others = [c for c in df.columns if c != text]
    sealed = F.expr(M.encrypt(f"`{text}`", key)).alias("_sealed")
    stored = packed(found.withColumns(keys).select(
        *[F.col(f"`{c}`") for c in others], *keys, F.monotonically_increasing_id().alias("_row"), sealed,
        F.expr(spanned).alias("_spans"),
        F.expr(M.encrypt(f"to_json(transform(_flat, {g} -> {g}.original))", key)).alias("_originals")))

    rest = df.filter(f"NOT coalesce({likely}, false)")
    bits = anchor_bits(stored.select(F.lit(0).alias("class"), F.col("_text1").alias("gram")))
    signed = df.filter(likely).withColumns(keys).withColumn("_maybe", has_bit(bits, F.col("_text1")))
    rest = union_parts(rest, signed.filter("NOT _maybe").select(*[F.col(f"`{c}`") for c in df.columns]))
    doubtful = materialise(signed.filter("_maybe").select(*keys).distinct()
                           .join(stored.select(*keys), list(keys), "left_anti"))
    if not doubtful.isEmpty():
        few = F.broadcast(doubtful) if small_enough(doubtful) else doubtful.hint("merge")
        spared = packed(signed.filter("_maybe").join(few, list(keys), "left_semi").select(
            *[F.col(f"`{c}`") for c in others], sealed)).withColumn(text, F.expr(M.decrypt("_sealed", key)))
        rest = union_parts(rest, spared.select(*[F.col(f"`{c}`") for c in df.columns]))
    return Detected(stored, rest, text, df.columns, key, not chunk)


# Restore -----------------------------------------------------------------------------

def restore_documents(texts: DataFrame, doc: str, text: str, pairs: DataFrame) -> DataFrame:
    """Replace every fake in ``text`` by its real value, in one pass, longest fake first.

    ``pairs`` has ``fake_value`` and ``real_value``, each fake once, and may have ``occurrences``. A fake is found wherever its
    characters stand, also glued to others. Each row is restored by itself: rows with a null
    or repeated ``doc`` never mix, a null text stays null. The size of the mapping is not
    limited; see ``substrings``. Adds ``restored_text``.
    """
    return with_occurrences(texts, text, pairs, "fake_value", "real_value", replaced, "string", "restored_text",
                            F.col(text))


def restore_chunks(chunks: DataFrame, keys: list[str], text: str, pairs: DataFrame) -> DataFrame:
    """``restore_documents`` for a table in which each row is one chunk."""
    return restore_documents(chunks, keys[0], text, pairs)
