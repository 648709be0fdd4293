"""Find the entries of a table of phrases in texts: an n-gram join.

A text is cut into atoms: runs of word characters and single other visible characters. An
n-gram is up to N neighbouring atoms with the text between them, so an entry matches only
where it starts and ends at an atom border. Which n-grams are built is decided by the first atoms
of the entries while these are few, else by a prefix tree.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.functions import spans as S
from veilframe.functions.arrays import let, lit, var
from veilframe.operators.prefixtree import ATOM, LEVELS, likely_entries
from veilframe.session import BROADCAST_ROW_LIMIT, join_checked

SCORE = 0.85
FIRST_ATOM_LIMIT = 2_000
GATE_LIMIT = 200


def atom_count(text: str) -> str:
    return f"size(regexp_extract_all({text}, {lit(ATOM)}, 0))"


def folded(text: str, ignore_case: bool) -> str:
    """Comparison form: single spaces, lower case when case does not matter."""
    spaced = f"regexp_replace({text}, r'(?U)\\s+', ' ')"
    return f"lower({spaced})" if ignore_case else spaced


def ngrams(text: str, widths: list[int], firsts: list[str], ignore_case: bool) -> str:
    """``array<struct<start, end, surface, phrase>>`` for the n-grams of the given atom counts
    that begin with an atom of ``firsts``.

    White space is folded only in texts that have more than single spaces.
    """
    a, i, w, g, f = (var(c) for c in "aiwgf")

    def fold(value: str, irregular: str) -> str:
        plain = f"lower({value})" if ignore_case else value
        return f"IF({irregular}, {folded(value, ignore_case)}, {plain})"

    def grams(atoms: str, irregular: str, index: str) -> str:
        last = f"get({atoms}, {index} + {w} - 1)"
        end = f"({last}.start + length({last}.m))"
        raw = (f"filter(transform(array({', '.join(map(str, widths))}), {w} -> named_struct("
               f"'start', {a}.start, 'end', {end}, 'surface', "
               f"substring({text}, {a}.start + 1, {end} - {a}.start))), "
               f"{g} -> {g}.end IS NOT NULL)")
        return (f"transform({raw}, {g} -> named_struct('start', {g}.start, 'end', {g}.end, "
                f"'surface', {g}.surface, 'phrase', {fold(f'{g}.surface', irregular)}))")

    def build(atoms: str, irregular: str) -> str:
        atom = f"lower({f}.m)" if ignore_case else f"{f}.m"
        listed = ", ".join(lit(x) for x in firsts) or "''"
        starts = (f"filter(transform({atoms}, ({f}, {i}) -> named_struct('i', "
                  f"IF({atom} IN ({listed}), {i}, NULL), 'start', {f}.start)), "
                  f"{f} -> {f}.i IS NOT NULL)")
        return f"flatten(transform({starts}, {a} -> {grams(atoms, irregular, f'{a}.i')}))"

    return let(S.matches(text, ATOM), lambda atoms: let(
        f"{text} RLIKE r'(?U)\\s\\s|[^\\S ]'", lambda irregular: build(atoms, irregular)))


@dataclass(frozen=True)
class EntryStats:
    """``widths``: distinct atom counts, at most a handful; ``rows``: number of entries;
    ``digits``: whether every entry has a digit; ``nodes``: bound on their prefixes in a tree."""

    widths: list[int]
    rows: int
    digits: bool
    nodes: int


def entry_stats(entries: DataFrame, phrase: str) -> EntryStats:
    rows = (entries.groupBy(F.expr(atom_count(phrase)).alias("n"))
            .agg(F.count(F.lit(1)).alias("rows"),
                 F.every(F.expr(f"{phrase} RLIKE r'\\p{{Nd}}'")).alias("digits")).collect())
    return EntryStats(sorted(r["n"] for r in rows if r["n"]), sum(r["rows"] for r in rows),
                      all(r["digits"] for r in rows),
                      sum(min(r["n"] or 0, LEVELS) * r["rows"] for r in rows))


def entry_gate(text: str, stats: EntryStats, firsts: list[str] | None, ignore_case: bool) -> str:
    """Cheap test that holds for every text with an entry."""
    if stats.digits:
        return f"{text} RLIKE r'\\p{{Nd}}'"
    if ignore_case or firsts is None or not 0 < len(firsts) <= GATE_LIMIT:
        return "true"
    words = "|".join(re.escape(f) for f in firsts)
    letters = "".join(sorted({re.escape(f[0]) for f in firsts}))
    return f"{text} RLIKE {lit(f'(?=[{letters}])(?:{words})')}"


def first_atoms(entries: DataFrame, phrase: str, ignore_case: bool,
                limit: int = FIRST_ATOM_LIMIT) -> list[str] | None:
    """Distinct first atoms of the entries, or None when there are more than ``limit``."""
    first = f"regexp_extract({phrase}, {lit(ATOM)}, 0)"
    rows = (entries.select(F.expr(f"lower({first})" if ignore_case else first).alias("a"))
            .distinct().limit(limit + 1).collect())
    return None if len(rows) > limit else sorted(r["a"] for r in rows if r["a"])


def find_entries(chunks: DataFrame, keys: list[str], text: str, entries: DataFrame,
                 phrase: str, *, ignore_case: bool = True,
                 broadcast_rows: int = BROADCAST_ROW_LIMIT) -> DataFrame:
    """Rows ``(*keys, start, end, surface, …entry columns)`` for every occurrence.

    Only keys and phrases travel to the join, not the texts. The entries are broadcast if
    counted small; if not, both sides are shuffled with salted phrases, because frequent
    words are hot keys. Few distinct first atoms prune the n-grams before the join; where they
    are many, only n-grams whose prefixes are all in a tree of the entries are built.
    ``entries`` is read a few times; materialise it if it is costly.
    """
    stats = entry_stats(entries, phrase)
    firsts = first_atoms(entries, phrase, ignore_case)
    likely = chunks.filter(entry_gate(text, stats, firsts, ignore_case))
    if firsts is None:
        grams = likely_entries(likely, keys, text, entries, phrase, stats.widths, stats.nodes,
                               ignore_case).withColumn("phrase", F.expr(folded("surface", ignore_case)))
    else:
        grams = likely.select(*keys, F.expr(
            f"inline({ngrams(text, stats.widths or [1], firsts, ignore_case)})"))
    table = (entries.withColumn("phrase", F.expr(folded(phrase, ignore_case)))
             .dropDuplicates(["phrase"]))
    return join_checked(grams, table, ["phrase"], "inner",
                        small=stats.rows <= broadcast_rows).drop("phrase")


@dataclass(frozen=True)
class Gazetteer:
    """Names of one entity: the column ``phrase`` of the table ``entries``."""

    entity: str
    entries: DataFrame
    phrase: str
    score: float = SCORE
    ignore_case: bool = True


def gazetteer_spans(chunks: DataFrame, keys: list[str], text: str, names: Gazetteer) -> DataFrame:
    """Span rows of one entity from a table of its names."""
    hits = find_entries(chunks, keys, text, names.entries.select(names.phrase), names.phrase,
                        ignore_case=names.ignore_case)
    return hits.select(*keys, F.lit(names.entity).alias("entity_type"), "start", "end",
                       F.lit(names.score).alias("score"), F.lit("gazetteer").alias("rule"),
                       F.col("surface").alias("original"))
