"""A hashed prefix tree of phrases, walked level by level from every atom of a text.

A node is the hash of a phrase's first d atoms and of the blanks between them. All nodes of all
levels lie in one table of bits, which is broadcast: its size is bounded whatever the number of
phrases. An n-gram is extended by an atom only while its prefix is in the tree, so only n-grams
that are phrases (or, by chance of the hash, look like one) are ever built. The caller compares
them with the phrases themselves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.functions import spans as S
from veilframe.functions.arrays import let, lit, var
from veilframe.session import BIT_WORDS, BITS_PER_KEY, materialise

ATOM = r"(?U)\w+|[^\w\s]"
#: An atom with the white space after it.
PIECE = r"(?U)(?:\w+|[^\w\s])\s*"
#: Levels of the tree. Of longer phrases the first atoms are in it, and their last node says that
#: n-grams of all longer widths are to be built.
LEVELS = 6


def _bare(piece: str) -> str:
    return f"regexp_replace({piece}, r'(?U)\\s+$', '')"


def _step(above: str, before: str, piece: str, ignore_case: bool) -> str:
    """Hash of a node from that of the node above, the piece before and its own piece.

    Both small sigmas are one letter here, since ``lower`` chooses by what follows in the text.
    """
    atom = _bare(piece)
    if ignore_case:
        atom = f"translate(lower({atom}), 'ς', 'σ')"
    return f"xxhash64({above}, {before} RLIKE r'(?U)\\s$', {atom})"


def nodes(entries: DataFrame, phrase: str, ignore_case: bool) -> DataFrame:
    """``h, inner, last``: every node of every phrase, whether it goes on and whether it ends."""
    acc, x, i, h = var("acc"), var("x"), var("i"), var("h")

    def rows(p: str) -> str:
        chain = (f"aggregate(slice({p}, 1, {LEVELS}), named_struct('h', 0L, 'before', '', 'all', "
                 f"cast(array() AS array<bigint>)), ({acc}, {x}) -> "
                 + let(_step(f"{acc}.h", f"{acc}.before", x, ignore_case), lambda v: (
                     f"named_struct('h', {v}, 'before', {x}, 'all', array_append({acc}.all, {v}))"))
                 + f", {acc} -> {acc}.all)")
        return (f"transform({chain}, ({h}, {i}) -> named_struct('h', {h}, "
                f"'inner', {i} + 1 < size({p}), 'last', {i} + 1 = size({p})))")

    pieces = f"regexp_extract_all({phrase}, {lit(PIECE)}, 0)"
    return entries.select(F.expr(f"inline({let(pieces, rows)})"))


def bit_table(rows: DataFrame, bound: int) -> tuple[DataFrame, int]:
    """``word, inner_bits, last_bits`` of at most BIT_WORDS words, and the number of words.

    ``bound`` is at least the number of nodes. Far more than 4 million nodes fill the table up;
    it then spares less, and loses nothing.
    """
    words = min(max(bound * BITS_PER_KEY // 64, 1), BIT_WORDS)
    place = F.pmod("h", F.lit(words * 64))
    set_bits = "bit_or(IF({0}, shiftleft(1L, cast(place % 64 AS int)), 0L))"
    table = (rows.select(place.alias("place"), "inner", "last")
             .groupBy(F.expr("place div 64").alias("word"))
             .agg(F.expr(set_bits.format("inner")).alias("inner_bits"),
                  F.expr(set_bits.format("last")).alias("last_bits")))
    return materialise(table), words


def likely_entries(chunks: DataFrame, keys: list[str], text: str, entries: DataFrame, phrase: str,
                   widths: list[int], bound: int, ignore_case: bool) -> DataFrame:
    """``(*keys, start, end, surface)`` of every n-gram of ``text`` that the tree takes for a phrase.

    ``widths``: distinct atom counts of the phrases; ``bound`` as in ``bit_table``. Nothing is
    shuffled. A row holds as many atoms as the longest phrase has.
    """
    if not widths:
        return chunks.select(*keys, F.lit(0).alias("start"), F.lit(0).alias("end"),
                             F.lit("").alias("surface")).limit(0)
    table, words = bit_table(nodes(entries, phrase, ignore_case), bound)
    x, y, i, n = var("x"), var("y"), var("i"), var("n")
    depth = min(LEVELS, widths[-1])

    def starts(p: str) -> str:
        return (f"transform({p}, ({x}, {i}) -> named_struct('start', {x}.start, '_ahead', "
                f"transform(slice({p}, {i} + 1, {widths[-1]}), {y} -> {y}.m)))")

    rows = chunks.select(*keys, F.expr(f"inline({let(S.matches(text, PIECE), starts)})")).selectExpr(
        "*", "0L AS _h", "true AS _on", "cast(array() AS array<int>) AS _widths")
    kept = [*keys, "start", "_ahead"]
    for level in range(1, depth + 1):
        before = f"get(_ahead, {level - 2})" if level > 1 else "''"
        step = _step("_h", before, f"get(_ahead, {level - 1})", ignore_case)
        reached = "true" if level == 1 else f"_on AND size(_ahead) >= {level}"
        rows = rows.selectExpr(*kept, "_widths", f"IF({reached}, {step}, NULL) AS _h").selectExpr(
            "*", f"pmod(_h, {words * 64}L) div 64 AS _word",
            f"cast(pmod(_h, {words * 64}L) % 64 AS int) AS _bit")
        met = rows.join(F.broadcast(table), F.col("_word") == F.col("word"),
                        "inner" if level == 1 else "left")

        def is_set(bits: str) -> str:
            return f"coalesce(shiftright({bits}, _bit) & 1L, 0L) = 1"

        rows = met.selectExpr(
            *kept, "_h", f"{is_set('inner_bits')} AS _on",
            f"IF({is_set('last_bits')}, array_append(_widths, {level}), _widths) AS _widths",
        ).filter("_on OR size(_widths) > 0")
    longer = [w for w in widths if w > LEVELS]
    every = "_widths"
    if longer:
        every = (f"IF(_on, concat(_widths, filter(array({', '.join(map(str, longer))}), "
                 f"{n} -> {n} <= size(_ahead))), _widths)")
    surface = f"concat(array_join(slice(_ahead, 1, _n - 1), ''), {_bare('get(_ahead, _n - 1)')})"
    return (rows.selectExpr(*keys, "start", "_ahead", f"explode({every}) AS _n")
            .selectExpr(*keys, "start", f"{surface} AS surface")
            .selectExpr(*keys, "start", "cast(start + length(surface) AS int) AS end", "surface"))
