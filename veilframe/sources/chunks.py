"""Chunk sources: lines of texts, cells of tables, several tables as sheets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilframe.functions import text as X
from veilframe.functions.arrays import let, lit, var
from veilframe.session import join_null_safe

BLOCK = 4096


def line_chunks(df: DataFrame, doc: str, text: str = "text") -> DataFrame:
    """One row per non-blank line with its character offsets.

    ``char_offset_end - char_offset_start`` is the length of ``text``; line breaks count in
    the offsets of later lines. ``chunk_ord`` counts all lines, blank ones too.
    """
    line, i = var("l"), var("i")

    def rows(lines: str) -> str:
        return let(X.line_starts(lines), lambda starts: (
            f"transform({lines}, ({line}, {i}) -> named_struct('chunk_ord', {i}, "
            f"'char_offset_start', get({starts}, {i}), 'text', {X.chop(line)}))"))

    found = df.select(doc, F.expr(f"inline({let(X.keepends(X.normalised(text)), rows)})"))
    return (found.filter(X.not_blank("text"))
            .select(doc, "chunk_ord", "char_offset_start",
                    (F.col("char_offset_start") + F.length("text")).alias("char_offset_end"),
                    "text"))


def cell_chunks(df: DataFrame, row: str, columns: list[str] | None = None) -> DataFrame:
    """One row per non-empty cell, as stripped text; ``col`` counts from 0."""
    columns = columns or df.columns
    x, y = var("x"), var("y")
    cells = ", ".join(f"named_struct('col', {i}, 'col_name', {lit(c)}, "
                      f"'text', cast(`{c}` AS string))" for i, c in enumerate(columns))
    clean = (f"filter(transform(array({cells}), {x} -> named_struct('col', {x}.col, "
             f"'col_name', {x}.col_name, 'text', {X.stripped(f'{x}.text')})), "
             f"{y} -> {y}.text IS NOT NULL AND {y}.text != '')")
    return df.select(F.col(row).alias("row_id"), F.expr(f"inline({clean})"))


def sheet_chunks(sheets: list[tuple[str, DataFrame, str]]) -> DataFrame:
    """Cells of several tables ``(name, frame, row key)``, numbered in the given order."""
    parts = [cell_chunks(df, key).select(
        F.lit(n).alias("sheet_ord"), F.lit(name).alias("sheet"), "*")
        for n, (name, df, key) in enumerate(sheets, start=1)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def rebuild_table(cells: DataFrame, columns: list[str], value: str,
                  rows: DataFrame | None = None) -> DataFrame:
    """Cells back to one row per ``row_id``; cells of other columns are ignored.

    Blank cells are no chunks, so a row of blanks is only known from ``rows(row_id)``; its
    cells, like every blank one, come back as null.
    """
    table = cells.groupBy("row_id").pivot("col_name", columns).agg(F.first(value))
    if rows is None:
        return table
    return join_null_safe(rows.select("row_id").distinct(), table, ["row_id"])


def transitions(chunks: DataFrame, doc: str, order: str, column: str,
                block: int = BLOCK) -> DataFrame:
    """Add ``changed``: ``column`` differs from the previous chunk of the document.

    The previous chunk is found inside blocks of positions, so that a document with very
    many chunks is shared by many tasks. Only the last value of a block goes to the first
    chunk of the next. Every row comes out: null documents are one document, and a chunk
    without a value, or after one, is not a change.
    """
    rows = chunks.withColumn("_block", F.floor(F.col(order) / block))
    inside = Window.partitionBy(doc, "_block").orderBy(order)
    blocks = Window.partitionBy(doc).orderBy("_block")
    last = F.max(F.struct(order, F.col(column).alias("_value")))
    lasts = (rows.groupBy(doc, "_block").agg(last["_value"].alias("_last"))
             .select(doc, "_block", F.lag("_last").over(blocks).alias("_carried")))
    before = F.when(F.row_number().over(inside) == 1, F.col("_carried")).otherwise(F.lag(column).over(inside))
    return (join_null_safe(rows, lasts, [doc, "_block"])
            .withColumn("changed", F.coalesce(F.col(column) != before, F.lit(False)))
            .drop("_block", "_carried"))


def strip_metadata(df: DataFrame, columns: list[str]) -> DataFrame:
    """Blank identifying columns; a missing column is not an error."""
    return df.withColumns({c: F.lit("") for c in columns if c in df.columns})
