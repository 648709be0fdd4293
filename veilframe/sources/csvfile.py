"""CSV files: bytes to cells and back, with the standard library in Arrow tasks.

The counterpart of ``sources.email``: a file becomes arrays of cell chunks, which are
scrubbed like those of any document, and is then written with the new cells. A file is read as a
stream and goes on in pieces of some thousand cells, so what a task holds besides the file's bytes does not
grow with the file. The header is no chunk. Cells are scrubbed without outer white space; blank cells and
blank rows stay as they are.
"""

from __future__ import annotations

import csv
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.sources.email import spliced

#: Cells, and characters, after which a piece of a file ends.
PIECE_CELLS, PIECE_CHARS = 4096, 1 << 18
CHUNKS = "array<struct<ord:int,part:string,content_type:string,text:string>>"
PARTS = "array<struct<ord:int,start:int,end:int,value:string>>"
COUNTS = "array<struct<entity:string,n:bigint>>"


def rows_of(content: bytes) -> Iterator[list[str]]:
    lines = io.TextIOWrapper(io.BytesIO(content), "utf-8-sig", "replace", newline="")
    return csv.reader(line.replace("\x00", "�") for line in lines)


def _rows(content: bytes) -> list[list[str]]:
    return list(rows_of(content))


def _pieces(content: bytes) -> Iterator[tuple[int, int, list[list[str]]]]:
    """``row, chunks before, rows`` of each piece; a file without rows is one piece."""
    first = before = cells = chars = 0
    rows: list[list[str]] = []
    for row in rows_of(content):
        rows.append(row)
        cells += len(row)
        chars += sum(map(len, row))
        if cells >= PIECE_CELLS or chars >= PIECE_CHARS:
            yield first, before, rows
            before += len(_cells(first, rows))
            first, rows, cells, chars = first + len(rows), [], 0, 0
    if rows or not first:
        yield first, before, rows


def _cells(first: int, rows: list[list[str]]) -> list[tuple[int, int, str]]:
    """``row, column, text`` of the cells that are not blank; row 0 of the file is its header."""
    return [(r, c, cell.strip()) for r, row in enumerate(rows) if first + r
            for c, cell in enumerate(row) if cell.strip()]


def _error(content: bytes) -> str | None:
    """The error class of a file that the library refuses, found before any piece goes on."""
    try:
        for _ in rows_of(content):
            pass
    except csv.Error as exc:
        return type(exc).__name__
    return None


def chunk_pieces(files: DataFrame) -> DataFrame:
    """``path, piece, error, chunks``: the cells of files ``(path, content)``; part ``r.c`` names a cell."""
    def one(content: bytes):
        if error := _error(content):
            yield error, []
            return
        for first, before, rows in _pieces(content):
            yield None, [{"ord": before + i, "part": f"{first + r}.{c}", "content_type": None, "text": text}
                         for i, (r, c, text) in enumerate(_cells(first, rows))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("ord", pa.int32()), ("part", pa.string()), ("content_type", pa.string()),
                                   ("text", pa.string())]))
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                for piece, (error, chunks) in enumerate(one(content.as_py())):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([path]), pa.array([piece], pa.int32()), pa.array([error], pa.string()), pa.array([chunks], kind)],
                        names=["path", "piece", "error", "chunks"])

    return files.select("path", "content").mapInArrow(run, f"path string, piece int, error string, chunks {CHUNKS}")


def row_pieces(files: DataFrame) -> DataFrame:
    """``path, piece, error, source_hash, first, before, rows``: the same pieces with all their cells as they are."""
    def one(content: bytes):
        if error := _error(content):
            yield error, 0, 0, []
            return
        for piece in _pieces(content):
            yield None, *piece

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                content = content.as_py()
                source = hashlib.sha256(content).hexdigest()
                for piece, (error, first, before, rows) in enumerate(one(content)):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([path]), pa.array([piece], pa.int32()), pa.array([error], pa.string()), pa.array([source]),
                         pa.array([first], pa.int32()), pa.array([before], pa.int32()),
                         pa.array([rows], pa.list_(pa.list_(pa.string())))],
                        names=["path", "piece", "error", "source_hash", "first", "before", "rows"])

    return files.select("path", "content").mapInArrow(
        run, "path string, piece int, error string, source_hash string, first int, before int, rows array<array<string>>")


def write(first: int, before: int, rows: list[list[str]], parts) -> bytes:
    """The rows of a piece with the ``parts(ord, start, end, value)`` of its cells put in."""
    cells = _cells(first, rows)
    chunks = [{"ord": before + i, "text": text} for i, (_, _, text) in enumerate(cells)]
    for (r, c, _), chunk in zip(cells, spliced(chunks, parts), strict=True):
        rows[r][c] = chunk["text"]
    out = io.StringIO(newline="")
    csv.writer(out, lineterminator="\n").writerows(rows)
    return out.getvalue().encode("utf-8")


def write_pieces(pieces: DataFrame) -> DataFrame:
    """``path, source_hash, error, new, counts`` of files whose ``row_pieces`` have ``parts`` and ``counts``.

    Each piece is written by itself; the pieces of a file are then joined in order. A file that
    cannot be written gets its error class and no output.
    """
    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new, errors = [], batch.column("error").to_pylist()
            for k, fields in enumerate(zip(*(batch.column(c) for c in ("first", "before", "rows", "parts")), strict=True)):
                new.append(None)
                if errors[k] is None:
                    first, before, rows, parts = (f.as_py() for f in fields)
                    try:
                        new[-1] = write(first, before, rows, parts or [])
                    except Exception as exc:  # noqa: BLE001 - one bad file must not stop the batch
                        errors[k] = type(exc).__name__
            yield pa.RecordBatch.from_arrays(
                [batch.column("path"), batch.column("piece"), batch.column("source_hash"), pa.array(errors, pa.string()),
                 pa.array(new, pa.binary()), batch.column("counts")],
                names=["path", "piece", "source_hash", "error", "new", "counts"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []

        def whole() -> pa.RecordBatch:
            counts: dict[str, int] = {}
            for row in held:
                for c in row[4] or []:
                    counts[c["entity"]] = counts.get(c["entity"], 0) + c["n"]
            error = next((r[2] for r in held if r[2] is not None), None)
            new = None if error else b"".join(r[3] for r in held)
            entries = [{"entity": e, "n": n} for e, n in sorted(counts.items())]
            return pa.RecordBatch.from_arrays(
                [pa.array([held[0][0]]), pa.array([held[0][1]]), pa.array([error], pa.string()), pa.array([new], pa.binary()),
                 pa.array([entries], pa.list_(pa.struct([("entity", pa.string()), ("n", pa.int64())])))],
                names=["path", "source_hash", "error", "new", "counts"])

        for batch in batches:
            for row in zip(*(batch.column(c) for c in ("path", "source_hash", "error", "new", "counts")), strict=True):
                row = [v.as_py() for v in row]
                if held and held[0][0] != row[0]:
                    yield whole()
                    held.clear()
                held.append(row)
        if held:
            yield whole()

    kind = f"source_hash string, error string, new binary, counts {COUNTS}"
    one = pieces.select("path", "piece", "source_hash", "error", "first", "before", "rows", "parts", "counts").mapInArrow(
        written, f"path string, piece int, {kind}")
    return (one.repartition("path").sortWithinPartitions("path", "piece").mapInArrow(joined, f"path string, {kind}")
            .withColumn("counts", F.map_from_entries("counts")))
