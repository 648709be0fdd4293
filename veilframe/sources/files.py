"""Files: discovery, formats, output names, reading and writing folders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.functions import text as X
from veilframe.functions.arrays import lit
from veilframe.sources import csvsplit

# Formats and the extension of their output.
SUPPORTED = ("csv", "docx", "eml", "pdf", "txt", "xlsx")
READABLE = ("csv", "eml", "txt")
OUTPUT_EXTENSION = {"pdf": "docx", "eml": "txt"}
SUFFIX, RESTORED = "_scrubbed", "_restored"
# Columns that ``read_csv`` adds.
PATH, ROW = "_source_path", "_source_row"


def extension(path: str) -> str:
    return f"lower(regexp_extract({path}, {lit(r'[.]([^./]+)$')}, 1))"


def discover(files: DataFrame, path: str = "path", suffix: str = SUFFIX) -> DataFrame:
    """Keep supported files, adding ``format``; outputs of an earlier run are left out."""
    own = f"regexp_like({path}, {lit(suffix + r'[.][^./]+$')})"
    return (files.withColumn("format", F.expr(extension(path)))
            .filter(F.col("format").isin(*SUPPORTED) & ~F.expr(own)))


def format_errors(files: DataFrame, path: str = "path") -> DataFrame:
    """Add ``format`` and ``error``: NULL, or why the file is rejected."""
    listed = ", ".join("." + s for s in SUPPORTED)
    fmt = F.expr(extension(path))
    return files.withColumn("format", fmt).withColumn(
        "error", F.when(~F.col("format").isin(*SUPPORTED), F.concat(
            F.lit("unsupported format ."), F.col("format"), F.lit("; supported: " + listed))))


def output_name(path: str, suffix: str = SUFFIX, keep_format: bool = False) -> Column:
    """Path of the output: same folder and stem with a suffix, extension by format or kept."""
    ext = extension(path)
    if keep_format:
        return F.regexp_replace(path, "([.][^./]+)$", f"{suffix}$1")
    cases = " ".join(f"WHEN {ext} = {lit(a)} THEN {lit(b)}" for a, b in OUTPUT_EXTENSION.items())
    stem = f"regexp_replace({path}, {lit('[.][^./]+$')}, '')"
    return F.expr(f"concat({stem}, {lit(suffix + '.')}, CASE {cases} ELSE {ext} END)")


def read_folder(spark: SparkSession, folder: str) -> DataFrame:
    """All supported files below ``folder`` with their bytes and content hash."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder))
    return (discover(files.select("path", "content"))
            .withColumn("source_hash", F.sha2("content", 256)))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV files with one header, every column as text; adds PATH and ROW, names that no
    column of a file should have (a file that has one is refused).

    Files are split, also where cells hold line breaks, see ``csvsplit``. Quotes stand only
    around cells and, doubled, inside quoted ones. Rows count from 1 whatever the splits; rows
    without any value are kept.
    """
    return csvsplit.read(spark, path, PATH, ROW)


def read_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Text files as ``(path, source_hash, text)``; invalid UTF-8 becomes U+FFFD."""
    return (read_folder(spark, folder).filter(F.col("format") == "txt")
            .select("path", "source_hash", F.expr(X.utf8("content")).alias("text")))
