"""Leak guards for tables that must not hold personal data."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.functions.arrays import lit
from veilframe.operators.substrings import row_values

# The length up to which a text is not tested, and the patterns of the guard.
SAFE_LENGTH = 200
GUARD_PATTERNS = {
    "ni": r"(?i)[A-CEGHJ-PR-TW-Z]{2}\d{6}[A-D]",
    "nhs": r"(?U)\b\d{3}\s\d{3}\s\d{4}\b",
    "email": r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}",
    "card": r"(?U)\b(?:\d[ -]?){13,16}\b",
}
PRIVATE_COLUMNS = ("original", "original_text", "real_value", "hits", "spans")


class LeakError(ValueError):
    """A table holds columns or values that must not be stored."""


def leaks(df: DataFrame, key: str, columns: Iterable[str] | None = None) -> DataFrame:
    """``(key, column_name, pattern)`` for every long text value that matches a pattern.

    Only the first matching pattern of a value is named; ``event`` columns are exempt.
    """
    names = [f.name for f in df.schema.fields if f.dataType.typeName() == "string"]
    names = [n for n in (columns or names) if n not in (key, "event")]
    tests = []
    for n in names:
        cases = " ".join(f"WHEN `{n}` RLIKE {lit(rx)} THEN {lit(name)}"
                         for name, rx in GUARD_PATTERNS.items())
        tests.append(f"named_struct('column_name', {lit(n)}, 'pattern', "
                     f"CASE WHEN length(`{n}`) <= {SAFE_LENGTH} THEN NULL {cases} END)")
    return (df.select(key, F.expr(f"inline(array({', '.join(tests)}))"))
            .filter("pattern IS NOT NULL"))


def assert_no_private_columns(df: DataFrame) -> DataFrame:
    """Refuse to store columns that carry original values."""
    found = [c for c in df.columns if c in PRIVATE_COLUMNS]
    if found:
        raise LeakError(f"columns with original values: {', '.join(found)}")
    return df


def residual_values(texts: DataFrame, keys: list[str], text: str, known: DataFrame,
                    value: str) -> DataFrame:
    """``(*keys, value)`` for known values that still occur in ``text``, also inside longer words;
    empty for a clean output.

    No text meets every value: values are found by their anchors, see ``substrings``. A row gives
    each value once; empty values are ignored.
    """
    return row_values(texts, keys, text, known, value)
