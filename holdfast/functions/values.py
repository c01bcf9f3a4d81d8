"""Column expressions that read text as typed values and fingerprint rows."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from holdfast.spec import SPARK_TYPES, Source

# Spellings read as booleans, and the separators inside a fingerprint.
TRUE_TEXT = ("true", "t", "yes", "y", "1")
FALSE_TEXT = ("false", "f", "no", "n", "0")
FIELD_SEPARATOR = "\x1f"
NULL_MARK = "\x00"
# Year, month and day with one separator throughout, optionally followed by a clock time.
DATE_TEXT = (
    r"^\s*\d{4}([-/\\ ])\d{1,2}\1\d{1,2}"
    r"([T ]([01]?\d|2[0-3]):[0-5]\d(:[0-5]\d(\.\d+)?)?)?\s*$"
)
DATE_PARTS = r"^\s*(\d{4})[-/\\ ](\d{1,2})[-/\\ ](\d{1,2}).*$"


def is_blank(text: Column) -> Column:
    """NULL or nothing but spaces."""
    return text.isNull() | (F.trim(text) == "")


def read_as(text: Column, kind: str) -> Column:
    """Value of ``text`` in a declared type; NULL when it cannot be read.

    Integers go through a decimal so that ``12.0`` and ``1e3`` are whole numbers and a
    fraction is rounded half up. A bare cast to date would also take ``2026`` or a bad
    clock time, so the shape is checked first.
    """
    if kind == "VARCHAR":
        return F.trim(text)
    if kind == "DATE":
        # The usual spelling needs no pattern: ten characters with dashes in the right places.
        usual = (F.length(text) == 10) & (F.substring(text, 5, 1) == "-") & (F.substring(text, 8, 1) == "-")
        iso = F.regexp_replace(text, DATE_PARTS, "$1-$2-$3")
        return F.when(usual, text.try_cast("date")).when(text.rlike(DATE_TEXT), iso.try_cast("date"))
    if kind in ("INTEGER", "BIGINT"):
        whole = F.round(text.try_cast("decimal(38,10)"), 0)
        # Plain digits need no decimal.
        return F.coalesce(text.try_cast(SPARK_TYPES[kind]), whole.try_cast(SPARK_TYPES[kind]))
    if kind == "BOOLEAN":
        lowered = F.lower(text)
        return F.when(lowered.isin(*TRUE_TEXT), F.lit(True)).when(lowered.isin(*FALSE_TEXT), F.lit(False))
    return text.try_cast(SPARK_TYPES[kind])


def is_true_text(text: Column) -> Column:
    """Older flag rule: any spelling outside the approved ones counts as false."""
    # The approved spellings.
    return F.lower(F.trim(text)).isin("true", "1", "yes", "y")


def fingerprint(typed: Iterable[Column]) -> Column:
    """md5 over typed values, so ``1`` and ``1.0`` in a decimal column are the same row."""
    parts = [F.coalesce(value.cast("string"), F.lit(NULL_MARK)) for value in typed]
    return F.md5(F.concat_ws(FIELD_SEPARATOR, *parts))


def typed_columns(source: Source, text: dict[str, Column]) -> dict[str, Column]:
    return {name: read_as(text[name], kind) for name, kind in source.columns.items()}
