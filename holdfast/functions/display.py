"""Text shown for numbers, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The mark for an absent number, and the digits and suffix of each style.
ABSENT = "—"
STYLES = {"decimal": (2, ""), "percent": (1, "%"), "integer": (0, "")}


def display_text(value: Column, style: str) -> Column:
    """Thousands separators and half-even rounding in one of three styles."""
    if style in STYLES:
        digits, suffix = STYLES[style]
        shown = F.concat(F.format_number(value, digits), F.lit(suffix))
    else:
        shown = value.cast("string")
    return F.coalesce(shown, F.lit(ABSENT))


def readable(value: Column) -> Column:
    """Exact value without trailing zeros, e.g. ``1,234.5``."""
    shown = F.call_function("format_number", value, F.lit("#,##0.##########"))
    return F.coalesce(shown, F.lit(ABSENT))


def fixed(value: Column, digits: int) -> Column:
    """Half-even rounding without separators, as text."""
    return F.bround(value, digits).cast(f"decimal(38,{digits})").cast("string")
