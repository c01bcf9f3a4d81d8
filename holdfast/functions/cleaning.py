"""Spreadsheet text to numbers and dates, as column expressions.

Nothing here coerces to zero: text that cannot be read is NULL and is counted.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The error texts a spreadsheet cell can hold.
CELL_ERRORS = ("#N/A", "#VALUE!", "#DIV/0!", "#REF!", "#NAME?", "#NUM!", "#NULL!")
# Arabic-Indic and Eastern Arabic-Indic digits and their ASCII digits.
LOCAL_DIGITS = "٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹"
ASCII_DIGITS = "01234567890123456789"

_EDGE_SPACE = "^[\\s\u00a0]+|[\\s\u00a0]+$"
_EXPONENT = r"([eE][+-]?\d+)?"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, _EDGE_SPACE, "")


def blank_to_null(text: Column) -> Column:
    bare = strip(text)
    return F.when(bare != "", bare)


def is_cell_error(text: Column) -> Column:
    return F.coalesce(F.upper(strip(text)).isin(*CELL_ERRORS), F.lit(False))


def conversion_outcome(text: Column, number: Column) -> Column:
    """What became of a cell: ``blank``, ``error``, ``failed`` or ``number``."""
    return (
        F.when(blank_to_null(text).isNull(), F.lit("blank"))
        .when(is_cell_error(text), F.lit("error"))
        .when(number.isNull(), F.lit("failed"))
        .otherwise(F.lit("number"))
    )


def clean_numbers(raw: DataFrame, column: str, decimal_separator: str = ".",
                  kind: str = "decimal(38,10)") -> DataFrame:
    """Read numbers written by hand: adds ``<column>_number`` and ``<column>_outcome``.

    A number is NULL when its cell is blank, holds an error text or is ambiguous. With both
    separators present the last one is the decimal sign. With one present it is the decimal
    sign only when it is ``decimal_separator``; otherwise it has to form groups of three
    digits. Each step is a projection of its own, so no step is evaluated twice.
    """
    if decimal_separator not in (".", ","):
        raise ValueError("the decimal separator is '.' or ','")
    text = F.col("_text")

    def grouped(group: str) -> str:
        return rf"^[+-]?\d{{1,3}}({re.escape(group)}\d{{3}})+"

    def without(group: str) -> Column:
        return F.replace(text, F.lit(group), F.lit(""))

    thousands = "," if decimal_separator == "." else "."
    own = re.escape(decimal_separator)
    plain = (
        F.when(text.rlike(rf"^[+-]?\d+{_EXPONENT}$"), text)
        .when(text.rlike(grouped(",") + r"\.\d+$"), without(","))
        .when(text.rlike(grouped(".") + r",\d+$"), F.translate(without("."), ",", "."))
        .when(text.rlike(rf"^[+-]?(\d+{own}\d*|{own}\d+){_EXPONENT}$"), F.translate(text, decimal_separator, "."))
        .when(text.rlike(grouped(thousands) + "$"), without(thousands)))
    steps = (raw
             .withColumn("_text", F.translate(blank_to_null(F.col(column)), LOCAL_DIGITS, ASCII_DIGITS))
             .withColumn("_bracketed", text.startswith("(") & text.endswith(")"))
             .withColumn("_text", F.when(F.col("_bracketed"), strip(F.regexp_replace(text, r"^\(|\)$", "")))
                         .otherwise(text))
             .withColumn("_trailing", text.endswith("-"))
             .withColumn("_text", F.when(F.col("_trailing"), F.regexp_replace(text, "-$", "")).otherwise(text))
             .withColumn("_text", F.translate(text, " \u00a0", ""))
             .withColumn("_plain", plain.try_cast(kind)))
    number = F.when(F.col("_bracketed") | F.col("_trailing"), -F.col("_plain")).otherwise(F.col("_plain"))
    numbered = steps.withColumn(f"{column}_number", number).drop("_text", "_bracketed", "_trailing", "_plain")
    return numbered.withColumn(f"{column}_outcome", conversion_outcome(F.col(column), F.col(f"{column}_number")))


def outcome_counts(cleaned: DataFrame, column: str) -> DataFrame:
    """How many cells were numbers, blank, error texts or unreadable."""
    return cleaned.groupBy(F.col(f"{column}_outcome").alias("outcome")).agg(F.count("*").alias("cells"))


def serial_to_date(serial: Column, system_1904: bool = False) -> Column:
    """Date of a spreadsheet serial number.

    The 1900 system counts a 29 February 1900 that never was, so serials after 59 are
    one day behind; 59 and 60 therefore share a date.
    """
    days = serial.cast("int")
    if system_1904:
        return F.date_add(F.lit("1904-01-01").cast("date"), days)
    return F.date_add(F.lit("1899-12-31").cast("date"), F.when(days > 59, days - 1).otherwise(days))
