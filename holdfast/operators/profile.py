"""Column profile of raw text: nulls, kinds of value and distinct values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# How text is recognised, tried in this order.
KIND_PATTERNS = (
    ("date_like_text", r"^\d{4}-\d{2}-\d{2}([ T].*)?$"),
    ("integer_like_text", r"^[+-]?\d+$"),
    ("number_like_text", r"^[+-]?\d+([.,]\d+)?$"),
)
KINDS = ("null", "date_like_text", "integer_like_text", "number_like_text", "text")


def text_kind(text: Column) -> Column:
    bare = F.trim(text)
    kind = F.when(text.isNull() | (bare == ""), F.lit("null"))
    for name, pattern in KIND_PATTERNS:
        kind = kind.when(bare.rlike(pattern), F.lit(name))
    return kind.otherwise(F.lit("text"))


def column_profile(raw: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per column: values of each kind, and the exact number of distinct ones.

    One aggregate counts kinds, a set of counters for each column. Distinct values are counted in two steps over
    (column, value), so each task first merges its own repeats and no column meets in one task.
    """
    spark = raw.sparkSession
    kinds = raw.select(*[text_kind(F.col(f"`{c}`")).alias(f"k{i}") for i, c in enumerate(columns)])
    # One row, a few counters per column, reaches the driver.
    counted = kinds.agg(F.count("*").alias("rows"), *[
        F.count_if(F.col(f"k{i}") == kind).alias(f"{kind}_{i}") for i in range(len(columns)) for kind in KINDS]).first()
    pairs = F.array(*[F.struct(F.lit(i).alias("number"), F.col(f"`{c}`").alias("value")) for i, c in enumerate(columns)])
    values = raw.select(F.inline(pairs)).where(text_kind(F.col("value")) != "null").distinct()
    distinct = {r["number"]: r["n"] for r in values.groupBy("number").agg(F.count("*").alias("n")).collect()}

    profile = []
    for i, name in enumerate(columns):
        rows, nulls, n = counted["rows"], counted[f"null_{i}"], distinct.get(i, 0)
        profile.append((name, rows - nulls, nulls, *[counted[f"{k}_{i}"] for k in KINDS[1:]], n, rows > 0 and n == rows))
    schema = ("column_name string, non_null long, nulls long, " + ", ".join(f"{k} long" for k in KINDS[1:])
              + ", distinct_count long, candidate_unique_key boolean")
    return spark.createDataFrame(profile, schema)
