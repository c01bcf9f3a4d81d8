"""Evidence objects: verified figures with their references and one fixed sentence.

Each builder maps a one-row frame to a frame with at most one row; no row means there is
nothing that can be claimed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.functions.display import fixed, readable

# The sentence formats and the confidence mark.
MOVED = "%s moved from %s%s to %s%s between %s and %s."
CONTRIBUTES = ("%s is the largest contributor with %s %s%s. "
               "Treat it as an investigation priority, not a confirmed cause.")
VERIFIED = "verified"
MAX_EVIDENCE = 5


def _refs(metric_id: str, query: str) -> Column:
    return F.array(F.lit(f"metric:{metric_id}"), F.lit(f"sql:{query}"))


def _number(value: Column) -> Column:
    return value.cast("double")


def _period_change(row: DataFrame, current: Column, comparison: Column, shown, *, evidence_id: str, metric_id: str,
                   query: str, label: str, unit: str) -> DataFrame:
    suffix = f" {unit}" if unit else ""
    change = F.col("_now") - F.col("_then")
    percent = F.when(F.col("_then") != 0, _number(change) / _number(F.col("_then")) * 100)
    usable = row.withColumns({"_now": current, "_then": comparison}).where(
        "_now is not null and _then is not null and comparison_period is not null")
    return usable.select(
        F.lit(evidence_id).alias("id"), F.lit("period_change").alias("type"), F.lit(metric_id).alias("metric_id"),
        F.col("current_period").cast("string").alias("current_period"), _number(F.col("_now")).alias("current"),
        F.col("comparison_period").cast("string").alias("comparison_period"),
        _number(F.col("_then")).alias("comparison"),
        _number(change).alias("change_absolute"), _number(percent).alias("change_percent"),
        F.lit(VERIFIED).alias("confidence"), _refs(metric_id, query).alias("evidence_refs"),
        F.format_string(MOVED, F.lit(label), shown(F.col("_then")), F.lit(suffix), shown(F.col("_now")), F.lit(suffix),
                        F.col("comparison_period").cast("string"), F.col("current_period").cast("string")).alias("text"))


def period_change_value(row: DataFrame, value: str, **words: str) -> DataFrame:
    """Movement of one figure between the two periods of ``metrics.latest_pair``."""
    return _period_change(row, F.col(f"current_{value}"), F.col(f"comparison_{value}"),
                          lambda v: v.cast("string"), **words)


def period_change_rate(row: DataFrame, numerator: str, denominator: str, scale: int, **words: str) -> DataFrame:
    """Movement of a ratio of two figures; nothing when either denominator is zero or absent."""
    def ratio(prefix: str) -> Column:
        below = F.col(f"{prefix}_{denominator}")
        return F.when(below != 0, F.col(f"{prefix}_{numerator}").cast("double") / below.cast("double") * scale)

    return _period_change(row, ratio("current"), ratio("comparison"), lambda v: fixed(v, 2), **words)


def top_contributor(rows: DataFrame, dimension: str, value: str, share: str | None = None, *, evidence_id: str,
                    metric_id: str, query: str, value_label: str = "units") -> DataFrame:
    """The first row of a ranked share table. States size and share, never a cause."""
    part = F.lit("") if share is None else F.coalesce(
        F.concat(F.lit(" ("), fixed(F.col(share), 1), F.lit("% of the total)")), F.lit(""))
    return rows.limit(1).where(F.col(dimension).isNotNull() & F.col(value).isNotNull()).select(
        F.lit(evidence_id).alias("id"), F.lit("contributor").alias("type"), F.lit(metric_id).alias("metric_id"),
        _number(F.col(value)).alias("current"), F.lit(VERIFIED).alias("confidence"),
        _refs(metric_id, query).alias("evidence_refs"),
        F.format_string(CONTRIBUTES, F.col(dimension).cast("string"), readable(F.col(value)),
                        F.lit(value_label), part).alias("text"))
