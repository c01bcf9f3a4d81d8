"""Drift of a source: its columns against the declaration, its rows against an earlier extract."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from holdfast.operators.quality import BLOCK, PASS, WARNING
from holdfast.scale import with_one_row
from holdfast.spec import SPARK_TYPES, Source


def schema_drift(spark: SparkSession, source: Source, previous: Sequence[str], present: T.StructType) -> DataFrame:
    """One row per column: moved is fine, a new one is a warning, a missing or retyped one blocks.

    Text is accepted for every declared type, since typing happens after staging.
    """
    rows, names = [], present.names
    for position, name in enumerate(names):
        kind = present[name].dataType
        if name not in source.columns:
            rows.append((name, "new", WARNING))
        elif kind not in (T.StringType(), SPARK_TYPES[source.columns[name]]):
            rows.append((name, "type changed", BLOCK))
        elif name in previous and list(previous).index(name) != position:
            rows.append((name, "moved", PASS))
        else:
            rows.append((name, "same", PASS))
    for name in source.columns:
        if name not in names:
            rows.append((name, "missing", BLOCK if name in (*source.required_columns, *source.key) else WARNING))
    return spark.createDataFrame(rows, "column_name string, change string, status string")


def dataset_facts(frame: DataFrame, source: Source) -> DataFrame:
    """Row count, date span, null rate and category count of each column, in one pass and one row."""
    def null_rate(name: str) -> Column:
        return (F.count_if(F.col(name).isNull()).cast("double") / F.count("*")).alias(f"nulls_{name}")

    return frame.agg(
        F.count("*").alias("rows"), F.min(source.period_column).alias("first"), F.max(source.period_column).alias("last"),
        *[null_rate(n) for n in source.names],
        *[F.count_distinct(n).alias(f"categories_{n}") for n in source.categories])


def dataset_drift(current: DataFrame, previous: DataFrame, source: Source, limits: Mapping[str, float],
                  latest_period: str | None = None) -> DataFrame:
    """Measures of two extracts side by side, with a warning where the movement passes its limit.

    ``limits`` holds ``row_count_pct``, ``null_rate`` and ``category_count``.
    """
    now, then = dataset_facts(current, source), dataset_facts(previous, source)
    both = with_one_row(now.select(*[F.col(c).alias(f"now_{c}") for c in now.columns]),
                        then.select(*[F.col(c).alias(f"then_{c}") for c in then.columns]))

    def line(measure: str, fact: str, movement: Column, limit: float) -> Column:
        status = F.when(movement > limit, F.lit(WARNING)).otherwise(F.lit(PASS))
        return F.struct(F.lit(measure).alias("measure"), F.col(f"then_{fact}").cast("string").alias("previous"),
                        F.col(f"now_{fact}").cast("string").alias("current"), status.alias("status"))

    def moved(fact: str) -> Column:
        return F.abs(F.col(f"now_{fact}") - F.col(f"then_{fact}"))

    def plain(measure: str, fact: str, is_bad: Column) -> Column:
        return F.struct(F.lit(measure).alias("measure"), F.col(f"then_{fact}").cast("string").alias("previous"),
                        F.col(f"now_{fact}").cast("string").alias("current"),
                        F.when(is_bad, F.lit(WARNING)).otherwise(F.lit(PASS)).alias("status"))

    rows_pct = F.when(F.col("then_rows") != 0, moved("rows").cast("double") / F.col("then_rows") * 100)
    absent = (F.lit(False) if latest_period is None
              else ~F.coalesce(F.col("now_last").cast("string").startswith(latest_period), F.lit(False)))
    lines = [line("row_count", "rows", rows_pct, limits["row_count_pct"]),
             plain("first_date", "first", F.lit(False)),
             plain("last_date", "last", absent | (F.col("now_last") < F.col("then_last"))),
             *[line(f"null_rate.{n}", f"nulls_{n}", moved(f"nulls_{n}"), limits["null_rate"]) for n in source.names],
             *[line(f"category_count.{n}", f"categories_{n}", moved(f"categories_{n}"), limits["category_count"])
               for n in source.categories]]
    return both.select(F.inline(F.array(*lines)))


def category_drift(current: DataFrame, previous: DataFrame, source: Source) -> DataFrame:
    """One row per category of a declared column in either extract: ``column_name, category, rows_before, rows_now, change,
    status``. A new category is a warning, and so is a lost one; NULL is a category of its own.

    Each extract is read once and counted before the shuffle, so a category costs one row per task, however many rows it has.
    """
    def cells(frame: DataFrame, before: int) -> DataFrame:
        each = [F.struct(F.lit(n).alias("column_name"), F.col(n).cast("string").alias("category")) for n in source.categories]
        return frame.select(F.inline(F.array(*each))).withColumns({"before": F.lit(before), "now": F.lit(1 - before)})

    counted = (cells(previous, 1).unionByName(cells(current, 0)).groupBy("column_name", "category")
               .agg(F.sum("before").alias("rows_before"), F.sum("now").alias("rows_now")))
    change = F.when(F.col("rows_before") == 0, "new").when(F.col("rows_now") == 0, "lost").otherwise("same")
    return counted.select("*", change.alias("change"), F.when(change == "same", PASS).otherwise(WARNING).alias("status"))
