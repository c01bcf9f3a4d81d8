"""Merging one clean batch into history.

``merge`` is a pure function of two frames. The result carries a ``_change`` column that
says what happened to each row, so counts come from the written result and not from a
second join.
"""

from __future__ import annotations

import calendar
import re
from collections.abc import Sequence
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.scale import with_one_row
from holdfast.spec import CONTENT_HASH, DELETION_RULES, KEY_HASH, LOAD_MODES, SPARK_TYPES, Source

INSERTED, UPDATED, UNCHANGED, DEACTIVATED, KEPT = "inserted", "updated", "unchanged", "deactivated", "kept"
_PERIOD = re.compile(r"^(\d{4})(?:-(\d{2})(?:-(\d{2}))?)?$")


class HistoryError(RuntimeError):
    """The requested change to history is not safe or not defined."""


def merge(history: DataFrame, clean: DataFrame, source: Source, run_id: str, *, load_mode: str | None = None,
          deletion_rule: str | None = None, lookback_days: int | None = None,
          period: str | None = None) -> DataFrame:
    """New history after one batch, under the source's load mode unless overridden."""
    mode = source.load_mode if load_mode is None else load_mode
    rule = source.deletion_rule if deletion_rule is None else deletion_rule
    days = source.lookback_days if lookback_days is None else lookback_days
    if mode not in LOAD_MODES:
        raise HistoryError(f"load mode {mode!r} is not one of {LOAD_MODES}")
    if rule not in DELETION_RULES:
        raise HistoryError(f"deletion rule {rule!r} is not one of {DELETION_RULES}")
    require_columns(history, source)
    if mode == "append":
        return append(history, clean, source, run_id)
    if mode == "replace_period":
        return replace_period(history, clean, source, run_id, period)
    return upsert(history, clean, source, run_id, rule, days if mode == "upsert" else 0)


def require_columns(history: DataFrame, source: Source) -> None:
    """Refuse a stored history whose columns are not the declared ones."""
    declared, stored = set(source.history_schema().names), set(history.columns) - {"_change"}
    if declared != stored:
        raise HistoryError(
            f"{source.source_id}: stored history lacks {sorted(declared - stored)} and has undeclared "
            f"{sorted(stored - declared)}; evolve it with add_columns first")


def add_columns(history: DataFrame, source: Source, names: Sequence[str]) -> DataFrame:
    """Additive evolution: named new columns are NULL in rows already stored. Safe to repeat."""
    added = {n: F.lit(None).cast(SPARK_TYPES[source.columns[n]]) for n in names if n not in history.columns}
    return history.withColumns(added) if added else history


def new_rows(clean: DataFrame, source: Source, run_id: str) -> DataFrame:
    return clean.select(
        *source.names, KEY_HASH, CONTENT_HASH, F.lit(True).alias("is_active"),
        F.lit(run_id).alias("first_seen_run_id"), F.lit(run_id).alias("last_seen_run_id"),
        "_source_file", "_source_row_number")


def append(history: DataFrame, clean: DataFrame, source: Source, run_id: str) -> DataFrame:
    """Add rows with unknown keys. Stored rows pass through unread by the join but for their key."""
    stored = history.select(*source.history_schema().names)
    unknown = clean.join(stored.select(KEY_HASH), KEY_HASH, "left_anti")
    return (stored.withColumn("_change", F.lit(KEPT))
            .unionByName(new_rows(unknown, source, run_id).withColumn("_change", F.lit(INSERTED))))


def upsert(history: DataFrame, clean: DataFrame, source: Source, run_id: str,
           deletion_rule: str = "ignore", lookback_days: int = 0) -> DataFrame:
    """Insert, update, re-see and retire rows in one full outer join on the key hash.

    Both sides hold a key at most once, so no key can weigh more than any other.
    """
    names = source.history_schema().names
    batch_names = [*source.names, KEY_HASH, CONTENT_HASH, "_source_file", "_source_row_number"]
    h = history.select(*[F.col(n).alias(f"h_{n}") for n in names])
    c = clean.select(*[F.col(n).alias(f"c_{n}") for n in batch_names])
    joined = h.join(c, F.col(f"h_{KEY_HASH}") == F.col(f"c_{KEY_HASH}"), "full_outer")
    retire = F.lit(False)
    if deletion_rule != "ignore":
        retire = F.col(f"h_{KEY_HASH}").isNotNull() & F.col("h_is_active")
        if lookback_days > 0:
            joined = with_one_row(joined, _batch_end(clean, source))
            # NULL on either side keeps the row.
            inside = F.col(f"h_{source.period_column}") >= F.date_sub("_batch_end", lookback_days)
            retire = retire & F.coalesce(inside, F.lit(False))

    stored, seen = F.col(f"h_{KEY_HASH}").isNotNull(), F.col(f"c_{KEY_HASH}").isNotNull()
    changed = F.col(f"h_{CONTENT_HASH}") != F.col(f"c_{CONTENT_HASH}")
    change = (F.when(~stored, F.lit(INSERTED))
              .when(seen & changed, F.lit(UPDATED))
              .when(seen, F.lit(UNCHANGED))
              .when(retire, F.lit(DEACTIVATED))
              .otherwise(F.lit(KEPT)))
    judged = joined.withColumn("_change", change)
    takes_batch = F.col("_change").isin(INSERTED, UPDATED)
    if deletion_rule == "physical":
        judged = judged.where(F.col("_change") != DEACTIVATED)

    def merged(name: str) -> Column:
        if name == "is_active":
            return (F.when(seen, F.lit(True)).when(F.col("_change") == DEACTIVATED, F.lit(False))
                    .otherwise(F.col("h_is_active")))
        if name == "first_seen_run_id":
            return F.coalesce(F.col("h_first_seen_run_id"), F.lit(run_id))
        if name == "last_seen_run_id":
            return F.when(seen, F.lit(run_id)).otherwise(F.col("h_last_seen_run_id"))
        return F.when(takes_batch, F.col(f"c_{name}")).otherwise(F.col(f"h_{name}"))

    return judged.select(*[merged(n).alias(n) for n in names], "_change")


def _batch_end(clean: DataFrame, source: Source) -> DataFrame:
    _require_date(source)
    return clean.agg(F.max(source.period_column).alias("_batch_end"))


def _require_date(source: Source) -> None:
    if source.columns[source.period_column] != "DATE":
        raise HistoryError(f"{source.source_id}: {source.period_column} must be a DATE to place rows in time")


def period_bounds(period: str) -> tuple[date, date]:
    """First day of a year, month or day period, and the first day after it."""
    match = _PERIOD.fullmatch(period)
    if not match:
        raise HistoryError(f"period {period!r} is not YYYY, YYYY-MM or YYYY-MM-DD")
    year, month, day = (int(part) if part else None for part in match.groups())
    try:
        if month is None:
            return date(year, 1, 1), date(year + 1, 1, 1)
        if day is None:
            first = date(year, month, 1)
            return first, first + timedelta(days=calendar.monthrange(year, month)[1])
        return date(year, month, day), date(year, month, day) + timedelta(days=1)
    except ValueError as problem:
        raise HistoryError(f"period {period!r} is not in the calendar") from problem


def in_period(column: str, period: str) -> Column:
    """Range test on the bare column, so that it reaches the Parquet scan."""
    first, after = period_bounds(period)
    return (F.col(column) >= F.lit(first)) & (F.col(column) < F.lit(after))


def replace_period(history: DataFrame, clean: DataFrame, source: Source, run_id: str,
                   period: str | None) -> DataFrame:
    """Drop the stored period, then append. The batch must lie wholly inside the period."""
    check_period(clean, source, period)
    return append(history.where(outside_period(source, period)), clean, source, run_id)


def outside_period(source: Source, period: str) -> Column:
    return ~F.coalesce(in_period(source.period_column, period), F.lit(False))


def check_period(clean: DataFrame, source: Source, period: str | None) -> None:
    """Refuse a batch that does not lie wholly inside a named period."""
    if not period:
        raise HistoryError(f"{source.source_id}: replacing a period needs the period to be named")
    _require_date(source)
    when = source.period_column
    bounds = clean.agg(F.min(when).alias("first"), F.max(when).alias("last")).first()
    if bounds["first"] is None:
        raise HistoryError(f"{source.source_id}: the batch has no dated rows for period {period}")
    first, after = period_bounds(period)
    if bounds["first"] < first or bounds["last"] >= after:
        raise HistoryError(f"{source.source_id}: rows from {bounds['first']} to {bounds['last']} "
                           f"do not lie in period {period}")


def change_counts(merged: DataFrame) -> DataFrame:
    """Rows inserted, updated, unchanged and deactivated, in one row."""
    return merged.agg(*[F.coalesce(F.sum((F.col("_change") == c).cast("long")), F.lit(0)).alias(c)
                        for c in (INSERTED, UPDATED, UNCHANGED, DEACTIVATED)])


def active(history: DataFrame) -> DataFrame:
    return history.where("is_active")


def without_change(merged: DataFrame) -> DataFrame:
    return merged.drop("_change")
