"""Reusable metrics over active history.

Sums stay exact decimals; rates are doubles. Rows are aggregated before anything is
joined, ranked or ordered, and totals are attached as one row instead of a global window.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from holdfast.scale import running_total, settle, with_one_row

PPM = 1_000_000
PERCENT = 100


def money(value: Column) -> Column:
    return value.cast("decimal(38,4)")


def total(value: Column | str) -> Column:
    """Sum that is zero, not NULL, over no rows."""
    return F.coalesce(F.sum(value), F.lit(0))


def rate(numerator: Column, denominator: Column, scale: int) -> Column:
    """Ratio of two sums; NULL when the denominator is zero or absent."""
    return F.when(F.coalesce(denominator, F.lit(0)) != 0,
                  numerator.cast("double") / denominator.cast("double") * scale)


def average(value: Column | str) -> Column:
    """Mean as a double from the exact sum and count; NULL over no rows."""
    return F.when(F.count(value) > 0, F.sum(value).cast("double") / F.count(value))


def sums_by(frame: DataFrame, by: Sequence[str], sums: Mapping[str, Column | str]) -> DataFrame:
    return frame.groupBy(*by).agg(*[F.sum(value).alias(name) for name, value in sums.items()])


def weighted_rate(frame: DataFrame, numerator: Column, denominator: Column, scale: int,
                  name: str = "rate") -> DataFrame:
    return frame.agg(rate(F.sum(numerator), F.sum(denominator), scale).alias(name))


def trend(frame: DataFrame, date: str, sums: Mapping[str, Column | str],
          rate_of: tuple[str, str, int] | None = None) -> DataFrame:
    """Sums per date in date order, optionally with the rate of two of the sums."""
    daily = sums_by(frame, [date], sums)
    if rate_of:
        numerator, denominator, scale = rate_of
        daily = daily.withColumn("rate", rate(F.col(numerator), F.col(denominator), scale))
    return daily.orderBy(F.asc_nulls_last(date))


def latest(frame: DataFrame, date: str, sums: Mapping[str, Column | str], periods: int = 2) -> DataFrame:
    """Sums of the newest dates."""
    return sums_by(frame, [date], sums).orderBy(F.desc_nulls_last(date)).limit(periods)


def by_dimension(fact: DataFrame, dimension: DataFrame, on: Sequence[str], by: Sequence[str],
                 sums: Mapping[str, Column | str]) -> DataFrame:
    """Sums of fact measures per dimension attribute (inner join).

    Facts are summed per join key first, so the join sees a key once, a key with a large
    share of the facts costs no more than any other, and Spark may broadcast either side
    by its size.
    """
    per_key = sums_by(fact, on, sums)
    attributes = dimension.select(*dict.fromkeys([*on, *by]))
    return (per_key.join(attributes, list(on), "inner").groupBy(*by)
            .agg(*[F.sum(name).alias(name) for name in sums]))


def ranked(groups: DataFrame, by: str, measure: str, n: int | None = None) -> DataFrame:
    """Largest first, ties in name order; a top-n never sorts all groups on one task."""
    ordered = groups.orderBy(F.desc_nulls_last(measure), F.asc_nulls_last(by))
    return ordered if n is None else ordered.limit(n)


def pareto(groups: DataFrame, by: str, measure: str) -> DataFrame:
    """Groups from largest to smallest with the running percentage of the total."""
    settled = settle(groups.select(by, measure))
    grand = settled.agg(F.sum(measure).alias("_grand"))
    order = [F.desc_nulls_last(measure), F.asc_nulls_last(by)]
    running = running_total(settled, measure, order, "_running")
    return (with_one_row(running, grand)
            .select(by, measure, rate(F.col("_running"), F.col("_grand"), PERCENT).alias("cumulative_pct"))
            .orderBy(F.desc_nulls_last(measure), F.asc_nulls_last(by)))


def share_of_total(groups: DataFrame, by: str, measure: str, n: int | None = None) -> DataFrame:
    """Each group's percentage of the sum over all groups, largest first."""
    shared = with_one_row(groups, groups.agg(F.sum(measure).alias("_grand")))
    share = rate(F.col(measure), F.col("_grand"), PERCENT).alias("share_pct")
    return ranked(shared.select(by, measure, share), by, measure, n)


def share_of_absolute(groups: DataFrame, by: str, measure: str, n: int | None = None) -> DataFrame:
    """Like :func:`share_of_total` where gains and losses would cancel out."""
    shared = with_one_row(groups, groups.agg(F.sum(F.abs(measure)).alias("_grand")))
    share = rate(F.abs(measure), F.col("_grand"), PERCENT).alias("share_pct")
    return ranked(shared.select(by, measure, share), by, measure, n)


def latest_snapshot(frame: DataFrame, date: str) -> DataFrame:
    """Rows of the newest snapshot date."""
    newest = frame.agg(F.max(date).alias("_newest"))
    return with_one_row(frame, newest).where(F.col(date) == F.col("_newest")).drop("_newest")


def price_variance(purchases: DataFrame, standard: DataFrame, *, item: str, quantity: Column, spend: Column,
                   standard_price: Column, by_purchase: Sequence[str] = (), by_item: Sequence[str] = ()) -> DataFrame:
    """Spend, spend at standard price and their difference, per purchase and item attributes.

    ``sum(q * (p - s)) = sum(q * p) - s * sum(q)`` holds exactly for decimals, so purchases are summed per item before
    the standard price is joined: a much bought item is one row in that join. Products are exact for prices below 10^11
    and quantities of an item below 10^18; beyond that they are an error, not a rounding.
    """
    prices = standard.select(*dict.fromkeys([item, *by_item]), standard_price.cast("decimal(15,4)").alias("_standard"))
    measured = purchases.select(*dict.fromkeys([item, *by_purchase]), quantity.alias("_quantity"), spend.alias("_spend"))
    per_item = measured.groupBy(*dict.fromkeys([item, *by_purchase])).agg(
        F.sum("_quantity").cast("decimal(22,4)").alias("_quantity"), F.sum("_spend").alias("_spend"))
    at_standard = F.col("_standard") * F.col("_quantity")
    grouped = per_item.join(prices, item, "inner").groupBy(*by_purchase, *by_item).agg(
        F.sum(F.col("_spend").cast("decimal(38,8)")).alias("spend"), F.sum(at_standard.cast("decimal(38,8)")).alias("standard_spend"))
    return grouped.withColumn("variance", F.col("spend") - F.col("standard_spend"))


def shortage(master: DataFrame, demand: DataFrame, stock: DataFrame, key: str, label: str) -> DataFrame:
    """Open demand beyond stock per master row, never below zero.

    ``demand`` and ``stock`` hold one row per key with columns ``demand`` and ``stock``.
    """
    gap = F.coalesce("demand", F.lit(0)) - F.coalesce("stock", F.lit(0))
    return (master.join(demand, key, "left").join(stock, key, "left")
            .select(*dict.fromkeys([key, label]), F.greatest(gap, F.lit(0)).alias("shortage_qty"))
            .orderBy(F.desc("shortage_qty"), F.asc_nulls_last(label)))


def drill_through(frame: DataFrame, column: str, value: object, show: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows behind a figure, with the file and row they came from."""
    return frame.where(F.col(column) == F.lit(value)).select(*show).orderBy(*order)


def related(left: DataFrame, right: DataFrame, on: Sequence[tuple[str, str]], how: str,
            columns: Sequence[str]) -> DataFrame:
    """Join two sources under their declared keys and join type.

    Rows with a NULL in their key match nothing; they pass beside the join, as there may be many and a join would send
    all of them to one task.
    """
    renamed = right.select(*[F.col(r).alias(f"_right_{r}") for _, r in on],
                           *[c for c in columns if c in right.columns])
    condition = [F.col(l) == F.col(f"_right_{r}") for l, r in on]
    has_left = reduce(and_, [F.col(l).isNotNull() for l, _ in on])
    has_right = reduce(and_, [F.col(f"_right_{r}").isNotNull() for _, r in on])
    joined = left.where(has_left).join(renamed.where(has_right), condition, {"full": "full_outer"}.get(how, how))
    if how in ("left", "full"):
        joined = joined.unionByName(left.where(~has_left), allowMissingColumns=True)
    if how in ("right", "full"):
        joined = joined.unionByName(renamed.where(~has_right), allowMissingColumns=True)
    return joined.drop(*[f"_right_{r}" for _, r in on])


def latest_pair(frame: DataFrame, date: str, sums: Mapping[str, Column | str]) -> DataFrame:
    """The newest two dates side by side in one row: ``current_*`` and ``comparison_*``."""
    two = latest(frame, date, sums, 2).withColumn("_rank", F.row_number().over(Window.orderBy(F.desc_nulls_last(date))))
    columns = [date, *sums]

    def pick(rank: int, name: str, prefix: str) -> Column:
        label = "period" if name == date else name
        return F.max(F.when(F.col("_rank") == rank, F.col(name))).alias(f"{prefix}_{label}")

    return two.agg(*[pick(1, c, "current") for c in columns], *[pick(2, c, "comparison") for c in columns])


# ------------------------------------------------------------------ metric families

def calendar(spark: SparkSession, first: str, last: str, holidays: Sequence[str] = (),
             fiscal_year_start: int | None = None) -> DataFrame:
    """One row per day. Fiscal columns appear only when the first fiscal month is given."""
    day = F.col("day")
    days = spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("day"))
    is_holiday = day.cast("string").isin(*holidays) if holidays else F.lit(False)
    # ISO weeks belong to the year of their Thursday.
    thursday = F.date_add(day, 3 - F.weekday(day))
    columns = [day, F.format_string("%d-W%02d", F.year(thursday), F.weekofyear(day)).alias("week"),
               F.date_format(day, "yyyy-MM").alias("month"),
               F.format_string("%d-Q%d", F.year(day), F.quarter(day)).alias("quarter"), F.year(day).alias("year"),
               is_holiday.alias("is_holiday"), ((F.weekday(day) < 5) & ~is_holiday).alias("is_working_day")]
    if fiscal_year_start is not None:
        shifted = F.add_months(day, 1 - fiscal_year_start)
        columns += [F.year(shifted).alias("fiscal_year"), F.month(shifted).alias("fiscal_period")]
    return days.select(*columns)


def rolling(periods: DataFrame, number: Column, sums: Sequence[str], width: int) -> DataFrame:
    """Sums over this and the ``width - 1`` periods before it; one row per period goes in.

    ``number`` counts periods without a gap, so a period without rows takes its place in the width.
    """
    window = Window.orderBy(number).rangeBetween(1 - width, Window.currentRow)
    return periods.select("*", *[F.sum(s).over(window).alias(f"rolling_{s}") for s in sums])


def distinct_sets(frame: DataFrame, by: Sequence[str], member: str, sketch: bool = False) -> DataFrame:
    """The members of each group as mergeable sets: exact bitmaps, one per 32,768 consecutive members, and an HLL sketch.

    ``member`` is a whole number; NULL is no member. Sets of groups merge without another look at the rows. A sketch has
    a bounded size where bitmaps grow with the members; it stands beside the bitmaps of the group's least bucket.
    """
    rows = frame.where(F.col(member).isNotNull()).withColumn("_bucket", F.bitmap_bucket_number(member))
    sets = rows.groupBy(*by, "_bucket").agg(F.bitmap_construct_agg(F.bitmap_bit_position(member)).alias("members"))
    if not sketch:
        return sets
    least = rows.groupBy(*by).agg(F.hll_sketch_agg(F.col(member).cast("long")).alias("sketch"), F.min("_bucket").alias("_bucket"))
    same = reduce(and_, [sets[c].eqNullSafe(least[c]) for c in [*by, "_bucket"]])
    return sets.join(least, same, "left").select(*[sets[c] for c in sets.columns], "sketch")


def distinct_count(sets: DataFrame, by: Sequence[str], name: str = "distinct_count") -> DataFrame:
    """Exact members of the union of sets in each group, and an estimate from sketches where they are kept."""
    merged = sets.groupBy(*by, "_bucket").agg(F.bitmap_or_agg("members").alias("members"))
    counts = merged.groupBy(*by).agg(F.sum(F.bitmap_count("members")).alias(name))
    if "sketch" not in sets.columns:
        return counts
    estimates = sets.where("sketch IS NOT NULL").groupBy(*by).agg(
        F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias(f"{name}_estimate"))
    same = reduce(and_, [counts[c].eqNullSafe(estimates[c]) for c in by], F.lit(True))
    return counts.join(estimates, same, "left").select(*[counts[c] for c in counts.columns], f"{name}_estimate")


def rolling_distinct(sets: DataFrame, by: Sequence[str], month: str, width: int, name: str = "rolling_distinct") -> DataFrame:
    """Distinct members over this and the ``width - 1`` months before it, for the months that have rows.

    ``month`` is a first day of month. Each month's set joins the windows it lies in; months without rows take their place
    in the width. Sets are merged, rows are not read again.
    """
    months = sets.select(*by, month).distinct()
    windows = sets.withColumn("_end", F.explode(F.transform(
        F.sequence(F.lit(0), F.lit(width - 1)), lambda k: F.add_months(F.col(month), k)))).drop(month).withColumnRenamed("_end", month)
    counted = distinct_count(windows, [*by, month], name)
    same = reduce(and_, [counted[c].eqNullSafe(months[c]) for c in [*by, month]])
    return counted.join(months, same, "left_semi")


def growth(periods: DataFrame, number: Column, value: str) -> DataFrame:
    """Change of a figure against the period before it, absolute and in percent; NULL where that period has no row.

    ``number`` counts periods without a gap.
    """
    before = F.first(value).over(Window.orderBy(number).rangeBetween(-1, -1))
    return (periods.withColumn("previous", before)
            .withColumn("change", F.col(value) - F.col("previous"))
            .withColumn("growth_pct", rate(F.col("change"), F.col("previous"), PERCENT)))


def against_target(actual: DataFrame, target: DataFrame, on: Sequence[str], value: str, goal: str) -> DataFrame:
    """Figures beside their targets; a missing target leaves the comparison NULL."""
    return (actual.join(target.select(*on, goal), list(on), "left")
            .withColumn("gap", F.col(value) - F.col(goal))
            .withColumn("attainment_pct", rate(F.col(value), F.col(goal), PERCENT)))


def aging(frame: DataFrame, date: str, as_of: Column, limits: Sequence[int], sums: Mapping[str, Column | str]) -> DataFrame:
    """Rows and sums by age: up to each limit in days, and beyond the last one."""
    age = F.datediff(as_of, F.col(date))
    bucket, low = F.when(F.lit(False), ""), 0
    for limit in limits:
        bucket, low = bucket.when(age <= limit, F.lit(f"{low}-{limit}")), limit + 1
    return (frame.groupBy(bucket.otherwise(F.lit(f"{low}+")).alias("age_days"))
            .agg(F.count("*").alias("row_count"), *[F.sum(v).alias(n) for n, v in sums.items()]))


def heatmap(frame: DataFrame, rows: str, columns: str, value: Column | str) -> DataFrame:
    return frame.groupBy(rows, columns).agg(F.sum(value).alias("value"))


def rank_insights(candidates: DataFrame, keep: int = 5) -> DataFrame:
    """Highest product of the five ranking factors first."""
    # Fixed names of the ranking factors.
    factors = ("impact", "magnitude", "persistence", "population", "confidence")
    score = F.lit(1.0)
    for factor in factors:
        score = score * F.col(factor).cast("double")
    return candidates.withColumn("score", score).orderBy(F.desc_nulls_last("score"), "id").limit(keep)


def insight_factors(values: DataFrame, group: str, period: str, value: str, rows: str) -> DataFrame:
    """The five ranking factors of each group, from one row per group and numbered period.

    Impact is the group's share of all departures of the newest value from the usual one, magnitude that departure
    against the usual value, persistence how long the group has been on this side of it without a gap, population its
    share of the rows, confidence the share of periods in which it was seen. All lie between 0 and 1 but magnitude.
    """
    usual = values.groupBy(group).agg(
        average(value).alias("_usual"), F.max(period).alias("_newest"), F.count("*").alias("_seen"), F.sum(rows).alias("_rows"),
        F.max_by(value, period).cast("double").alias("_last"))
    sided = values.join(usual.select(group, "_usual", "_newest"), group).withColumn(
        "_side", F.signum(F.col(value).cast("double") - F.col("_usual")))
    # Periods that follow each other on one side differ from their rank there by the same number.
    rank = F.row_number().over(Window.partitionBy(group, "_side").orderBy(period))
    islands = sided.withColumn("_island", F.col(period) - rank).groupBy(group, "_side", "_island").agg(
        F.count("*").alias("_run"), F.max(period).alias("_until"), F.max("_newest").alias("_newest"))
    runs = islands.where("_until = _newest").select(group, "_run")
    span = values.agg((F.max(period) - F.min(period) + 1).alias("_periods"))
    facts = with_one_row(usual.join(runs, group), span).withColumn("_off", F.abs(F.col("_last") - F.col("_usual")))
    facts = with_one_row(facts, facts.agg(F.sum("_off").alias("_all_off"), F.sum("_rows").alias("_all_rows")))

    def share(part: str, whole: str) -> Column:
        return F.coalesce(F.col(part).cast("double") / F.nullif(F.col(whole).cast("double"), F.lit(0.0)), F.lit(0.0))

    return facts.select(
        F.col(group).cast("string").alias("id"), share("_off", "_all_off").alias("impact"),
        F.abs(share("_off", "_usual")).alias("magnitude"), share("_run", "_periods").alias("persistence"),
        share("_rows", "_all_rows").alias("population"), share("_seen", "_periods").alias("confidence"))


def partial_latest(periods: DataFrame, period: str, volume: str, share: float) -> DataFrame:
    """Marks the newest period when its volume is below a share of the average of the others."""
    facts = periods.agg(F.max(period).alias("_newest"), F.sum(volume).alias("_all"), F.count("*").alias("_n"),
                        F.max_by(volume, period).alias("_last"))
    usual = (F.col("_all") - F.col("_last")).cast("double") / F.nullif(F.col("_n") - 1, F.lit(0))
    is_partial = (F.col(period) == F.col("_newest")) & (F.col(volume) < usual * share)
    return (with_one_row(periods, facts).withColumn("is_partial", F.coalesce(is_partial, F.lit(False)))
            .select(*periods.columns, "is_partial"))
