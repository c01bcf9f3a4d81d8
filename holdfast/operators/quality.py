"""The quality gate: one aggregate over tagged rows gives every check of a source.

Checks are rows of a small DataFrame. A verdict is the worst status among them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from holdfast.operators.history import in_period
from holdfast.operators.tagging import ACCEPTED, EXACT_DUPLICATE, FILTERED, REJECTED
from holdfast.scale import with_one_row
from holdfast.spec import Source

PASS, WARNING, BLOCK = "PASS", "WARNING", "BLOCK"
CHECK_SCHEMA = ("check_id string, scope string, severity string, status string, message string, "
                "expected string, actual string, difference string, tolerance string, evidence string")
_CHECK_FIELDS = ("check_id", "scope", "severity", "status", "message",
                 "expected", "actual", "difference", "tolerance", "evidence")
_SEVERITY_RANK = {PASS: 0, WARNING: 1, BLOCK: 2}


def _text(value: Column | str) -> Column:
    return F.lit(value) if isinstance(value, str) else value.cast("string")


def check(check_id: str, scope: str, severity: str, status: Column, message: Column | str = "", *,
          expected: Column | str = "", actual: Column | str = "", difference: Column | str = "",
          tolerance: str = "", evidence: Column | str = "") -> Column:
    values = (F.lit(check_id), F.lit(scope), F.lit(severity), status, _text(message), _text(expected),
              _text(actual), _text(difference), F.lit(tolerance), _text(evidence))
    return F.struct(*[v.alias(n) for n, v in zip(_CHECK_FIELDS, values)])


def as_rows(facts: DataFrame, checks: Sequence[Column]) -> DataFrame:
    """One row per check from a one-row frame of facts; a NULL check does not apply."""
    return (facts.select(F.explode(F.array(*checks)).alias("c"))
            .where("c.check_id is not null").select("c.*"))


def only_when(condition: Column, one: Column) -> Column:
    return F.when(condition, one)


def _verdict(count: Column, bad: str) -> Column:
    return F.when(count > 0, F.lit(bad)).otherwise(F.lit(PASS))


def _prefix(source: Source) -> tuple[str, str]:
    return f"source.{source.source_id}.", f"source:{source.source_id}:"


# ---------------------------------------------------------------- facts

def _rows_where(condition: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, 1).otherwise(0)), F.lit(0)).cast("long")


def _sum_of(value: Column) -> Column:
    return F.coalesce(F.sum(value), F.lit(0)).cast("decimal(38,4)")


def raw_facts(rows: DataFrame, source: Source) -> DataFrame:
    """Rows and control totals of the staged extract, taken before anything is tagged."""
    return rows.agg(F.count("*").alias("source_rows"),
                    *[_sum_of(F.col(name)).alias(f"total_{name}") for name in source.control_totals])


def booked_facts(tagged: DataFrame, source: Source) -> DataFrame:
    """Counts and sums of the rows that were accepted, rejected and filtered, in one pass without a shuffle of rows."""
    status = F.col("_status")
    is_clean = (status == ACCEPTED) & ~F.col("_blank_key")
    aggregates = [
        _rows_where(is_clean).alias("accepted_rows"),
        _rows_where(status == REJECTED).alias("rejected_rows"),
        _rows_where(status == FILTERED).alias("filtered_rows"),
    ]
    for name, allowed in source.categories.items():
        if allowed:
            aggregates.append(_rows_where(is_clean & ~F.col(name).isin(*allowed)).alias(f"unexpected_{name}"))
    for name in source.control_totals:
        aggregates += [_sum_of(F.when(c, F.col(name))).alias(f"{kind}_{name}") for kind, c in (
            ("accepted", is_clean), ("rejected", status == REJECTED), ("filtered", status == FILTERED))]
    return tagged.agg(*aggregates)


def source_facts(rows: DataFrame, tagged: DataFrame, source: Source) -> DataFrame:
    """Both sides of the reconciliation in one row; they are computed from different tables, so that a row lost or
    doubled between staging and the tagged rows shows."""
    return with_one_row(raw_facts(rows, source), booked_facts(tagged, source))


def key_facts(rows: DataFrame, repeated: DataFrame) -> DataFrame:
    """Raw rows, blank, repeated and conflicting keys, side by side in one row."""
    blank = rows.agg(F.count("*").alias("raw_rows"),
                     F.coalesce(F.sum(F.col("_blank_key").cast("long")), F.lit(0)).alias("blank_keys"))
    counted = repeated.agg(F.count("*").alias("repeated_keys"),
                           F.coalesce(F.sum((F.col("variants") > 1).cast("long")), F.lit(0)).alias("conflicting_keys"))
    return with_one_row(blank, counted)


# ---------------------------------------------------------------- checks of one source

def required_columns_check(source: Source, present: Sequence[str]) -> Column:
    missing = [name for name in source.required_columns if name not in present]
    cid, scope = _prefix(source)
    return check(f"{cid}structural.required_columns", f"{scope}structure", "block",
                 F.lit(BLOCK if missing else PASS),
                 f"columns not found in the extract: {', '.join(missing)}" if missing else "no required column is absent",
                 expected=", ".join(source.required_columns), actual=", ".join(present))


def key_checks(source: Source) -> list[Column]:
    cid, scope = _prefix(source)
    blank, conflicts = F.col("blank_keys"), F.col("conflicting_keys")
    return [
        check(f"{cid}row.business_key_not_blank", f"{scope}row", "block", _verdict(blank, BLOCK),
              F.concat(blank.cast("string"), F.lit(" rows lack part of their key")), expected="0", actual=blank),
        check(f"{cid}dataset.duplicate_business_key", f"{scope}dataset", "block", _verdict(conflicts, BLOCK),
              F.concat(conflicts.cast("string"), F.lit(" keys have rows that disagree")), expected="0", actual=conflicts),
    ]


def row_checks(source: Source) -> list[Column]:
    """Checks after tagging, over the columns of :func:`source_facts`."""
    cid, scope = _prefix(source)
    rejected, filtered = F.col("rejected_rows"), F.col("filtered_rows")
    checks = [
        only_when(rejected > 0, check(
            f"{cid}row.invalid_or_negative_measure", f"{scope}row", "warning", F.lit(WARNING),
            F.concat(rejected.cast("string"), F.lit(" rows were rejected into quarantine")))),
        only_when(filtered > 0, check(
            f"{cid}row.exact_duplicate", f"{scope}row", "warning", F.lit(WARNING),
            F.concat(filtered.cast("string"), F.lit(" exact copies were filtered into quarantine")))),
    ]
    for name, allowed in source.categories.items():
        if allowed:
            unexpected = F.col(f"unexpected_{name}")
            checks.append(check(
                f"{cid}row.category_allowed.{name}", f"{scope}row", "warning", _verdict(unexpected, WARNING),
                F.concat(unexpected.cast("string"), F.lit(f" rows were loaded with an unlisted {name}")),
                expected=", ".join(allowed), actual=unexpected))
    checks.append(population_check(source))
    checks += [control_total_check(source, name) for name in source.control_totals]
    return checks


def population_check(source: Source) -> Column:
    cid, scope = _prefix(source)
    rows, accepted = F.col("source_rows"), F.col("accepted_rows")
    rejected, filtered = F.col("rejected_rows"), F.col("filtered_rows")
    gap = rows - (accepted + rejected + filtered)
    parts = F.format_string(f"accepted=%d; rejected=%d; filtered=%d; reasons={EXACT_DUPLICATE}=%d",
                            accepted, rejected, filtered, filtered)
    return check(f"{cid}population.equation", f"{scope}dataset", "block",
                 F.when(gap == 0, F.lit(PASS)).otherwise(F.lit(BLOCK)),
                 F.concat(gap.cast("string"), F.lit(" source rows are unaccounted for")),
                 expected=rows, actual=parts, difference=gap, tolerance="0", evidence=parts)


def control_total_check(source: Source, name: str) -> Column:
    cid, scope = _prefix(source)
    total = F.col(f"total_{name}")
    booked = (F.col(f"accepted_{name}") + F.col(f"rejected_{name}") + F.col(f"filtered_{name}")).cast("decimal(38,4)")
    gap = (total - booked).cast("decimal(38,4)")
    return check(f"{cid}control_total.{name}", f"{scope}dataset", "block",
                 F.when(gap == 0, F.lit(PASS)).otherwise(F.lit(BLOCK)),
                 F.concat(F.lit(f"{name} is off by "), gap.cast("string")),
                 expected=total, actual=booked, difference=gap, tolerance="0", evidence=f"control_total:{name}")


def non_negative_checks(tagged: DataFrame, source: Source) -> DataFrame:
    """Negative values per column over all rows of an extract."""
    cid, scope = _prefix(source)
    names = list(source.non_negative)
    facts = tagged.agg(*[F.coalesce(F.sum((F.col(n) < 0).cast("long")), F.lit(0)).alias(n) for n in names])
    return as_rows(facts, [
        check(f"{cid}row.non_negative.{n}", f"{scope}row", "warning", _verdict(F.col(n), WARNING),
              F.concat(F.col(n).cast("string"), F.lit(f" rows have a negative {n}")), expected="0", actual=F.col(n))
        for n in names])


def source_report(rows: DataFrame, repeated: DataFrame, tagged: DataFrame, source: Source,
                  present: Sequence[str]) -> DataFrame:
    """All checks of one source as rows; checks after a blocked key check are left out."""
    facts = with_one_row(key_facts(rows, repeated), source_facts(rows, tagged, source))
    complete = not set(source.required_columns) - set(present)
    passed = (F.col("blank_keys") == 0) & (F.col("conflicting_keys") == 0) & F.lit(complete)
    return as_rows(facts, [required_columns_check(source, present), *key_checks(source),
                           *[only_when(passed, c) for c in row_checks(source)]])


# ---------------------------------------------------------------- periods about to be replaced

def period_counts(stored: DataFrame, clean: DataFrame, source: Source, period: str) -> DataFrame:
    """Active stored and arriving rows of each month of a period: ``month, stored_rows, arriving_rows, complete``.

    A month is complete if it brings the declared share of the rows it replaces.
    """
    month = F.date_format(F.col(source.period_column), "yyyy-MM").alias("month")

    def counted(frame: DataFrame, name: str) -> DataFrame:
        return frame.where(in_period(source.period_column, period)).groupBy(month).agg(F.count("*").alias(name))

    both = counted(stored.where("is_active"), "stored_rows").join(counted(clean, "arriving_rows"), "month", "full_outer")
    rows = both.select("month", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("stored_rows", "arriving_rows")])
    return rows.withColumn("complete", F.col("arriving_rows") >= F.col("stored_rows") * source.least_period_share)


def period_report(counts: DataFrame, source: Source) -> DataFrame:
    """The check that no month is replaced by part of itself."""
    cid, scope = _prefix(source)
    facts = counts.agg(_rows_where(~F.col("complete")).alias("partial"), F.coalesce(F.sum("stored_rows"), F.lit(0)).alias("stored"),
                       F.coalesce(F.sum("arriving_rows"), F.lit(0)).alias("arriving"))
    partial = F.col("partial")
    return as_rows(facts, [check(
        f"{cid}period.complete", f"{scope}dataset", "block", _verdict(partial, BLOCK),
        F.concat(partial.cast("string"), F.lit(" months would be replaced by a part of what is stored")),
        expected=F.col("stored"), actual=F.col("arriving"), difference=F.col("stored") - F.col("arriving"),
        tolerance=str(source.least_period_share))])


# ---------------------------------------------------------------- verdicts and reconciliation

def verdict(checks: DataFrame) -> DataFrame:
    """Worst status and the number of checks by status, in one row."""
    rank = F.create_map(*[F.lit(p) for pair in _SEVERITY_RANK.items() for p in pair])
    worst = F.coalesce(F.max(rank[F.col("status")]), F.lit(0))

    def number(status: str) -> Column:
        return F.coalesce(F.sum((F.col("status") == status).cast("long")), F.lit(0))

    return checks.agg(
        F.element_at(F.array(F.lit(PASS), F.lit(WARNING), F.lit(BLOCK)), worst + 1).alias("quality_status"),
        number(PASS).alias("passed"), number(WARNING).alias("warnings"), number(BLOCK).alias("blocked"))


def population(rows: DataFrame, tagged: DataFrame, source: Source) -> DataFrame:
    """Staged rows against accepted, rejected and filtered ones."""
    facts = source_facts(rows, tagged, source)
    gap = F.col("source_rows") - F.col("accepted_rows") - F.col("rejected_rows") - F.col("filtered_rows")
    return facts.select("source_rows", "accepted_rows", "rejected_rows", "filtered_rows",
                        gap.alias("difference"), (gap == 0).alias("balances"))


def control_totals(rows: DataFrame, tagged: DataFrame, source: Source) -> DataFrame:
    """Source total against accepted + rejected + filtered, per declared column, exactly."""
    def line(name: str) -> Column:
        booked = F.col(f"accepted_{name}") + F.col(f"rejected_{name}") + F.col(f"filtered_{name}")
        return F.struct(
            F.lit(f"{source.source_id}.{name}").alias("name"),
            F.col(f"total_{name}").cast("decimal(38,4)").alias("source_value"),
            booked.cast("decimal(38,4)").alias("database_value"),
            (F.col(f"total_{name}") - booked).cast("decimal(38,4)").alias("difference"))

    lines = [line(name) for name in source.control_totals]
    if not lines:
        empty = "name string, source_value decimal(38,4), database_value decimal(38,4), difference decimal(38,4)"
        return tagged.sparkSession.createDataFrame([], empty)
    return source_facts(rows, tagged, source).select(F.inline(F.array(*lines)))


def row_count_movement(ledger: DataFrame, max_change_pct: float) -> DataFrame:
    """Extracted rows of each run against the run before it in the same report.

    The ledger holds one row per run, so a report's runs are few.
    """
    runs = Window.partitionBy("report_id").orderBy("finished_at", "run_id")
    previous = F.lag("rows_extracted").over(runs)
    change = F.abs(F.col("rows_extracted") - F.col("previous_rows")).cast("double") / F.col("previous_rows") * 100
    usable = F.col("previous_rows").isNotNull() & (F.col("previous_rows") != 0)
    return (ledger.withColumn("previous_rows", previous)
            .withColumn("change_pct", F.when(usable, change))
            .select("report_id", "run_id", "rows_extracted", "previous_rows", "change_pct",
                    F.when(F.col("change_pct") > max_change_pct, F.lit(WARNING)).otherwise(F.lit(PASS)).alias("status")))


def checks_frame(spark: SparkSession, rows: Sequence[tuple]) -> DataFrame:
    return spark.createDataFrame(list(rows), CHECK_SCHEMA)
