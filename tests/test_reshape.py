"""Reshaping, drift, copies and quoted CSV values."""

from __future__ import annotations

import random
from dataclasses import replace
from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from holdfast.operators.drift import category_drift, dataset_drift, schema_drift
from holdfast.operators.reshape import fill_down, version_rows, weeks_to_rows
from holdfast.plans import metrics as M
from holdfast.sources import archive as A
from holdfast.sources.staging import stage_files
from holdfast.spec import Source

NOTES = Source("notes", {"id": "VARCHAR", "day": "DATE", "text": "VARCHAR"}, key=("id",), load_mode="append",
               event_date="day", required_columns=("id",), categories={"text": ("a",)})


def test_fill_down_over_many_segments(spark):
    pick = random.Random(5)
    rows = [("f1" if i < 400 else "f2", i, pick.choice(["x", "y", None, None, None]) if i % 90 < 5 else None) for i in range(500)]
    expected, above = {}, {}
    for file, i, value in rows:
        above[file] = value if value is not None else above.get(file)
        expected[i] = above[file]
    frame = spark.createDataFrame(rows, "_source_file string, _row_order long, v string").repartition(5)
    for size in (7, 100, 10_000):
        got = fill_down(frame, ["v"], segment_rows=size)
        assert got.columns == frame.columns and {r._row_order: r.v for r in got.collect()} == expected


def test_weeks_become_rows_and_malformed_groups_are_marked(spark):
    sheet = spark.createDataFrame(
        [("A", "Qty", 100, 0, "n"), ("A", "Def", 2, 1, "n"), ("A", "PPM", 20000, None, "n"),
         ("B", "Qty", 10, 10, "n"), ("B", "Qty", 10, 10, "n"), ("B", "PPM", 0, 0, "n")],
        "code string, kind string, w1 int, w2 int, remark string").toDF("code", "kind", "2026-W01", "2026-W02", "remark")
    rows = {(r.code, r.week): r for r in weeks_to_rows(
        sheet, ["code"], "kind", {"quantity": "Qty", "defects": "Def", "reported": "PPM"}, 0.5, M.PPM).collect()}
    assert set(rows) == {(c, w) for c in "AB" for w in ("2026-W01", "2026-W02")}
    first = rows["A", "2026-W01"]
    assert (first.calculated, first.agrees, first.well_formed) == (20000.0, True, True)
    assert rows["A", "2026-W02"].calculated is None and not rows["B", "2026-W01"].well_formed


def test_versions_close_and_open(spark):
    def batch(*rows):
        return spark.createDataFrame([(k, v, k, f"{k}{v}") for k, v in rows],
                                     "k string, v int, business_key_hash string, row_content_hash string")

    first = version_rows(None, batch(("a", 1), ("b", 1)), ["k", "v"], "2026-01-01")
    second = version_rows(first, batch(("a", 2), ("c", 1)), ["k", "v"], "2026-02-01")
    third = version_rows(second, batch(("a", 3), ("c", 1)), ["k", "v"], "2026-03-01")
    got = sorted((r.k, r.v, r.valid_from.month, r.valid_to and r.valid_to.month, r.is_current) for r in third.collect())
    assert got == [("a", 1, 1, 2, False), ("a", 2, 2, 3, False), ("a", 3, 3, None, True), ("b", 1, 1, None, True),
                   ("c", 1, 2, None, True)]


def test_schema_drift(spark):
    present = T.StructType([T.StructField("day", T.StringType()), T.StructField("id", T.DoubleType()),
                            T.StructField("extra", T.StringType())])
    found = {r.column_name: (r.change, r.status) for r in schema_drift(spark, NOTES, ["id", "day", "text"], present).collect()}
    assert found == {"day": ("moved", "PASS"), "id": ("type changed", "BLOCK"), "extra": ("new", "WARNING"),
                     "text": ("missing", "WARNING")}
    gone = schema_drift(spark, NOTES, [], T.StructType([T.StructField("day", T.StringType())]))
    assert {r.column_name: r.status for r in gone.collect()}["id"] == "BLOCK"


def test_category_drift_names_new_and_lost(spark):
    """NULL is a category of its own; an empty extract has lost all."""
    source = replace(NOTES, categories={"text": ("a", "b")})
    before, after = (spark.createDataFrame([(t,) for t in texts], "text string") for texts in (["a", "a", "b"], ["a", None, "c", "c"]))
    found = {tuple(r) for r in category_drift(after, before, source).collect()}
    assert found == {("text", "a", 2, 1, "same", "PASS"), ("text", "b", 1, 0, "lost", "WARNING"),
                     ("text", "c", 0, 2, "new", "WARNING"), ("text", None, 0, 1, "new", "WARNING")}
    assert {r.change for r in category_drift(after.limit(0), before, source).collect()} == {"lost"}


def test_dataset_drift_warns_past_its_limits(spark):
    schema = "id string, day date, text string"
    before = spark.createDataFrame([(str(i), date(2026, 1, 1 + i), "a") for i in range(10)], schema)
    after = spark.createDataFrame([(str(i), date(2026, 1, 1 + i), None if i < 3 else "b") for i in range(6)], schema)
    limits = {"row_count_pct": 40, "null_rate": 0.2, "category_count": 0}
    got = {r.measure: r.status for r in dataset_drift(after, before, NOTES, limits, "2026-02").collect()}
    assert got == {"row_count": "PASS", "first_date": "PASS", "last_date": "WARNING", "null_rate.id": "PASS",
                   "null_rate.day": "PASS", "null_rate.text": "WARNING", "category_count.text": "PASS"}


def test_copy_is_marked_only_when_it_agrees(spark, tmp_path, monkeypatch):
    frame = spark.createDataFrame([(1, Decimal("1.50")), (2, Decimal("2.25"))], "k int, v decimal(18,2)")
    path = str(tmp_path / "copy")
    assert A.reconciled_copy(frame, path, ["v"]).count() == 2 and (tmp_path / "copy" / "_COMPLETE").read_text() == "2"
    unstable = frame.withColumn("v", F.monotonically_increasing_id() + F.unix_micros(F.expr("reflect('java.time.Instant', 'now')").cast("timestamp")))
    with pytest.raises(A.CopyMismatch):
        A.reconciled_copy(unstable, str(tmp_path / "bad"), ["v"])
    assert not (tmp_path / "bad" / "_COMPLETE").exists()


def test_quoted_values(spark, tmp_path):
    (tmp_path / "notes.csv").write_text('id,day,text\n1,2026-01-01,"say ""hi"", twice"\n2,,"two\nlines"\n3,2026-01-03,end\n')
    rows = stage_files(spark, NOTES, [str(tmp_path / "notes.csv")], run_id="R", report_id="p", multiline=True).rows.collect()
    assert [(r.id, r.day, r.text, r._source_row_number) for r in sorted(rows, key=lambda r: r._row_order)] == [
        ("1", "2026-01-01", 'say "hi", twice', 2), ("2", None, "two\nlines", 3), ("3", "2026-01-03", "end", 4)]


def test_price_variance_is_exact_for_large_quantities(spark):
    buys = spark.createDataFrame([("a", "v", 10, 3), ("a", "w", 5, 2), ("b", "v", 7, 9), ("zz", "v", 1, 1)]
                                 + [("c", "u", 90_000_000_000_000, 1)] * 40, "item string, vendor string, q long, p int")
    prices = spark.createDataFrame([("a", 2, "x"), ("b", 10, "y"), ("c", 3, "x")], "item string, s int, kind string")
    got = M.price_variance(
        buys, prices, item="item", quantity=F.col("q").cast("decimal(18,4)"),
        spend=(F.col("q") * F.col("p")).cast("decimal(22,4)"), standard_price=F.col("s").cast("decimal(18,4)"),
        by_purchase=["vendor"], by_item=["kind"]).select("vendor", "kind", F.col("variance").cast("decimal(38,0)"))
    assert sorted(tuple(r) for r in got.collect()) == [
        ("u", "x", -2 * 40 * 90_000_000_000_000), ("v", "x", 10), ("v", "y", -7), ("w", "x", 0)]


def test_rolling_and_growth_count_missing_periods(spark):
    weeks = spark.createDataFrame([(0, 5), (1, 7), (8, 11), (9, 13)], "week int, v int")
    rolled = M.rolling(weeks, F.col("week"), ["v"], 4).orderBy("week").collect()
    assert [r.rolling_v for r in rolled] == [5, 12, 11, 24]
    assert [r.change for r in M.growth(weeks, F.col("week"), "v").orderBy("week").collect()] == [None, 2, None, 2]


def test_related_rows_without_a_key(spark):
    left = spark.createDataFrame([(1, "a"), (2, None), (3, "z"), (4, None)], "id int, k string")
    right = spark.createDataFrame([("a", "x"), (None, "n"), ("q", "y")], "k string, label string")

    def rows(how):
        return sorted((tuple(r) for r in M.related(left, right, [("k", "k")], how, ["label"]).collect()), key=repr)

    assert rows("inner") == [(1, "a", "x")]
    assert rows("left") == sorted([(1, "a", "x"), (2, None, None), (3, "z", None), (4, None, None)], key=repr)
    assert rows("full") == sorted([*rows("left"), (None, None, "n"), (None, None, "y")], key=repr)
