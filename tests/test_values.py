"""Reading text: typed values, hand-written numbers, serial dates and headers."""

from __future__ import annotations

import hashlib
from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from holdfast.functions import cleaning as C
from holdfast.functions.display import display_text, fixed, readable
from holdfast.functions.headers import MissingColumns, project_by_name, tidy_header, tidy_name
from holdfast.functions.values import fingerprint, is_true_text, read_as


def evaluate(spark, values, expression):
    rows = list(enumerate(values))
    frame = spark.createDataFrame(rows, "i int, v string")
    return [r[0] for r in frame.orderBy("i").select(expression(F.col("v"))).collect()]


@pytest.mark.parametrize(("kind", "cases"), [
    ("DATE", {"2026-08-01": date(2026, 8, 1), "2026-8-1": date(2026, 8, 1), "2026/08/01": date(2026, 8, 1),
              "2026-08-01 10:00:00": date(2026, 8, 1), " 2026-08-01 ": date(2026, 8, 1), "2026": None, "2026-08": None,
              "2026-13-01": None, "2026-08-0x": None, "2026-08-01 25:00:00": None, "2026/8-1": None, "1999-2-30": None,
              "": None, None: None}),
    ("INTEGER", {"12": 12, " 12 ": 12, "+5": 5, "12.0": 12, "12.5": 13, "-12.5": -13, "1e3": 1000, ".5": 1,
                 "2147483648": None, "x": None, "": None, None: None}),
    ("BIGINT", {"2147483648": 2147483648, "99999999999999999999": None}),
    ("BOOLEAN", {"true": True, "T": True, "Yes": True, "1": True, "n": False, "0": False, "FALSE": False,
                 "maybe": None, " true ": None, "2": None}),
    ("DECIMAL(18,4)", {"1.23456": Decimal("1.2346"), "1e3": Decimal("1000.0000"), ".5": Decimal("0.5000"),
                       "1,234": None, "n/a": None, "100000000000000": None}),
    ("VARCHAR", {" 007 ": "007", "": "", None: None}),
])
def test_read_as(spark, kind, cases):
    assert evaluate(spark, list(cases), lambda v: read_as(v, kind)) == list(cases.values())


def test_flag_text(spark):
    assert evaluate(spark, ["true", " YES ", "1", "y", "no", ""], is_true_text) == [True, True, True, True, False, False]


def test_fingerprint_is_md5_of_joined_values(spark):
    frame = spark.createDataFrame([("a", None, Decimal("1.5"))], "x string, y string, z decimal(18,4)")
    got = frame.select(fingerprint([F.col("x"), F.col("y"), F.col("z")])).first()[0]
    assert got == hashlib.md5("a\x1f\x00\x1f1.5000".encode()).hexdigest()


def numbers(spark, values, separator="."):
    frame = spark.createDataFrame(list(enumerate(values)), "i int, v string")
    rows = C.clean_numbers(frame, "v", separator).orderBy("i").collect()
    return [(None if r.v_number is None else r.v_number.normalize(), r.v_outcome) for r in rows]


def test_hand_written_numbers(spark):
    cases = {
        "1234.56": "1234.56", "1,234,567.89": "1234567.89", "(1,234.50)": "-1234.5", "1234-": "-1234", "1.234,56": "1234.56",
        "1,234": "1234", "١٢٣": "123", "۴۵۶": "456", " 12 345 ": "12345", "0.1": "0.1", "-5": "-5", "(-5)": "5",
        "1e3": "1000", ".5": "0.5", "5.": "5", "0": "0",
        "1,5": None, "1,23": None, "1,23456": None, "1,23,456": None, "1.2.3": None, "n/a": None, "-": None, ".": None,
        "abc": None, "1,2.3,4": None,
    }
    expected = [(None if v is None else Decimal(v).normalize(), "failed" if v is None else "number") for v in cases.values()]
    assert numbers(spark, list(cases)) == expected
    assert numbers(spark, [None, "", "  ", "\t\n", "#N/A", " #div/0! ", "#NULL!"]) == (
        [(None, "blank")] * 4 + [(None, "error")] * 3)


def test_comma_locale(spark):
    got = [n for n, _ in numbers(spark, ["1,5", "1,234", "1.234,56", "1.234", "1.5"], ",")]
    assert got == [Decimal("1.5"), Decimal("1.234"), Decimal("1234.56"), Decimal("1234"), None]


def test_conversion_counts(spark):
    frame = spark.createDataFrame([("1",), ("x",), ("#N/A",), (None,), ("2",)], "v string")
    counts = C.outcome_counts(C.clean_numbers(frame, "v"), "v").collect()
    assert {r.outcome: r.cells for r in counts} == {"number": 2, "failed": 1, "error": 1, "blank": 1}


def test_serial_dates(spark):
    frame = spark.createDataFrame([(float(s),) for s in (1, 59, 60, 61, 25569, 44197, 45292)], "s double")
    got = [tuple(r) for r in frame.select(C.serial_to_date(F.col("s")), C.serial_to_date(F.col("s"), True)).collect()]
    assert [g[0] for g in got] == [date(1900, 1, 1), date(1900, 2, 28), date(1900, 2, 28), date(1900, 3, 1),
                                   date(1970, 1, 1), date(2021, 1, 1), date(2024, 1, 1)]
    assert got[0][1] == date(1904, 1, 2)


def test_headers():
    assert tidy_header(["Lot / Batch", "Weight", "Lot / Batch", "Lot / Batch"]) == [
        "lot_batch", "weight", "lot_batch_2", "lot_batch_3"]
    assert tidy_header(["Depot", "", "Shift"]) == ["depot", "col_1", "shift"]
    assert [tidy_name(n, 7) for n in (" Net Weight [kg]  ", "Scrap#Share", "__Shift__", "1st Check", "??")] == [
        "net_weight_kg", "scrap_share", "shift", "c_1st_check", "col_7"]


def test_projection_by_name(spark):
    frame = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int").toDF(" Qty ", "LINE", "qty")
    assert [tuple(r) for r in project_by_name(frame, ["line", "qty"]).collect()] == [(2, 1)]
    with pytest.raises(MissingColumns, match="model"):
        project_by_name(frame, ["model", "qty"])


def test_display(spark):
    frame = spark.createDataFrame([(Decimal("1234567.1250"),), (Decimal("2.5000"),), (None,)], "v decimal(18,4)")
    got = [tuple(r) for r in frame.select(*[display_text(F.col("v"), s) for s in ("decimal", "percent", "integer", "")],
                                          readable(F.col("v")), fixed(F.col("v"), 1)).collect()]
    assert got[0] == ("1,234,567.12", "1,234,567.1%", "1,234,567", "1234567.1250", "1,234,567.125", "1234567.1")
    assert got[1] == ("2.50", "2.5%", "2", "2.5000", "2.5", "2.5")
    assert got[2] == ("—", "—", "—", "—", "—", None)
