"""Golden runs of the four ready projects with hand-derived figures."""

from __future__ import annotations

from decimal import Decimal

import pytest

from holdfast.plans import packs as P
from holdfast.plans.package import run_query, scalar
from holdfast.plans.run import QUARANTINE_SCHEMA, run_project
from holdfast.sources.store import Store

PRODUCTION = "production_date,line,order_number,model_code,produced_qty,defect_qty,category"
WEEK_1 = (
    "2027-03-01,NORTH,W-71,TK4,400,6,standard",
    "2027-03-01,SOUTH,W-72,TK9,250,10,standard",
    "2027-03-02,NORTH,W-73,TK4,350,2,rework",
    "2027-03-02,SOUTH,W-74,BX1,500,5,standard",
)
# A negative amount, two new rows, a corrected one, a copy and a category that is not listed.
WEEK_2 = (
    "2027-03-03,SOUTH,W-77,TK9,-5,0,standard",
    "2027-03-03,NORTH,W-75,BX1,200,4,standard",
    "2027-03-03,SOUTH,W-76,TK9,300,9,standard",
    "2027-03-01,SOUTH,W-72,TK9,260,10,standard",
    "2027-03-03,SOUTH,W-76,TK9,300,9,standard",
    "2027-03-03,WEST,W-78,ZZ0,100,1,sample",
)


class Runs:
    """One project, its store and its dashboard, run over files."""

    def __init__(self, spark, project, dashboard, root):
        self.spark, self.project, self.dashboard = spark, project, dashboard
        self.store = Store(spark, str(root), project, buckets=4)

    def run(self, run_id, inputs, **options):
        return run_project(self.spark, self.project, inputs, run_id, self.store, dashboard=self.dashboard, **options)

    def views(self):
        return {self.project.view_name(s.source_id): self.store.history(s) for s in self.project.sources}

    def value(self, name):
        return scalar(run_query(self.spark, self.dashboard.queries, name, self.views()))

    def rows(self, name):
        return [tuple(r) for r in run_query(self.spark, self.dashboard.queries, name, self.views()).collect()]


@pytest.fixture
def production(spark, tmp_path):
    return Runs(spark, P.PRODUCTION_QUALITY, P.PRODUCTION_QUALITY_DASHBOARD, tmp_path / "store")


def test_production_week_after_week(production, write_csv):
    first = production.run("R1", {"production": write_csv("w1.csv", PRODUCTION, *WEEK_1)})
    assert (first.status, first.quality_status) == ("COMPLETE", "PASS")
    assert first.sources["production"].inserted == 4
    assert (production.value("produced_total"), production.value("defect_total")) == (1500, 23)

    second_file = write_csv("w2.csv", PRODUCTION, *WEEK_2)
    second = production.run("R2", {"production": second_file})
    got = second.sources["production"]
    assert second.quality_status == "WARNING"
    assert (got.rows_extracted, got.rows_rejected, got.rows_filtered) == (6, 1, 1)
    assert (got.inserted, got.updated, got.unchanged) == (3, 1, 0)
    assert (production.value("produced_total"), production.value("defect_total")) == (2110, 37)
    assert production.value("active_row_count") == 7
    assert production.value("defect_rate_ppm") == pytest.approx(37 / 2110 * 1e6)
    assert [(str(d), p) for d, p, *_ in production.rows("trend_by_date")] == [
        ("2027-03-01", 660), ("2027-03-02", 850), ("2027-03-03", 600)]
    pareto = production.rows("pareto_by_model")
    assert [(m, int(v)) for m, v, _ in pareto] == [("TK9", 19), ("BX1", 9), ("TK4", 8), ("ZZ0", 1)]
    assert [p for *_, p in pareto] == pytest.approx([1900 / 37, 2800 / 37, 3600 / 37, 100])
    top = production.rows("top_contributor_evidence")
    assert top[0][:2] == ("TK9", 19) and top[0][2] == pytest.approx(1900 / 37) and len(top) == 3

    reasons = {r.reason_code: r.source_row for r in production.store.ledger("quarantine", QUARANTINE_SCHEMA).collect()}
    assert reasons == {"NEGATIVE_MEASURE": 2, "EXACT_DUPLICATE": 6}
    drill = P.lineage_for_model(production.views(), "TK9").collect()
    assert [(r.order_number, r.produced_qty) for r in drill] == [("W-72", 260), ("W-76", 300)]
    assert {r._source_row_number for r in drill} == {4, 5} and all(r._source_file.endswith("w2.csv") for r in drill)

    package = second.package
    assert [k["id"] for k in package["kpis"]] == ["produced_total", "defect_total", "defect_rate_ppm"]
    assert [k["display"] for k in package["kpis"]] == ["2,110", "37", "17,536"]
    assert package["report"]["period"] == "2027-03-03" and package["lineage"]["rows"] == 7
    assert "TK9" in package["insights"][1]["text"] and "19 defects (51.4%" in package["insights"][1]["text"]
    assert "from 8235.29 PPM to 23333.33 PPM" in package["insights"][0]["text"]
    assert {f["id"] for f in package["filters"]["definitions"]} == {"model_code", "line"}

    again = production.run("R3", {"production": second_file}).sources["production"]
    assert (again.inserted, again.updated, again.unchanged) == (0, 0, 4)
    assert production.value("produced_total") == 2110


def test_missing_required_column_blocks_and_keeps_history(production, write_csv):
    production.run("R1", {"production": write_csv("w1.csv", PRODUCTION, *WEEK_1)})
    bad = write_csv("w3.csv", PRODUCTION.replace("produced_qty", "pieces"), "2027-03-04,NORTH,W-79,TK4,70,0,standard")
    blocked = production.run("R2", {"production": bad})
    assert (blocked.status, blocked.quality_status) == ("FAILED", "BLOCK")
    assert production.value("produced_total") == 1500 and production.value("active_row_count") == 4


def test_missing_source_fails_before_any_work(production):
    outcome = production.run("R1", {})
    assert (outcome.status, outcome.quality_status) == ("FAILED", "BLOCK")


def test_downtime_with_a_correction(spark, tmp_path, write_csv):
    header = "event_date,line,event_id,machine,reason,downtime_minutes,planned_flag"
    runs = Runs(spark, P.MAINTENANCE_DOWNTIME, P.MAINTENANCE_DOWNTIME_DASHBOARD, tmp_path / "store")
    runs.run("R1", {"downtime": write_csv(
        "d1.csv", header, "2027-04-05,A,K11,P1,Material,25,false", "2027-04-05,B,K12,P2,Breakdown,75,true",
        "2027-04-06,A,K13,P1,Other,10,false")})
    second = runs.run("R2", {"downtime": write_csv(
        "d2.csv", header, "2027-04-06,B,K14,P3,Breakdown,55,false", "2027-04-06,A,K13,P1,Other,35,false",
        "2027-04-07,B,K15,P2,Power,-3,true", "2027-04-07,C,K16,P4,Power,20,false", "2027-04-07,C,K16,P4,Power,20,false")})
    got = second.sources["downtime"]
    assert (second.status, second.quality_status) == ("COMPLETE", "WARNING")
    assert (got.inserted, got.updated, got.rows_rejected, got.rows_filtered) == (2, 1, 1, 1)
    assert runs.value("total_downtime_minutes") == Decimal("210.0000") and runs.value("active_row_count") == 5
    assert runs.value("average_event_minutes") == pytest.approx(42)
    assert [k["display"] for k in second.package["kpis"]] == ["210", "5", "42.00"]
    assert [c["id"] for c in second.package["charts"]] == ["downtime_trend", "line_pareto"]
    assert second.package["report"]["period"] == "2027-04-07"
    assert "from 90.0000 minutes to 20.0000 minutes" in second.package["insights"][0]["text"]
    assert second.package["insights"][1]["text"].startswith("B ")
    assert all(a - b == 0 for _, a, b in got.control_totals)


ORDERS = "order_id,order_line,order_date,item_id,warehouse_id,ordered_qty,fulfilled_qty"
STOCK = "snapshot_date,warehouse_id,item_id,on_hand_qty"
ITEMS = "item_id,item_name,category,lead_time_days,master_updated_at"


@pytest.fixture
def supply(spark, tmp_path, write_csv):
    runs = Runs(spark, P.SUPPLY_CHAIN, P.SUPPLY_CHAIN_DASHBOARD, tmp_path / "store")
    kept = ("S-1,2,2027-05-03,NUT,EAST,20,20", "S-2,1,2027-05-04,BOLT,WEST,15,15")
    runs.before = {
        "orders": write_csv("orders_1.csv", ORDERS, "S-1,1,2027-05-03,BOLT,EAST,60,45", *kept),
        "inventory": write_csv("inventory_1.csv", STOCK, "2027-05-03,EAST,BOLT,12", "2027-05-03,EAST,NUT,33",
                               "2027-05-03,WEST,BOLT,4"),
        "item_master": write_csv("items_1.csv", ITEMS, "BOLT,Hex bolt,Fixings,4,2027-04-01", "NUT,Wing nut,Fixings,2,2027-04-01"),
    }
    runs.after = {
        "orders": write_csv("orders_2.csv", ORDERS, "S-3,1,2027-05-06,CLIP,WEST,30,7", "S-3,1,2027-05-06,CLIP,WEST,30,7",
                            "S-4,1,2027-05-06,NUT,EAST,8,-2", "S-1,1,2027-05-03,BOLT,EAST,60,52", *kept),
        "inventory": write_csv("inventory_2.csv", STOCK, "2027-05-06,EAST,BOLT,9", "2027-05-06,EAST,NUT,41",
                               "2027-05-06,WEST,CLIP,3"),
        "item_master": write_csv("items_2.csv", ITEMS, "BOLT,Hex bolt,Fixings,5,2027-05-02", "NUT,Wing nut,Fixings,2,2027-04-01",
                                 "CLIP,Spring clip,Fixings,9,2027-05-01"),
    }
    return runs


def test_supply_chain_and_rerun(supply):
    first = supply.run("R1", supply.before)
    assert (first.status, first.quality_status) == ("COMPLETE", "PASS")
    assert (supply.value("ordered_qty"), supply.value("fulfilled_qty")) == (95, 80)
    second = supply.run("R2", supply.after)
    got = second.sources["orders"]
    assert second.quality_status == "WARNING"
    assert (got.inserted, got.updated, got.unchanged, got.rows_rejected, got.rows_filtered) == (1, 1, 2, 1, 1)
    assert (supply.value("ordered_qty"), supply.value("fulfilled_qty")) == (125, 94)
    assert supply.value("on_hand_qty") == 53
    assert supply.store.history(supply.project.source("inventory")).count() == 6
    assert supply.value("fulfillment_rate") == pytest.approx(75.2)
    assert supply.rows("shortage_by_item")[0] == ("Spring clip", Decimal("20.0000"))
    assert [(w, int(q)) for w, q in supply.rows("inventory_by_warehouse")] == [("EAST", 50), ("WEST", 3)]
    rerun = supply.run("R3", supply.after)
    assert [(s.inserted, s.updated, s.unchanged) for s in rerun.sources.values()] == [(0, 0, 4), (0, 0, 3), (0, 0, 3)]


def test_orphan_blocks_every_source(supply, write_csv):
    supply.run("R1", supply.before)
    orphan = write_csv("orders_orphan.csv", ORDERS, "S-2,1,2027-05-04,BOLT,WEST,15,15", "S-9,1,2027-05-07,GEAR,EAST,3,0")
    blocked = supply.run("R2", {**supply.after, "orders": orphan})
    assert (blocked.status, blocked.quality_status) == ("FAILED", "BLOCK")
    assert supply.value("ordered_qty") == 95
    assert supply.store.history(supply.project.source("inventory")).count() == 3


PURCHASES = "po_number,po_line,posting_date,period,item_id,vendor_id,quantity,actual_unit_price,line_amount"
COSTS = "item_id,item_name,category,standard_unit_cost,cost_effective_date"
VENDORS = "vendor_id,vendor_name,vendor_country,vendor_updated_at"
BUDGET = "period,ppv_budget_amount,budget_effective_date"
FEBRUARY = {"ppv_budget": "2027-02"}


@pytest.fixture
def finance(spark, tmp_path, write_csv):
    runs = Runs(spark, P.PRICE_VARIANCE, P.PRICE_VARIANCE_DASHBOARD, tmp_path / "store")
    costs = ("CU,Copper wire,Metals,4.00,2027-01-01", "PV,Pipe,Plastics,2.50,2027-01-01")
    vendors = ("N1,Nordlicht,SE,2027-01-10", "O2,Orange Trade,ES,2027-01-11")
    kept = ("B7,2,2027-02-02,2027-02,PV,N1,40,2.25,90.00", "B8,1,2027-02-09,2027-02,CU,O2,50,3.40,170.00")
    runs.before = {
        "purchases": write_csv("purchases_1.csv", PURCHASES, "B7,1,2027-02-02,2027-02,CU,N1,30,4.50,135.00", *kept),
        "standard_cost": write_csv("costs_1.csv", COSTS, *costs),
        "vendors": write_csv("vendors_1.csv", VENDORS, *vendors),
        "ppv_budget": write_csv("budget_1.csv", BUDGET, "2027-02,-12.00,2027-02-01"),
    }
    runs.after = {
        "purchases": write_csv("purchases_2.csv", PURCHASES, "B7,1,2027-02-02,2027-02,CU,N1,30,4.60,138.00", *kept,
                               "C1,1,2027-03-04,2027-03,LN,Q3,16,8.00,128.00"),
        "standard_cost": write_csv("costs_2.csv", COSTS, *costs, "LN,Linen,Textiles,7.00,2027-03-01"),
        "vendors": write_csv("vendors_2.csv", VENDORS, *vendors, "Q3,Quartz,PL,2027-03-01"),
    }
    return runs


def test_price_variance_month_after_month(finance):
    first = finance.run("R1", finance.before, periods=FEBRUARY)
    assert (first.status, first.quality_status) == ("COMPLETE", "PASS")
    assert [finance.value(n) for n in ("ppv_amount", "purchase_spend", "standard_spend", "ppv_budget_amount")] == [
        -25, 395, 420, -12]
    assert finance.value("ppv_rate") == pytest.approx(-2500 / 420)
    assert [(v, float(a)) for v, a in finance.rows("ppv_by_vendor")] == [("Nordlicht", 5), ("Orange Trade", -30)]
    assert [(c, float(a)) for c, a in finance.rows("ppv_by_category")] == [("Plastics", -10), ("Metals", -15)]
    second = finance.run("R2", finance.after)
    got = second.sources["purchases"]
    assert (second.status, second.quality_status) == ("COMPLETE", "WARNING")
    assert (got.inserted, got.updated, got.unchanged) == (1, 1, 2)
    assert [finance.value(n) for n in ("ppv_amount", "purchase_spend", "standard_spend")] == [-6, 526, 532]
    assert finance.value("ppv_rate") == pytest.approx(-600 / 532)
    assert "Quartz" in second.package["insights"][0]["text"] and "16 USD variance (29.6%" in second.package["insights"][0]["text"]
    assert finance.value("ppv_budget_amount") == -12


def test_budget_restatement_replaces_its_period(finance, write_csv):
    finance.run("R1", finance.before, periods=FEBRUARY)
    restated = write_csv("budget_2.csv", BUDGET, "2027-02,-20.00,2027-02-20")
    finance.run("R2", {**finance.before, "ppv_budget": restated}, periods=FEBRUARY)
    assert finance.value("ppv_budget_amount") == -20
    assert finance.store.history(finance.project.source("ppv_budget")).count() == 1


def test_unreadable_values_are_quarantined_and_blank_ones_are_not(finance, write_csv):
    inputs = {
        **finance.before,
        "purchases": write_csv("purchases_bad.csv", PURCHASES, "X1,1,soon,2027-02,CU,N1,3,4.00,12.00",
                               "X2,one,2027-02-03,2027-02,CU,N1,2,4.00,8.00", "X3,1,2027-02-04,2027-02,PV,N1,6,2.50,15.00"),
        "standard_cost": write_csv("costs_blank.csv", COSTS, "CU,Copper wire,Metals,4.00,", "PV,Pipe,Plastics,2.50,2027-01-01"),
    }
    outcome = finance.run("R1", inputs, periods=FEBRUARY)
    assert outcome.succeeded
    reasons = sorted(r.reason_code for r in finance.store.ledger("quarantine", QUARANTINE_SCHEMA).collect())
    assert reasons == ["UNPARSEABLE_DATE", "UNPARSEABLE_NUMBER"]
    assert outcome.sources["purchases"].rows_rejected == 2 and outcome.sources["standard_cost"].rows_rejected == 0
    assert finance.value("purchase_spend") == 15
    assert finance.store.history(finance.project.source("purchases")).where("posting_date is null").count() == 0


def test_vanished_row_returns_active_with_its_first_run(finance, write_csv):
    whole = ("V1,1,2027-02-02,2027-02,CU,N1,3,4.00,12.00", "V2,1,2027-02-05,2027-02,PV,N1,4,2.50,10.00")
    inputs = {k: v for k, v in finance.before.items() if k != "ppv_budget"}
    complete = {**inputs, "purchases": write_csv("purchases_a.csv", PURCHASES, *whole)}
    partial = {**inputs, "purchases": write_csv("purchases_b.csv", PURCHASES, whole[0])}

    def activity():
        rows = finance.store.history(finance.project.source("purchases")).collect()
        return {r.po_number: (r.is_active, r.first_seen_run_id, r.last_seen_run_id) for r in rows}

    finance.run("R1", complete)
    assert finance.run("R2", partial).sources["purchases"].deactivated == 1
    assert activity()["V2"] == (False, "R1", "R1")
    finance.run("R3", complete)
    assert activity() == {"V1": (True, "R1", "R3"), "V2": (True, "R1", "R3")}
    assert finance.value("purchase_spend") == 22
