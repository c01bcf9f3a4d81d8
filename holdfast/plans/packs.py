"""Four ready projects: production quality, downtime, supply chain and price variance.

Each is configuration: sources, relationships, named queries built from
:mod:`holdfast.plans.metrics`, and the dashboard that shows them.

Fixed values: the names of sources, columns, queries and charts, the types, keys, load modes, categories, file patterns
and sheet names, which extracts and users of these projects rely on.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.operators.history import active
from holdfast.plans import evidence as E
from holdfast.plans import metrics as M
from holdfast.plans.package import Chart, Dashboard, Insight, Kpi, Views
from holdfast.spec import Project, Relationship, Source

QTY = "DECIMAL(18,4)"


def _one(view: str, expression: Callable) -> Callable[[Views], DataFrame]:
    """A one-value query over the active rows of one view."""
    return lambda views: active(views[view]).agg(expression().alias("value"))


def _over(view: str, build: Callable[[DataFrame], DataFrame]) -> Callable[[Views], DataFrame]:
    return lambda views: build(active(views[view]))


# ------------------------------------------------------------------ production quality

PRODUCTION_QUALITY = Project("production_quality", (
    Source(
        "production",
        {"production_date": "DATE", "line": "VARCHAR", "order_number": "VARCHAR", "model_code": "VARCHAR",
         "produced_qty": QTY, "defect_qty": QTY, "category": "VARCHAR"},
        key=("production_date", "line", "order_number", "model_code"), load_mode="upsert",
        event_date="production_date", lookback_days=7,
        required_columns=("production_date", "line", "order_number", "model_code", "produced_qty", "defect_qty",
                          "category"),
        control_totals=("produced_qty",), non_negative=("produced_qty", "defect_qty"),
        categories={"category": ("standard", "rework")},
        file_patterns=("production*.xlsx", "production*.csv", "*raw*data*.xlsx"), sheet="Raw Data", role="transaction"),
))
_PQ = PRODUCTION_QUALITY.view_name("production")
_PQ_SUMS = {"produced_qty": "produced_qty", "defect_qty": "defect_qty"}


def _by_model(rows: DataFrame) -> DataFrame:
    return M.sums_by(rows, ["model_code"], {"defect_qty": "defect_qty"})


def lineage_for_model(views: Views, model_code: str) -> DataFrame:
    return M.drill_through(active(views[_PQ]), "model_code", model_code,
                           ["production_date", "line", "order_number", "model_code", "produced_qty", "defect_qty",
                            "_source_file", "_source_row_number"], ["production_date", "line", "order_number"])


PRODUCTION_QUALITY_DASHBOARD = Dashboard(
    title="Output and defects",
    queries={
        "produced_total": _one(_PQ, lambda: M.total("produced_qty")),
        "defect_total": _one(_PQ, lambda: M.total("defect_qty")),
        "active_row_count": _one(_PQ, lambda: F.count("*")),
        "defect_rate_ppm": _one(_PQ, lambda: M.rate(F.sum("defect_qty"), F.sum("produced_qty"), M.PPM)),
        "latest_period": _one(_PQ, lambda: F.max("production_date")),
        "trend_by_date": _over(_PQ, lambda d: M.trend(d, "production_date", _PQ_SUMS,
                                                      ("defect_qty", "produced_qty", M.PPM))),
        "pareto_by_model": _over(_PQ, lambda d: M.pareto(_by_model(d), "model_code", "defect_qty")),
        "top_contributor": _over(_PQ, lambda d: M.ranked(_by_model(d), "model_code", "defect_qty", 1)),
        "latest_two_dates": _over(_PQ, lambda d: M.latest(d, "production_date", _PQ_SUMS)),
        "period_change_evidence": _over(_PQ, lambda d: M.latest_pair(d, "production_date", _PQ_SUMS)),
        "top_contributor_evidence": _over(_PQ, lambda d: M.share_of_total(_by_model(d), "model_code", "defect_qty", 3)),
    },
    kpis=(Kpi("produced_total", "produced_total", "Good and bad pieces made", "integer", "units", "up_good"),
          Kpi("defect_total", "defect_total", "Pieces with a defect", "integer", "units", "down_good"),
          Kpi("defect_rate_ppm", "defect_rate_ppm", "Defects per million", "integer", "PPM", "down_good")),
    charts=(Chart("trend", "trend_by_date", "Defects per million by day", "line", "production_date",
                  "Per million", y=3, unit="PPM", summary_format="{x} had {y} per million"),
            Chart("pareto", "pareto_by_model", "Defects by model, most first", "pareto", "model_code",
                  "Defects", cumulative=2, unit="units", summary_format="model {x} had {y}")),
    insights=(Insight("period_change_evidence", partial(
                  E.period_change_rate, numerator="defect_qty", denominator="produced_qty", scale=M.PPM,
                  evidence_id="period_change", metric_id="defect_rate_ppm", query="period_change_evidence",
                  label="Defect rate", unit="PPM")),
              Insight("top_contributor_evidence", partial(
                  E.top_contributor, dimension="model_code", value="defect_qty", share="share_pct",
                  evidence_id="top_contributor", metric_id="defect_qty", query="top_contributor_evidence",
                  value_label="defects"))),
    filters=(("model_code", "Model made"), ("line", "Made on line")),
    period_query="latest_period", lineage_query="active_row_count",
)

# ------------------------------------------------------------------ maintenance downtime

MAINTENANCE_DOWNTIME = Project("maintenance_downtime", (
    Source(
        "downtime",
        {"event_date": "DATE", "line": "VARCHAR", "event_id": "VARCHAR", "machine": "VARCHAR", "reason": "VARCHAR",
         "downtime_minutes": QTY, "planned_flag": "BOOLEAN"},
        key=("event_date", "line", "event_id"), load_mode="upsert", event_date="event_date", lookback_days=7,
        required_columns=("event_date", "line", "event_id", "machine", "reason", "downtime_minutes", "planned_flag"),
        control_totals=("downtime_minutes",), non_negative=("downtime_minutes",),
        categories={"reason": ("Breakdown", "Material", "Changeover", "Other")},
        file_patterns=("downtime*.xlsx", "downtime*.csv"), sheet="Downtime", role="transaction"),
))
_MD = MAINTENANCE_DOWNTIME.view_name("downtime")
_MD_SUMS = {"downtime_minutes": "downtime_minutes"}


def _by_line(rows: DataFrame) -> DataFrame:
    return M.sums_by(rows, ["line"], _MD_SUMS)


def lineage_for_line(views: Views, line: str) -> DataFrame:
    return M.drill_through(active(views[_MD]), "line", line,
                           ["event_date", "line", "event_id", "machine", "reason", "downtime_minutes",
                            "_source_file", "_source_row_number"], ["event_date", "event_id"])


MAINTENANCE_DOWNTIME_DASHBOARD = Dashboard(
    title="Stopped lines",
    queries={
        "total_downtime_minutes": _one(_MD, lambda: M.total("downtime_minutes")),
        "event_count": _one(_MD, lambda: F.count("*")),
        "average_event_minutes": _one(_MD, lambda: M.average("downtime_minutes")),
        "active_row_count": _one(_MD, lambda: F.count("*")),
        "latest_period": _one(_MD, lambda: F.max("event_date")),
        "trend_by_date": _over(_MD, lambda d: M.trend(d, "event_date", _MD_SUMS)),
        "pareto_by_line": _over(_MD, lambda d: M.pareto(_by_line(d), "line", "downtime_minutes")),
        "top_contributor": _over(_MD, lambda d: M.ranked(_by_line(d), "line", "downtime_minutes", 1)),
        "period_change_evidence": _over(_MD, lambda d: M.latest_pair(d, "event_date", _MD_SUMS)),
        "top_contributor_evidence": _over(_MD, lambda d: M.share_of_total(_by_line(d), "line", "downtime_minutes", 1)),
    },
    kpis=(Kpi("total_downtime_minutes", "total_downtime_minutes", "Minutes stopped", "integer", "minutes", "down_good"),
          Kpi("event_count", "event_count", "Stops", "integer", "events", "down_good"),
          Kpi("average_event_minutes", "average_event_minutes", "Minutes per stop", "decimal", "minutes", "down_good")),
    charts=(Chart("downtime_trend", "trend_by_date", "Minutes stopped by day", "line", "event_date",
                  "Minutes", unit="minutes", summary_format="{x} stood for {y} minutes"),
            Chart("line_pareto", "pareto_by_line", "Minutes stopped by line, most first", "pareto", "line",
                  "Minutes", cumulative=2, unit="minutes", summary_format="{x} stood for {y} minutes")),
    insights=(Insight("period_change_evidence", partial(
                  E.period_change_value, value="downtime_minutes", evidence_id="period_change",
                  metric_id="total_downtime_minutes", query="period_change_evidence", label="Daily downtime",
                  unit="minutes")),
              Insight("top_contributor_evidence", partial(
                  E.top_contributor, dimension="line", value="downtime_minutes", share="share_pct",
                  evidence_id="top_line", metric_id="downtime_minutes", query="top_contributor_evidence",
                  value_label="downtime minutes"))),
    filters=(("line", "Stopped line"), ("reason", "Cause of the stop")),
    period_query="latest_period", lineage_query="active_row_count",
)

# ------------------------------------------------------------------ supply chain

SUPPLY_CHAIN = Project("supply_chain", (
    Source(
        "orders",
        {"order_id": "VARCHAR", "order_line": "INTEGER", "order_date": "DATE", "item_id": "VARCHAR",
         "warehouse_id": "VARCHAR", "ordered_qty": QTY, "fulfilled_qty": QTY},
        key=("order_id", "order_line"), load_mode="upsert", event_date="order_date", lookback_days=30,
        deletion_rule="mark_inactive",
        required_columns=("order_id", "order_line", "order_date", "item_id", "warehouse_id", "ordered_qty",
                          "fulfilled_qty"),
        control_totals=("ordered_qty", "fulfilled_qty"), non_negative=("ordered_qty", "fulfilled_qty"),
        file_patterns=("orders*.xlsx", "orders*.csv"), sheet="Orders", role="transaction"),
    Source(
        "inventory",
        {"snapshot_date": "DATE", "warehouse_id": "VARCHAR", "item_id": "VARCHAR", "on_hand_qty": QTY},
        key=("snapshot_date", "warehouse_id", "item_id"), load_mode="snapshot", event_date="snapshot_date",
        required_columns=("snapshot_date", "warehouse_id", "item_id", "on_hand_qty"),
        control_totals=("on_hand_qty",), non_negative=("on_hand_qty",),
        file_patterns=("inventory*.xlsx", "inventory*.csv"), sheet="Inventory", role="snapshot"),
    Source(
        "item_master",
        {"item_id": "VARCHAR", "item_name": "VARCHAR", "category": "VARCHAR", "lead_time_days": "INTEGER",
         "master_updated_at": "DATE"},
        key=("item_id",), load_mode="upsert", event_date="master_updated_at", lookback_days=90,
        deletion_rule="mark_inactive",
        required_columns=("item_id", "item_name", "category", "lead_time_days", "master_updated_at"),
        non_negative=("lead_time_days",),
        file_patterns=("item_master*.xlsx", "item_master*.csv"), sheet="Item Master", role="master"),
), (
    Relationship("orders_to_item", "orders", "item_master", ("item_id",), ("item_id",), require_match=True),
    Relationship("inventory_to_item", "inventory", "item_master", ("item_id",), ("item_id",), require_match=True),
))
_SC_ORDERS, _SC_STOCK, _SC_ITEMS = (SUPPLY_CHAIN.view_name(s) for s in ("orders", "inventory", "item_master"))


def _stock(views: Views) -> DataFrame:
    return M.latest_snapshot(active(views[_SC_STOCK]), "snapshot_date")


def _shortage_by_item(views: Views) -> DataFrame:
    demand = M.sums_by(active(views[_SC_ORDERS]), ["item_id"], {"demand": F.col("ordered_qty") - F.col("fulfilled_qty")})
    stock = M.sums_by(_stock(views), ["item_id"], {"stock": "on_hand_qty"})
    return (M.shortage(active(views[_SC_ITEMS]), demand, stock, "item_id", "item_name")
            .select("item_name", "shortage_qty"))


SUPPLY_CHAIN_DASHBOARD = Dashboard(
    title="Open orders and stock",
    queries={
        "ordered_qty": _one(_SC_ORDERS, lambda: M.total("ordered_qty")),
        "fulfilled_qty": _one(_SC_ORDERS, lambda: M.total("fulfilled_qty")),
        "fulfillment_rate": _one(_SC_ORDERS, lambda: M.rate(F.sum("fulfilled_qty"), F.sum("ordered_qty"), M.PERCENT)),
        "latest_order_date": _one(_SC_ORDERS, lambda: F.max("order_date")),
        "on_hand_qty": lambda views: _stock(views).agg(M.total("on_hand_qty").alias("value")),
        "shortage_by_item": _shortage_by_item,
        "inventory_by_warehouse": lambda views: M.sums_by(
            _stock(views), ["warehouse_id"], {"on_hand_qty": "on_hand_qty"}).orderBy(F.asc_nulls_last("warehouse_id")),
        "orders_lineage_rows": _one(_SC_ORDERS, lambda: F.count("*")),
    },
    kpis=(Kpi("ordered_qty", "ordered_qty", "Ordered", "integer", "units"),
          Kpi("fulfilled_qty", "fulfilled_qty", "Delivered", "integer", "units"),
          Kpi("fulfillment_rate", "fulfillment_rate", "Share delivered", "percent", "%"),
          Kpi("on_hand_qty", "on_hand_qty", "In stock at the last count", "integer", "units")),
    charts=(Chart("shortage_by_item", "shortage_by_item", "Open orders that stock does not cover", "bar", "item", "Not covered",
                  unit="units", summary_format="{x} lacks {y}"),
            Chart("inventory_by_warehouse", "inventory_by_warehouse", "Stock at the last count, by warehouse", "bar",
                  "warehouse", "In stock", unit="units", summary_format="{x} holds {y}")),
    period_query="latest_order_date", lineage_query="orders_lineage_rows",
)

# ------------------------------------------------------------------ purchase price variance

PRICE_VARIANCE = Project("price_variance", (
    Source(
        "purchases",
        {"po_number": "VARCHAR", "po_line": "INTEGER", "posting_date": "DATE", "period": "VARCHAR",
         "item_id": "VARCHAR", "vendor_id": "VARCHAR", "quantity": QTY, "actual_unit_price": QTY, "line_amount": QTY},
        key=("po_number", "po_line"), load_mode="upsert", event_date="posting_date", lookback_days=45,
        deletion_rule="mark_inactive",
        required_columns=("po_number", "po_line", "posting_date", "period", "item_id", "vendor_id", "quantity",
                          "actual_unit_price", "line_amount"),
        control_totals=("quantity", "line_amount"), non_negative=("quantity", "actual_unit_price", "line_amount"),
        file_patterns=("purchases*.xlsx", "purchases*.csv"), sheet="Purchases", role="transaction"),
    Source(
        "standard_cost",
        {"item_id": "VARCHAR", "item_name": "VARCHAR", "category": "VARCHAR", "standard_unit_cost": QTY,
         "cost_effective_date": "DATE"},
        key=("item_id",), load_mode="upsert", event_date="cost_effective_date", lookback_days=365,
        deletion_rule="mark_inactive",
        required_columns=("item_id", "item_name", "category", "standard_unit_cost", "cost_effective_date"),
        non_negative=("standard_unit_cost",),
        file_patterns=("standard_cost*.xlsx", "standard_cost*.csv"), sheet="Standard Cost", role="master"),
    Source(
        "vendors",
        {"vendor_id": "VARCHAR", "vendor_name": "VARCHAR", "vendor_country": "VARCHAR", "vendor_updated_at": "DATE"},
        key=("vendor_id",), load_mode="upsert", event_date="vendor_updated_at", lookback_days=365,
        deletion_rule="mark_inactive",
        required_columns=("vendor_id", "vendor_name", "vendor_country", "vendor_updated_at"),
        file_patterns=("vendors*.xlsx", "vendors*.csv"), sheet="Vendors", role="master"),
    Source(
        "ppv_budget",
        {"period": "VARCHAR", "ppv_budget_amount": QTY, "budget_effective_date": "DATE"},
        key=("period",), load_mode="replace_period", event_date="budget_effective_date", required=False,
        required_columns=("period", "ppv_budget_amount", "budget_effective_date"),
        control_totals=("ppv_budget_amount",),
        file_patterns=("ppv_budget*.xlsx", "ppv_budget*.csv"), sheet="PPV Budget", role="target"),
), (
    Relationship("purchases_to_standard_cost", "purchases", "standard_cost", ("item_id",), ("item_id",),
                 require_match=True),
    Relationship("purchases_to_vendor", "purchases", "vendors", ("vendor_id",), ("vendor_id",), require_match=True),
    Relationship("purchases_to_ppv_budget", "purchases", "ppv_budget", ("period",), ("period",), require_match=False),
))
_PV_BUY, _PV_COST, _PV_VENDOR, _PV_BUDGET = (
    PRICE_VARIANCE.view_name(s) for s in ("purchases", "standard_cost", "vendors", "ppv_budget"))


def _variance(views: Views, by_purchase=(), by_item=()) -> DataFrame:
    return M.price_variance(
        active(views[_PV_BUY]), active(views[_PV_COST]), item="item_id", quantity=F.col("quantity"),
        spend=F.col("actual_unit_price") * F.col("quantity"), standard_price=F.col("standard_unit_cost"),
        by_purchase=by_purchase, by_item=by_item)


def _variance_by_vendor(views: Views) -> DataFrame:
    return M.by_dimension(_variance(views, by_purchase=["vendor_id"]), active(views[_PV_VENDOR]),
                          ["vendor_id"], ["vendor_name"], {"ppv_amount": "variance"})


def _variance_total(views: Views, column: str) -> DataFrame:
    return _variance(views).select(F.coalesce(F.col(column), F.lit(0)).alias("value"))


PRICE_VARIANCE_DASHBOARD = Dashboard(
    title="Prices paid against standard",
    queries={
        "purchase_spend": _one(_PV_BUY, lambda: M.total("line_amount")),
        "standard_spend": lambda views: _variance_total(views, "standard_spend"),
        "ppv_amount": lambda views: _variance_total(views, "variance"),
        "ppv_rate": lambda views: _variance(views).select(
            M.rate(F.col("variance"), F.col("standard_spend"), M.PERCENT).alias("value")),
        "latest_posting_date": _one(_PV_BUY, lambda: F.max("posting_date")),
        "ppv_budget_amount": _one(_PV_BUDGET, lambda: M.total("ppv_budget_amount")),
        "ppv_by_vendor": lambda views: M.ranked(_variance_by_vendor(views), "vendor_name", "ppv_amount"),
        "ppv_by_category": lambda views: M.ranked(
            _variance(views, by_item=["category"]).select("category", F.col("variance").alias("ppv_amount")),
            "category", "ppv_amount"),
        "purchases_lineage_rows": _one(_PV_BUY, lambda: F.count("*")),
        "top_unfavourable_vendor_evidence": lambda views: M.share_of_absolute(
            _variance_by_vendor(views), "vendor_name", "ppv_amount", 1),
    },
    kpis=(Kpi("purchase_spend", "purchase_spend", "Paid", "decimal", "USD"),
          Kpi("standard_spend", "standard_spend", "At standard prices", "decimal", "USD"),
          Kpi("ppv_amount", "ppv_amount", "Paid beyond standard", "decimal", "USD"),
          Kpi("ppv_rate", "ppv_rate", "Beyond standard, in percent", "percent", "%"),
          Kpi("ppv_budget_amount", "ppv_budget_amount", "Allowed beyond standard", "decimal", "USD")),
    charts=(Chart("ppv_by_vendor", "ppv_by_vendor", "Beyond standard by vendor", "bar", "vendor", "Beyond standard",
                  unit="USD", summary_format="{x} is {y} USD beyond standard"),
            Chart("ppv_by_category", "ppv_by_category", "Beyond standard by category", "bar", "category",
                  "Beyond standard", unit="USD", summary_format="{x} is {y} USD beyond standard")),
    insights=(Insight("top_unfavourable_vendor_evidence", partial(
        E.top_contributor, dimension="vendor_name", value="ppv_amount", share="share_pct",
        evidence_id="top_unfavourable_vendor", metric_id="ppv_amount", query="top_unfavourable_vendor_evidence",
        value_label="USD variance")),),
    period_query="latest_posting_date", lineage_query="purchases_lineage_rows",
)
