"""Publishing: atomicity, conflicts, layout, evolution, archive and the package file."""

from __future__ import annotations

import json
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from holdfast.operators import history as H
from holdfast.plans.package import Chart, Dashboard, Kpi, chart_document, filter_options, filter_points, stale_points
from holdfast.plans.rules import Rule, RuleError
from holdfast.plans.run import CHECK_LEDGER_SCHEMA, RUN_SCHEMA, run_project
from holdfast.sources.archive import read_archive, write_archive
from holdfast.sources.store import PublishConflict, Store, checks_of_run, latest_runs
from holdfast.spec import Project, Source, load_project

ORDERS = Source("orders", {"order_id": "VARCHAR", "order_date": "DATE", "item_id": "VARCHAR", "ordered_qty": "DECIMAL(18,4)",
                           "fulfilled_qty": "DECIMAL(18,4)"}, key=("order_id",), load_mode="upsert",
                event_date="order_date", lookback_days=30, deletion_rule="mark_inactive", control_totals=("ordered_qty",))
PROJECT = Project("probe", (ORDERS,))
HEADER = "order_id,order_date,item_id,ordered_qty,fulfilled_qty"
ROWS = ("O1,2026-08-01,I1,100,80", "O2,2026-08-01,I2,50,50", "O3,2026-08-02,I1,40,30")
VIEW = PROJECT.view_name("orders")


def open_demand(inputs):
    return inputs["lines"].groupBy("item_id").agg(F.greatest(
        F.sum(F.col("ordered_qty") - F.col("fulfilled_qty")), F.lit(0)).cast("decimal(18,4)").alias("open_qty"))


RULE = Rule("open_demand", "1", ("lines",), "rule_open_demand", {"item_id": "VARCHAR", "open_qty": "DECIMAL(18,4)"},
            open_demand)
BOARD = Dashboard("Probe", {
    "lines": f"select item_id, ordered_qty, fulfilled_qty from {VIEW} where is_active",
    "open_i1": "select open_qty from rule_open_demand where item_id = 'I1'",
}, kpis=(Kpi("open_i1", "open_i1", "Open demand", "integer", "units"),))


def test_rules_atomicity_evolution_and_ledgers(spark, tmp_path, write_csv):
    store = Store(spark, str(tmp_path / "store"), PROJECT, buckets=2)
    first = write_csv("orders_1.csv", HEADER, *ROWS)
    package_path = str(tmp_path / "package.json")
    outcome = run_project(spark, PROJECT, {"orders": first}, "R1", store, dashboard=BOARD, rules=[RULE],
                          package_path=package_path)
    assert outcome.succeeded and outcome.rule_rows == {"open_demand": 2}
    assert outcome.package["kpis"][0]["value"] == 30
    assert json.load(open(package_path))["freshness"]["run_id"] == "R1"

    # A rule that fails, or a dashboard that names an unknown query, leaves history as it was.
    second = write_csv("orders_2.csv", HEADER, *ROWS, "O4,2026-08-03,I1,5,0")
    broken = replace(RULE, evaluate=lambda inputs: 1 / 0)
    with pytest.raises(RuleError):
        run_project(spark, PROJECT, {"orders": second}, "R2", store, dashboard=BOARD, rules=[broken])
    with pytest.raises(KeyError):
        run_project(spark, PROJECT, {"orders": second}, "R3", store, dashboard=replace(
            BOARD, kpis=(Kpi("x", "nowhere", "X"),)))
    assert store.history(ORDERS).count() == 3 and store.current().run_id == "R1"

    runs = latest_runs(store.ledger("runs", RUN_SCHEMA), 2).collect()
    assert [(r.run_id, r.status) for r in runs] == [("R3", "FAILED"), ("R2", "FAILED")]
    assert latest_runs(store.ledger("runs", RUN_SCHEMA), 0).count() == 1
    checks = checks_of_run(store.ledger("checks", CHECK_LEDGER_SCHEMA), "R1").collect()
    assert [c.status for c in checks] == ["PASS"] * 5

    # A new column is refused until it is added on purpose.
    wider = Project("probe", (replace(ORDERS, columns={**ORDERS.columns, "note": "VARCHAR"}),))
    wide_store = Store(spark, str(tmp_path / "store"), wider, buckets=2)
    noted = write_csv("orders_3.csv", HEADER + ",note", ROWS[0] + ",checked", "O5,2026-08-03,I2,1,1,damaged")
    with pytest.raises(H.HistoryError, match="add_columns"):
        run_project(spark, wider, {"orders": noted}, "R4", wide_store)
    assert run_project(spark, wider, {"orders": noted}, "R5", wide_store, add_columns={"orders": ["note"]}).succeeded
    notes = {r.order_id: r.note for r in wide_store.history(wider.sources[0]).collect()}
    assert notes == {"O1": "checked", "O2": None, "O3": None, "O5": "damaged"}

    # The same run again replaces what it recorded and changes no row.
    again = run_project(spark, wider, {"orders": noted}, "R5", wide_store)
    assert (again.sources["orders"].inserted, again.sources["orders"].updated) == (0, 0)
    recorded = wide_store.ledger("runs", RUN_SCHEMA).where("run_id = 'R5'").collect()
    assert [(r.rows_extracted, r.rows_unchanged) for r in recorded] == [(2, 2)]
    wide_store.expire(keep=1)
    assert wide_store.history(wider.sources[0]).count() == 4


@pytest.fixture
def loaded(spark, tmp_path):
    """A store with one published history and a batch for the next run."""
    store = Store(spark, str(tmp_path / "store"), PROJECT, buckets=3)
    rows = [(f"O{i}", "2026-08-01", f"I{i % 5}", str(i), "1") for i in range(60)]
    text = spark.createDataFrame(rows, ", ".join(f"{n} string" for n in ORDERS.names))
    typed = text.select(*[F.col(n).cast(t.dataType).alias(n) for n, t in zip(ORDERS.names, ORDERS.typed_schema())],
                        F.md5("order_id").alias("business_key_hash"),
                        F.md5(F.concat_ws("|", *ORDERS.names)).alias("row_content_hash"),
                        F.lit("f").alias("_source_file"), F.lit(1).cast("long").alias("_source_row_number"))
    first = H.new_rows(typed, ORDERS, "R1").withColumn("_change", F.lit("inserted"))
    table = store.write_history(ORDERS, first, 1, "R1", first_load=True)
    store.commit(store.current(), 1, "R1", {"orders": table})
    return store, typed


def test_merge_into_bucketed_history_shuffles_only_the_batch(spark, loaded):
    store, batch = loaded
    merged = H.merge(store.history(ORDERS), batch, ORDERS, "R2", deletion_rule="mark_inactive", lookback_days=0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = merged._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 1 and "SelectedBucketsCount: 3 out of 3" in plan
    table = store.write_history(ORDERS, merged, 2, "R2")
    assert store.read(table).count() == 60
    assert H.change_counts(store.read(table)).first()["unchanged"] == 60


def month_batch(spark, *rows):
    """Clean rows ``(order, date, quantity)``."""
    text = spark.createDataFrame([(o, d, "I", q, "1") for o, d, q in rows], ", ".join(f"{n} string" for n in ORDERS.names))
    return text.select(*[F.col(n).cast(t.dataType).alias(n) for n, t in zip(ORDERS.names, ORDERS.typed_schema())],
                       F.md5("order_id").alias("business_key_hash"), F.md5(F.concat_ws("|", *ORDERS.names)).alias("row_content_hash"),
                       F.lit("f").alias("_source_file"), F.lit(1).cast("long").alias("_source_row_number"))


@pytest.fixture
def by_month(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"), PROJECT, buckets=3)
    rows = [(f"O{m}-{i}", f"2026-{m:02d}-{i + 1:02d}", "5") for m in range(1, 7) for i in range(10)] + [("O-none", None, "5")]
    table, _ = store.merge_months(ORDERS, store.current(), month_batch(spark, *rows), 1, "R1", load_mode="append")
    return store, store.commit(store.current(), 1, "R1", {"orders": table})


def test_a_batch_of_one_month_reads_and_writes_one_month(spark, by_month):
    store, base = by_month
    old = base.tables["orders"]
    assert sorted(old.months) == [*(f"2026-{m:02d}" for m in range(1, 7)), "none"]
    batch = month_batch(spark, *[(f"O3-{i}", f"2026-03-{i + 1:02d}", "6") for i in range(4)], ("new", "2026-03-31", "1"))
    new, before = store.merge_months(ORDERS, base, batch, 2, "R2", deletion_rule="ignore")
    assert all("_month=2026-03" in f for f in before.inputFiles()) and before.count() == 10
    assert {m for m in new.months if new.months[m] != old.months[m]} == {"2026-03"}
    counts = H.change_counts(store.last_written(new)).first()
    assert (counts["inserted"], counts["updated"], counts["unchanged"], counts["deactivated"]) == (1, 4, 0, 0)
    assert store.read(new).count() == 62
    assert store.read(new, ["2026-03"]).count() == 11


def test_month_files_are_small_and_keep_their_hashes(spark, by_month):
    store, base = by_month
    rows = store.read(base.tables["orders"])
    assert all(f.endswith(".zstd.parquet") for f in rows.inputFiles())
    assert rows.where(F.col("business_key_hash") != F.md5("order_id")).isEmpty()


def test_months_follow_keys_retirement_and_periods(spark, by_month):
    store, base = by_month
    moved = month_batch(spark, ("O1-0", "2026-06-30", "5"), ("O-none", "2026-06-29", "5"))
    new, _ = store.merge_months(ORDERS, base, moved, 2, "R2", deletion_rule="ignore")
    assert {m for m in new.months if new.months[m] != base.tables["orders"].months.get(m)} == {"2026-01", "2026-06"}
    assert "none" not in new.months
    assert store.read(new, ["2026-01"]).count() == 9 and store.read(new, ["2026-06"]).count() == 12
    retired, _ = store.merge_months(ORDERS, base, month_batch(spark, ("O6-0", "2026-06-01", "5")), 2, "R3", lookback_days=40)
    assert {m for m in retired.months if retired.months[m] != base.tables["orders"].months[m]} == {"2026-04", "2026-05", "2026-06"}
    everything, _ = store.merge_months(ORDERS, base, month_batch(spark, ("O6-0", "2026-06-01", "5")), 2, "R4", load_mode="snapshot")
    assert H.change_counts(store.last_written(everything)).first()["deactivated"] == 60
    period = month_batch(spark, ("O4-1", "2026-02-05", "9"), ("fresh", "2026-02-06", "9"))
    replaced, _ = store.merge_months(ORDERS, base, period, 2, "R5", load_mode="replace_period", period="2026-02")
    assert {r["order_id"] for r in store.read(replaced, ["2026-02"]).collect()} == {"fresh"}  # O4-1 is known in April
    assert {m for m in replaced.months if replaced.months[m] != base.tables["orders"].months[m]} == {"2026-02"}
    with pytest.raises(H.HistoryError):
        store.merge_months(ORDERS, base, period, 2, "R6", load_mode="replace_period", period="2026-03")
    store.commit(base, 3, "R5", {"orders": replaced})
    store.expire(keep=1)
    assert store.history(ORDERS).count() == 52


def test_second_publisher_is_refused(loaded):
    store, _ = loaded
    base = store.current()
    store.commit(base, 2, "R2", {})
    with pytest.raises(PublishConflict):
        store.commit(base, 3, "R3", {})
    with pytest.raises(PublishConflict):
        store.commit(store.current(), 2, "R3", {})


def test_archive_round_trip_empty_and_missing(spark, loaded, tmp_path):
    store, _ = loaded
    history = store.history(ORDERS).withColumn("is_active", F.col("item_id") != "I0")
    root = str(tmp_path / "archive")
    write_archive(history, ORDERS, root, "probe")
    restored = read_archive(spark, ORDERS, root, "probe")
    assert restored.schema.names == history.columns
    assert sorted(map(tuple, restored.collect())) == sorted(map(tuple, history.where("is_active").collect()))
    write_archive(history.where("false"), ORDERS, root, "empty")
    assert read_archive(spark, ORDERS, root, "empty").count() == 0
    with pytest.raises(FileNotFoundError):
        read_archive(spark, ORDERS, root, "missing")


def test_chart_points_are_a_table_and_a_page(spark, tmp_path):
    chart = Chart("c", "q", "Title", dimension="brand", unit="u", summary_format="{x}={y}")
    points = spark.createDataFrame([(f"b{i:02d}", float(i)) for i in range(60)], "x string, y double")

    def publish(name, frame):
        frame.write.parquet(str(tmp_path / name))
        return str(tmp_path / name), spark.read.parquet(str(tmp_path / name))

    document = chart_document(points.orderBy(F.desc("x")), chart, publish, page=55, spoken_points=2)
    series = document["series"][0]
    assert document["accessible_summary"] == "b59=59.0, b58=58.0, and 58 further points in the table"
    assert series["point_count"] == 60 and [p["x"] for p in series["points"]] == [f"b{59 - i:02d}" for i in range(55)]
    stored = spark.read.parquet(series["points_table"]).orderBy("position").collect()
    assert [r.x for r in stored] == [f"b{59 - i:02d}" for i in range(60)]
    empty = chart_document(points.limit(0), Chart("e", "q", "Title"), publish)
    assert empty["series"][0]["point_count"] == 0 and empty["accessible_summary"] == "The chart is empty."
    chosen = {"brand": ["b01", "b02"]}
    shown = filter_points(points, chart, chosen)
    assert shown.count() == 2 and stale_points(shown, chart, chosen).count() == 0
    assert stale_points(points, chart, chosen).count() == 58
    assert filter_points(points, chart, {}).count() == 60 and filter_options(points, chart).count() == 60


def test_project_files_are_read(tmp_path):
    (tmp_path / "project.toml").write_text(
        'project_id = "probe"\nproject_version = 3\n[template]\ntemplate_id = "t"\ntemplate_version = "9"\n')
    (tmp_path / "sources.toml").write_text("""
[[sources]]
source_id = "orders"
business_key = ["order_id"]
event_date = "order_date"
[sources.column_types]
order_id = "VARCHAR"
order_date = "DATE"
qty = "DECIMAL(18,2)"
[sources.match]
file_patterns = ["orders*.csv"]
[sources.discovery]
sheet = "Orders"
[sources.history]
mode = "upsert"
lookback_days = 30
deletion_rule = "soft_delete"
[sources.quality]
control_totals = ["qty"]
approved_categories = { order_id = ["a"] }
""")
    (tmp_path / "relationships.toml").write_text("relationships = []\n")
    project = load_project(tmp_path)
    source = project.source("orders")
    assert (project.version, project.template_version, source.lookback_days, source.deletion_rule) == (3, "9", 30, "soft_delete")
    assert source.categories == {"order_id": ("a",)} and source.control_totals == ("qty",)
