"""Every operator applied to the order-to-delivery tables, one query each.

Each query takes ``(spark, folder)``, reads whole Parquet tables from the folder and
returns a DataFrame. Extracts that arrive at different times are told apart by business
attributes (date, status, priority), never by slicing keys.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast.functions import cleaning as C
from holdfast.functions.headers import project_by_name as approved_columns
from holdfast.functions.values import is_true_text
from holdfast.operators import chunks as K
from holdfast.operators import drift as D
from holdfast.operators import history as H
from holdfast.operators import quality as Q
from holdfast.operators import relationships as R
from holdfast.operators import reshape as S
from holdfast.operators import tagging as T
from holdfast.operators.profile import column_profile as profile_columns
from holdfast.plans import evidence as E
from holdfast.plans import metrics as M
from holdfast.plans import package as P
from holdfast.plans.rules import Rule, run_rule
from holdfast.plans.run import CHECK_LEDGER_SCHEMA, QUARANTINE_SCHEMA, RUN_SCHEMA, run_project
from holdfast.scale import checkpoint_folder, settle, with_one_row
from holdfast.sources import archive as A
from holdfast.sources.staging import Staged, already_loaded, stage_files, stage_frame
from holdfast.sources.staging import staging_audit as audit_staging
from holdfast.sources.store import FILE_SCHEMA, Store, latest_runs, month_of, newest_entries
from holdfast.sources.store import Table as SavedTable
from holdfast.spec import Project, Relationship, Source

AMOUNT = "DECIMAL(18,4)"
EXTRACTED_AT = "2026-01-01T00:00:00+00:00"
LISTED_PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM")

ORDERS = Source(
    "orders",
    {"o_orderkey": "BIGINT", "o_custkey": "BIGINT", "o_orderstatus": "VARCHAR", "o_totalprice": AMOUNT,
     "o_orderdate": "DATE", "o_orderpriority": "VARCHAR"},
    key=("o_orderkey",), load_mode="upsert", event_date="o_orderdate", lookback_days=90,
    deletion_rule="mark_inactive", required_columns=("o_orderkey", "o_totalprice", "o_orderdate"),
    control_totals=("o_totalprice",), non_negative=("o_totalprice",),
    categories={"o_orderpriority": LISTED_PRIORITIES}, sheet="Orders", role="transaction")
LINES = Source(
    "lineitem",
    {"l_orderkey": "BIGINT", "l_linenumber": "INTEGER", "l_partkey": "BIGINT", "l_quantity": AMOUNT,
     "l_shipdate": "DATE"},
    key=("l_orderkey", "l_linenumber"), load_mode="upsert", event_date="l_shipdate")
CUSTOMERS = Source(
    "customer",
    {"c_custkey": "BIGINT", "c_name": "VARCHAR", "c_mktsegment": "VARCHAR", "c_acctbal": AMOUNT},
    key=("c_custkey",), load_mode="upsert", non_negative=("c_acctbal",), sheet="Customers", role="master")
TRADE = Project("trade", (ORDERS, LINES, CUSTOMERS))

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def amount(column: Column | str) -> Column:
    return (F.col(column) if isinstance(column, str) else column).cast("decimal(18,4)")


def wide(column: Column | str) -> Column:
    return (F.col(column) if isinstance(column, str) else column).cast("decimal(38,4)")


def rounded(column: Column | str) -> Column:
    return F.round(F.col(column) if isinstance(column, str) else column, 6)


# ------------------------------------------------------------------ extracts

def _stage(frame: DataFrame, source: Source, row_number: Column, file_name: str, run_id: str = "R1") -> Staged:
    return stage_frame(frame, source, run_id=run_id, report_id=TRADE.project_id, row_number=row_number,
                       source_file=F.lit(file_name), extracted_at=EXTRACTED_AT)


def _order_text(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as an extract shows them, with the position of each row in its file."""
    return table(spark, folder, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", amount("o_totalprice").alias("o_totalprice"),
        F.col("o_orderdate").cast("date").alias("o_orderdate"), "o_orderpriority",
        F.col("_metadata.file_name").alias("_file_name"), (F.col("_metadata.row_index") + 1).alias("_file_row"))


def staged_orders(spark: SparkSession, folder: str) -> Staged:
    frame = _order_text(spark, folder)
    return stage_frame(frame, ORDERS, run_id="R1", report_id=TRADE.project_id, row_number=F.col("_file_row"),
                       source_file=F.col("_file_name"), extracted_at=EXTRACTED_AT)


def staged_messy_orders(spark: SparkSession, folder: str) -> Staged:
    """Every order, urgent ones sent twice, with unreadable amounts and dates in it."""
    orders = _order_text(spark, folder)
    late, lost = (F.col("o_orderstatus") == s for s in ("P", "F"))
    low, urgent = (F.col("o_orderpriority") == p for p in ("5-LOW", "1-URGENT"))
    text = orders.select(
        "o_orderkey", "o_custkey", "o_orderstatus",
        F.when(late & low, F.lit("n/a")).otherwise(F.col("o_totalprice").cast("string")).alias("o_totalprice"),
        F.when((late & low) | (lost & urgent), F.lit("unknown"))
        .otherwise(F.col("o_orderdate").cast("string")).alias("o_orderdate"),
        "o_orderpriority", F.explode(F.when(urgent, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_file_copy"))
    return _stage(text, ORDERS, F.col("o_orderkey") * 2 + F.col("_file_copy") + 1, "orders_messy.csv")


def messy_order_rows(spark: SparkSession, folder: str) -> DataFrame:
    return T.read_rows(staged_messy_orders(spark, folder).rows, ORDERS)


def tagged_messy_orders(spark: SparkSession, folder: str) -> DataFrame:
    return T.tag_counted(messy_order_rows(spark, folder))


def _sent_twice(orders: DataFrame) -> DataFrame:
    """An extract that shows every shipped order twice; the copies are filtered on the way."""
    copies = F.sequence(F.lit(0), F.when(F.col("o_orderstatus") == "F", 1).otherwise(0))
    return orders.withColumn("_file_copy", F.explode(copies)).withColumn("_file_row", F.col("_file_row") * 2 + F.col("_file_copy"))


def _clean(staged: Staged) -> DataFrame:
    """Accepted rows of an extract."""
    return T.clean_rows(T.tag_counted(T.read_rows(staged.rows, staged.source)), staged.source)


def first_batch(spark: SparkSession, folder: str, source: Source = ORDERS) -> DataFrame:
    """Clean rows of run R1: orders up to May 2000, and all pending ones."""
    known = _order_text(spark, folder).where("o_orderdate < date'2000-06-01' or o_orderstatus = 'P'")
    return _clean(_stage(_sent_twice(known), source, F.col("_file_row"), "orders_1.csv"))


def first_load(spark: SparkSession, folder: str, source: Source = ORDERS) -> DataFrame:
    """History after run R1."""
    return H.new_rows(first_batch(spark, folder, source), source, "R1")


def second_batch(spark: SparkSession, folder: str, run_id: str = "R2") -> DataFrame:
    """Clean rows of run R2: every order no longer pending, urgent ones repriced by one."""
    orders = _order_text(spark, folder).where("o_orderstatus <> 'P'").withColumn(
        "o_totalprice", F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_totalprice") + 1)
        .otherwise(F.col("o_totalprice")).cast("decimal(18,4)"))
    return _clean(_stage(_sent_twice(orders), ORDERS, F.col("_file_row"), "orders_2.csv", run_id))


# ------------------------------------------------------------------ staging and projections

def stage_raw_orders(spark: SparkSession, folder: str) -> DataFrame:
    return staged_orders(spark, folder).rows.drop("_source_file_hash", "_row_order")


def _csv_extracts(spark: SparkSession, folder: str, dearer: str = "") -> list[str]:
    """Orders as one CSV file per priority, in order of their key; pending ones of low priority have a cell too many, urgent
    ones two too few. Those of the priority ``dearer`` cost one more."""
    orders = _order_text(spark, folder).withColumn("o_totalprice", F.when(
        F.col("o_orderpriority") == dearer, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")).cast("decimal(18,4)"))
    cells = [F.col(n).cast("string") for n in ORDERS.names]
    pending = F.col("o_orderstatus") == "P"
    line = (F.when(pending & (F.col("o_orderpriority") == "5-LOW"), F.concat_ws(",", *cells, F.lit("surplus")))
            .when(pending & (F.col("o_orderpriority") == "1-URGENT"), F.concat_ws(",", *cells[:-2]))
            .otherwise(F.concat_ws(",", *cells)))
    files = orders.select(F.col("o_orderpriority").alias("file"), F.col("o_orderkey").alias("place"), line.alias("value"))
    headers = files.select("file").distinct().select("file", F.lit(-1).cast("long").alias("place"), F.lit(",".join(ORDERS.names)).alias("value"))
    path = f"{checkpoint_folder(spark)}/extracts-{uuid.uuid4().hex}"
    (files.unionByName(headers).repartition("file").sortWithinPartitions("file", "place").select("file", "value")
     .write.partitionBy("file").text(path))
    # Spark spells the paths of its inputs as addresses.
    return [unquote(file) for file in spark.read.text(path).inputFiles()]


def stage_csv_orders(spark: SparkSession, folder: str) -> DataFrame:
    """CSV files staged with row numbers and file digests; a row with a cell too many is rejected, one with too few is not."""
    staged = stage_files(spark, ORDERS, _csv_extracts(spark, folder), run_id="R1", report_id=TRADE.project_id, extracted_at=EXTRACTED_AT)
    tagged = T.tag_counted(settle(T.read_rows(staged.rows, ORDERS)))
    file_name = F.regexp_extract(F.url_decode("_source_file"), "file=([^/]+)", 1).alias("file")
    return tagged.select(file_name, F.col("_source_row_number").alias("source_row"), F.col("_source_file_hash").alias("file_sha256"),
                         "_raw.*", F.col("_status").alias("status"), F.col("_reason").alias("reason_code"))


def skipped_files(spark: SparkSession, folder: str) -> DataFrame:
    """Files of a second delivery under new names, of which one has new content: which the run skips, and what it stages."""
    source = replace(ORDERS, deletion_rule="ignore")
    project = Project("trade", (source,))
    store = Store(spark, f"{checkpoint_folder(spark)}/files-{uuid.uuid4().hex}", project, buckets=8)
    for run_id, dearer in (("R1", ""), ("R2", "2-HIGH")):
        run_project(spark, project, {"orders": _csv_extracts(spark, folder, dearer)}, run_id, store, skip_loaded=True)
    files = store.ledger("files", FILE_SCHEMA).select(
        "run_id", F.regexp_extract(F.url_decode("source_file"), "file=([^/]+)", 1).alias("file"))
    staged = store.ledger("runs", RUN_SCHEMA).select("run_id", "rows_extracted", "rows_updated", "rows_unchanged")
    return files.join(staged, "run_id")


def quarantine_csv_orders(spark: SparkSession, folder: str) -> DataFrame:
    """What the quarantine keeps of CSV rows with a cell too many: their line."""
    staged = stage_files(spark, ORDERS, _csv_extracts(spark, folder), run_id="R1", report_id=TRADE.project_id, hash_files=False)
    held = T.quarantine_rows(T.tag_counted(settle(T.read_rows(staged.rows, ORDERS))), ORDERS)
    return held.select("source_row", "reason_code", F.get_json_object("raw_values", "$._line").alias("line"))


def project_by_name(spark: SparkSession, folder: str) -> DataFrame:
    """Approved columns found under a header with other case, padding and a repeated name."""
    orders = table(spark, folder, "orders").select("o_orderpriority", "o_orderkey", "o_custkey", "o_custkey")
    messy = orders.toDF("Priority", "  ORDER_KEY ", "Customer", "customer")
    return approved_columns(messy, ["order_key", "customer", "priority"])


def typed_clean_orders(spark: SparkSession, folder: str) -> DataFrame:
    return T.clean_rows(tagged_messy_orders(spark, folder), ORDERS).select(*ORDERS.names, "_source_row_number")


def row_hashes_orders(spark: SparkSession, folder: str) -> DataFrame:
    return T.read_rows(staged_orders(spark, folder).rows, ORDERS).select(
        "o_orderkey", "business_key_hash", "row_content_hash")


def staging_audit(spark: SparkSession, folder: str) -> DataFrame:
    return audit_staging(staged_orders(spark, folder).rows, ORDERS.names)


def chunk_audit(spark: SparkSession, folder: str) -> DataFrame:
    """Every thousand rows of the orders' extract with the digest of their digests."""
    return K.chunk_audit(staged_orders(spark, folder).rows, ORDERS.names, 1000)


def changed_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """The ranges in which a second extract, where the dearest orders cost one more, differs from the first."""
    orders = _order_text(spark, folder)
    dearer = with_one_row(orders, orders.agg(F.max("o_totalprice").alias("most"))).withColumn(
        "o_totalprice", F.when(F.col("o_totalprice") == F.col("most"), F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")).cast("decimal(18,4)"))
    trees = [K.hash_tree(settle(K.chunk_audit(_stage(frame, ORDERS, F.col("_file_row"), "orders.csv").rows, ORDERS.names, 100)), 8)
             for frame in (orders, dearer)]
    return K.changed_chunks(*trees, fan_out=8).select("chunk", "before_sha256", "after_sha256")


def partial_replace_blocked(spark: SparkSession, folder: str) -> DataFrame:
    """March 1998 about to be replaced by its shipped orders alone, and by all it has: months counted, and the verdicts."""
    source = replace(ORDERS, load_mode="replace_period", least_period_share=0.9)
    stored, batch = settle(first_load(spark, folder)), settle(second_batch(spark, folder))
    shipped = table(spark, folder, "orders").where("o_orderstatus = 'F'").select("o_orderkey")
    rows = []
    for name, clean in (("shipped only", batch.join(shipped, "o_orderkey", "left_semi")), ("all", batch)):
        counts = Q.period_counts(stored, clean, source, "1998-03")
        verdict = Q.period_report(counts, source).select("status")
        rows.append(with_one_row(counts.withColumn("batch", F.lit(name)), verdict))
    return rows[0].unionByName(rows[1]).select("batch", "month", "stored_rows", "arriving_rows", "complete", "status")


def clean_numeric_text(spark: SparkSession, folder: str) -> DataFrame:
    """Order totals written fifteen ways, read back as numbers with what became of each cell."""
    price, status, priority = amount("o_totalprice"), F.col("o_orderstatus"), F.col("o_orderpriority")
    grouped, plain = F.format_number(price, 2), price.cast("decimal(18,2)").cast("string")
    text = (
        F.when(priority == "1-URGENT", F.concat(F.lit("("), grouped, F.lit(")")))
        .when(priority == "2-HIGH", F.translate(grouped, ",.", ".,"))
        .when((priority == "3-MEDIUM") & (status == "F"), F.concat(plain, F.lit("-")))
        .when((priority == "3-MEDIUM") & (status == "O"),
              F.translate(plain, C.ASCII_DIGITS[:10], C.LOCAL_DIGITS[:10]))
        .when(priority == "3-MEDIUM", F.concat(F.lit("  "), plain, F.lit(" ")))
        .when((priority == "4-NOT SPECIFIED") & (status == "F"), F.lit("#n/a"))
        .when((priority == "4-NOT SPECIFIED") & (status == "O"), F.lit("   "))
        .when(priority == "4-NOT SPECIFIED", F.lit("pending"))
        .when(status == "F", F.concat(F.col("o_custkey").cast("string"), F.lit(",5")))
        .when(status == "O", F.format_number(F.col("o_orderkey") + 1000, 0))
        .otherwise(F.concat(plain, F.lit(".1"))))
    orders = table(spark, folder, "orders").select("o_orderkey", text.alias("total"))
    return C.clean_numbers(orders, "total").select(
        "o_orderkey", amount("total_number").alias("total_number"), "total_outcome")


def serial_dates(spark: SparkSession, folder: str) -> DataFrame:
    serial = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1899-12-30").cast("date"))
    return table(spark, folder, "orders").select(
        "o_orderkey", C.serial_to_date(serial).alias("date_1900"), C.serial_to_date(serial, True).alias("date_1904"))


def column_profile(spark: SparkSession, folder: str) -> DataFrame:
    return profile_columns(staged_messy_orders(spark, folder).rows, ORDERS.names)


def flag_text(spark: SparkSession, folder: str) -> DataFrame:
    """Priorities as flags in the spellings that extracts use."""
    spelling = F.when(F.col("o_orderpriority") == "1-URGENT", " YES ").when(F.col("o_orderpriority") == "2-HIGH", "1")
    spelling = spelling.when(F.col("o_orderpriority") == "3-MEDIUM", "no").when(F.col("o_orderpriority") == "5-LOW", "maybe")
    return table(spark, folder, "orders").select("o_orderkey", F.coalesce(is_true_text(spelling), F.lit(False)).alias("flag"))


# ------------------------------------------------------------------ quality gate

def quarantine_typed_values(spark: SparkSession, folder: str) -> DataFrame:
    return T.quarantine_rows(tagged_messy_orders(spark, folder), ORDERS).where("reason_code <> 'EXACT_DUPLICATE'").select(
        "source_id", "source_row", "reason_code", "reason_message", "raw_values", "resolution_status")


def quarantine_summary(spark: SparkSession, folder: str) -> DataFrame:
    return T.reason_summary(T.quarantine_rows(tagged_messy_orders(spark, folder), ORDERS))


def quarantine_customers(spark: SparkSession, folder: str) -> DataFrame:
    frame = table(spark, folder, "customer").withColumn("c_acctbal", amount("c_acctbal"))
    staged = _stage(frame, CUSTOMERS, F.col("c_custkey") + 1, "customer.csv")
    tagged = T.tag_counted(T.read_rows(staged.rows, CUSTOMERS))
    return T.quarantine_rows(tagged, CUSTOMERS).select("source_row", "reason_code", "raw_values")


def exact_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return tagged_messy_orders(spark, folder).where("_status = 'filtered'").select(
        "o_orderkey", F.col("_source_row_number").alias("source_row"), F.col("_reason").alias("reason_code"))


def conflicting_keys(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", amount("l_quantity").alias("l_quantity"),
        F.col("l_shipdate").cast("date").alias("l_shipdate"), (F.col("_metadata.row_index") + 1).alias("_file_row"))
    staged = _stage(lines, LINES, F.col("_file_row"), "lineitem.csv")
    return T.conflicting_keys(T.read_rows(staged.rows, LINES))


def check_blank_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Orders keyed by order and customer, where the customer of unprioritised ones is blank."""
    source = replace(ORDERS, key=("o_orderkey", "o_custkey"))
    orders = _order_text(spark, folder).withColumn(
        "o_custkey", F.when(F.col("o_orderpriority") == "4-NOT SPECIFIED", F.lit("  "))
        .otherwise(F.col("o_custkey").cast("string")))
    rows = T.read_rows(_stage(orders, source, F.col("_file_row"), "orders.csv").rows, source)
    return Q.as_rows(Q.key_facts(rows, T.repeated_keys(rows)), Q.key_checks(source)).select(
        "check_id", "status", "expected", "actual")


def check_category_allowed(spark: SparkSession, folder: str) -> DataFrame:
    facts = Q.source_facts(messy_order_rows(spark, folder), tagged_messy_orders(spark, folder), ORDERS)
    return Q.as_rows(facts, Q.row_checks(ORDERS)).where("check_id like '%category_allowed%'").select(
        "check_id", "severity", "status", "expected", "actual")


def population_equation(spark: SparkSession, folder: str) -> DataFrame:
    return Q.population(messy_order_rows(spark, folder), tagged_messy_orders(spark, folder), ORDERS)


def population_unbalanced(spark: SparkSession, folder: str) -> DataFrame:
    """Pending orders are lost behind staging and urgent ones doubled: neither rows nor totals balance."""
    tagged = tagged_messy_orders(spark, folder)
    wrong = tagged.where("o_orderstatus <> 'P'").unionByName(tagged.where("o_orderpriority = '1-URGENT'"))
    rows = messy_order_rows(spark, folder)
    totals = Q.control_totals(rows, wrong, ORDERS).select("source_value", "database_value", F.col("difference").alias("value_difference"))
    return with_one_row(Q.population(rows, wrong, ORDERS), totals)


def control_totals(spark: SparkSession, folder: str) -> DataFrame:
    return Q.control_totals(messy_order_rows(spark, folder), tagged_messy_orders(spark, folder), ORDERS)


def quality_report_orders(spark: SparkSession, folder: str) -> DataFrame:
    staged = staged_messy_orders(spark, folder)
    rows = settle(T.read_rows(staged.rows, ORDERS))
    report = Q.source_report(rows, T.repeated_keys(rows), T.tag_counted(rows), ORDERS, staged.present)
    return report.select("check_id", "scope", "severity", "status", "expected", "actual", "difference", "tolerance")


def quality_verdict(spark: SparkSession, folder: str) -> DataFrame:
    return Q.verdict(quality_report_orders(spark, folder))


def non_negative_measures(spark: SparkSession, folder: str) -> DataFrame:
    customers = table(spark, folder, "customer").select(amount("c_acctbal").alias("c_acctbal"))
    return Q.non_negative_checks(customers, CUSTOMERS).select("check_id", "status", "expected", "actual")


def relationship_orphans(spark: SparkSession, folder: str) -> DataFrame:
    """Lines against the parts small enough to be stocked."""
    link = Relationship("lines_to_part", "lineitem", "part", ("l_partkey",), ("p_partkey",), require_match=True)
    stocked = table(spark, folder, "part").where("p_size <= 40")
    return R.relationship_report(table(spark, folder, "lineitem"), stocked, link).select(
        "check_id", "severity", "status", "expected", "actual")


def orphan_keys(spark: SparkSession, folder: str) -> DataFrame:
    stocked = table(spark, folder, "part").where("p_size <= 40")
    return R.orphan_keys(table(spark, folder, "lineitem"), stocked, ["l_partkey"], ["p_partkey"])


def relationship_one_to_one(spark: SparkSession, folder: str) -> DataFrame:
    """Orders against customers as if each customer could order once."""
    link = Relationship("order_of_customer", "orders", "customer", ("o_custkey",), ("c_custkey",), "one_to_one", require_match=True)
    return R.relationship_report(table(spark, folder, "orders"), table(spark, folder, "customer"), link).select(
        "check_id", "severity", "status", "expected", "actual")


def relationship_cardinality(spark: SparkSession, folder: str) -> DataFrame:
    return R.repeated_key_values(table(spark, folder, "lineitem"), ["l_orderkey", "l_linenumber"])


def related_join(spark: SparkSession, folder: str) -> DataFrame:
    """Suppliers left-joined to their nation under the declared keys."""
    return M.related(table(spark, folder, "supplier").select("s_suppkey", "s_nationkey"),
                     table(spark, folder, "nation"), [("s_nationkey", "n_nationkey")], "left", ["n_name"])


def related_join_salted(spark: SparkSession, folder: str) -> DataFrame:
    """Lines joined to orders; the first line of every order is booked on one order, which so holds a quarter of all lines."""
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", amount("l_quantity").alias("l_quantity"))
    lines = with_one_row(lines, lines.agg(F.min("l_orderkey").alias("first_order"))).withColumn(
        "booked_on", F.when(F.col("l_linenumber") == 1, F.col("first_order")).otherwise(F.col("l_orderkey")))
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderpriority", "o_custkey")
    joined = R.related_rows(lines, orders, [("booked_on", "o_orderkey")], ["o_orderpriority", "o_custkey"], row_id=["l_orderkey", "l_linenumber"])
    return joined.groupBy("booked_on", "o_orderpriority", "o_custkey").agg(
        F.count("*").alias("n_lines"), wide(F.sum("l_quantity")).alias("quantity"))


def run_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """A ledger derived from orders: each month is a run, retried once per order status."""
    day = F.col("o_orderdate").cast("date")
    return (table(spark, folder, "orders")
            .groupBy(F.date_format(day, "yyyy-MM").alias("month"), "o_orderstatus")
            .agg(F.count("*").alias("rows_extracted"), F.max(day).alias("last_day"))
            .select(F.concat(F.lit("RUN-"), "month").alias("run_id"), F.lit("trade").alias("report_id"),
                    F.col("o_orderstatus").alias("status"), F.to_timestamp(F.concat("month", F.lit("-01"))).alias("started_at"),
                    F.to_timestamp(F.concat_ws(" ", F.last_day("last_day").cast("string"),
                                               F.when(F.col("o_orderstatus") == "F", "01:00:00")
                                               .when(F.col("o_orderstatus") == "O", "02:00:00")
                                               .otherwise("03:00:00"))).alias("finished_at"),
                    "rows_extracted"))


def run_ledger_latest(spark: SparkSession, folder: str) -> DataFrame:
    return latest_runs(run_ledger(spark, folder), 500).select(
        "run_id", "status", "rows_extracted", F.col("started_at").cast("date").alias("started_on"))


def row_count_movement(spark: SparkSession, folder: str) -> DataFrame:
    return Q.row_count_movement(newest_entries(run_ledger(spark, folder)), 10.0).select(
        "run_id", "rows_extracted", "previous_rows", rounded("change_pct").alias("change_pct"), "status")


# ------------------------------------------------------------------ history

def _shown(merged: DataFrame) -> DataFrame:
    return merged.select("o_orderkey", "o_totalprice", "is_active", "first_seen_run_id", "last_seen_run_id",
                         "row_content_hash", "_source_file", F.col("_change").alias("change"))


def history_append(spark: SparkSession, folder: str) -> DataFrame:
    return _shown(H.merge(first_load(spark, folder), second_batch(spark, folder), ORDERS, "R2", load_mode="append"))


def history_upsert(spark: SparkSession, folder: str) -> DataFrame:
    return _shown(H.merge(first_load(spark, folder), second_batch(spark, folder), ORDERS, "R2", deletion_rule="ignore"))


def history_mark_inactive(spark: SparkSession, folder: str) -> DataFrame:
    return _shown(H.merge(first_load(spark, folder), second_batch(spark, folder), ORDERS, "R2"))


def history_physical_delete(spark: SparkSession, folder: str) -> DataFrame:
    return _shown(H.merge(first_load(spark, folder), second_batch(spark, folder), ORDERS, "R2",
                          deletion_rule="physical", lookback_days=0))


def history_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    return _shown(H.merge(first_load(spark, folder), second_batch(spark, folder), ORDERS, "R2", load_mode="snapshot"))


def history_reactivate(spark: SparkSession, folder: str) -> DataFrame:
    """Shipped orders were retired before; the batch that shows them again revives them."""
    stored = first_load(spark, folder).withColumn("is_active", F.col("o_orderstatus") != "F")
    return _shown(H.merge(stored, second_batch(spark, folder), ORDERS, "R2", deletion_rule="ignore"))


def history_replace_period(spark: SparkSession, folder: str) -> DataFrame:
    month = second_batch(spark, folder).where(H.in_period("o_orderdate", "1998-03"))
    return _shown(H.merge(first_load(spark, folder), month, ORDERS, "R2", load_mode="replace_period", period="1998-03"))


def history_rerun(spark: SparkSession, folder: str) -> DataFrame:
    """The same batch again changes nothing but the run that saw it last."""
    once = H.without_change(H.merge(first_load(spark, folder), second_batch(spark, folder), ORDERS, "R2"))
    return _shown(H.merge(once, second_batch(spark, folder, "R3"), ORDERS, "R3"))


def history_add_column(spark: SparkSession, folder: str) -> DataFrame:
    """History stored before the priority was declared; rows not seen again stay NULL in it."""
    earlier = replace(ORDERS, categories={}, columns={c: k for c, k in ORDERS.columns.items() if c != "o_orderpriority"})
    stored = first_load(spark, folder, earlier)
    evolved = H.add_columns(stored, ORDERS, ["o_orderpriority"]).select(*ORDERS.history_schema().names)
    merged = H.merge(evolved, second_batch(spark, folder), ORDERS, "R2", deletion_rule="ignore")
    # The content hash covers every declared column, so each row seen again is an update.
    return merged.select("o_orderkey", "o_orderpriority", "last_seen_run_id", F.col("_change").alias("change"))


def _by_month(spark: SparkSession, folder: str, batch: DataFrame, **options) -> tuple[Store, SavedTable]:
    """The first load and a batch merged into history kept by month in a store."""
    store = Store(spark, f"{checkpoint_folder(spark)}/months-{uuid.uuid4().hex}", TRADE, buckets=8)
    base = store.current()
    table, _ = store.merge_months(ORDERS, base, settle(first_batch(spark, folder)), 1, "R1", load_mode="append")
    base = store.commit(base, 1, "R1", {ORDERS.source_id: table})
    table, _ = store.merge_months(ORDERS, base, settle(batch), 2, "R2", **options)
    store.commit(base, 2, "R2", {ORDERS.source_id: table})
    return store, table


def _shown_by_month(store: Store, table: SavedTable) -> DataFrame:
    """Rows of months that the last run carried over were kept, whatever an earlier run did to them."""
    untouched = [m for m, path in table.months.items() if not path.startswith(f"{table.path}/")]
    return _shown(store.last_written(table).unionByName(store.read(table, untouched).withColumn("_change", F.lit(H.KEPT))))


def history_months_append(spark: SparkSession, folder: str) -> DataFrame:
    return _shown_by_month(*_by_month(spark, folder, second_batch(spark, folder), load_mode="append"))


def history_months_upsert(spark: SparkSession, folder: str) -> DataFrame:
    """Upsert that retires unseen rows of the last 90 days."""
    return _shown_by_month(*_by_month(spark, folder, second_batch(spark, folder)))


def history_months_replace_period(spark: SparkSession, folder: str) -> DataFrame:
    month = second_batch(spark, folder).where(H.in_period("o_orderdate", "1998-03"))
    return _shown_by_month(*_by_month(spark, folder, month, load_mode="replace_period", period="1998-03"))


def history_months_touched(spark: SparkSession, folder: str) -> DataFrame:
    """Stored months, the rows each holds, and whether a batch of one month wrote it."""
    month = second_batch(spark, folder).where(H.in_period("o_orderdate", "1998-03"))
    store, table = _by_month(spark, folder, month, deletion_rule="ignore")
    rows = store.read(table).groupBy(month_of(ORDERS).alias("month")).agg(F.count("*").alias("n_rows"))
    written = store.last_written(table).select(month_of(ORDERS).alias("month"), F.lit(True).alias("written")).distinct()
    return rows.join(written, "month", "left").select("month", "n_rows", F.coalesce("written", F.lit(False)).alias("written"))


def history_counts(spark: SparkSession, folder: str) -> DataFrame:
    return H.change_counts(H.merge(first_load(spark, folder), second_batch(spark, folder), ORDERS, "R2"))


def archive_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Active history written by year and month, and rebuilt from the files alone."""
    root = f"{checkpoint_folder(spark)}/archive-{uuid.uuid4().hex}"
    merged = H.without_change(H.merge(first_load(spark, folder), second_batch(spark, folder), ORDERS, "R2"))
    A.write_archive(merged, ORDERS, root, TRADE.project_id)
    return A.read_archive(spark, ORDERS, root, TRADE.project_id).select(
        "o_orderkey", "o_totalprice", "o_orderdate", "is_active", "last_seen_run_id")


# ------------------------------------------------------------------ metrics

def _lines(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").select(
        "l_partkey", "l_suppkey", "l_linestatus", F.col("l_shipdate").cast("date").alias("ship_date"),
        amount("l_quantity").alias("quantity"), amount("l_extendedprice").alias("price"),
        (amount("l_extendedprice") * amount("l_discount")).alias("discounted"))


def _daily_sums() -> dict[str, str]:
    return {"discounted": "discounted", "price": "price"}


def _quantity_by_brand(spark: SparkSession, folder: str) -> DataFrame:
    return M.by_dimension(_lines(spark, folder).withColumnRenamed("l_partkey", "p_partkey"), table(spark, folder, "part"),
                          ["p_partkey"], ["p_brand"], {"quantity": "quantity"}).withColumn("quantity", wide("quantity"))


def _event_days(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(
        F.col("ts").cast("date").alias("event_date"), "event_type", amount("value").alias("value"))


def sum_totals(spark: SparkSession, folder: str) -> DataFrame:
    return _lines(spark, folder).agg(
        wide(M.total("quantity")).alias("total_quantity"), F.count("*").alias("row_count"),
        F.max("ship_date").alias("latest_date"))


def active_totals(spark: SparkSession, folder: str) -> DataFrame:
    merged = H.merge(first_load(spark, folder), second_batch(spark, folder), ORDERS, "R2")
    return H.active(merged).agg(F.count("*").alias("active_rows"), wide(M.total("o_totalprice")).alias("total_price"))


def average_guarded(spark: SparkSession, folder: str) -> DataFrame:
    return _lines(spark, folder).agg(rounded(M.average("quantity")).alias("average_quantity"))


def weighted_rate(spark: SparkSession, folder: str) -> DataFrame:
    rate = M.weighted_rate(_lines(spark, folder), F.col("discounted"), F.col("price"), M.PPM)
    return rate.select(rounded("rate").alias("rate"))


def trend_by_date(spark: SparkSession, folder: str) -> DataFrame:
    daily = M.trend(_lines(spark, folder), "ship_date", _daily_sums(), ("discounted", "price", M.PPM))
    return daily.select("ship_date", wide("discounted").alias("discounted"), wide("price").alias("price"),
                        rounded("rate").alias("rate"))


def latest_two_dates(spark: SparkSession, folder: str) -> DataFrame:
    return M.latest(_lines(spark, folder), "ship_date", _daily_sums()).select(
        "ship_date", wide("discounted").alias("discounted"), wide("price").alias("price"))


def period_change_rate(spark: SparkSession, folder: str) -> DataFrame:
    pair = M.latest_pair(_lines(spark, folder), "ship_date", _daily_sums())
    found = E.period_change_rate(pair, "discounted", "price", M.PPM, evidence_id="period_change", metric_id="discount_rate",
                                 query="latest_pair", label="Discount rate", unit="PPM")
    return found.select("id", "type", "current_period", "comparison_period",
                        *[rounded(c).alias(c) for c in ("current", "comparison", "change_absolute", "change_percent")],
                        "text")


def period_change_value(spark: SparkSession, folder: str) -> DataFrame:
    pair = M.latest_pair(_event_days(spark, folder), "event_date", {"value": "value"})
    found = E.period_change_value(pair, "value", evidence_id="period_change", metric_id="event_value",
                                  query="latest_pair", label="Daily value", unit="units")
    return found.select("id", "type", "current_period", "comparison_period",
                        *[rounded(c).alias(c) for c in ("current", "comparison", "change_absolute", "change_percent")],
                        "text")


def latest_snapshot_total(spark: SparkSession, folder: str) -> DataFrame:
    newest = M.latest_snapshot(_event_days(spark, folder), "event_date")
    return newest.agg(wide(M.total("value")).alias("total_value"))


def latest_snapshot_by_group(spark: SparkSession, folder: str) -> DataFrame:
    newest = M.latest_snapshot(_event_days(spark, folder), "event_date")
    return (M.sums_by(newest, ["event_type"], {"total_value": "value"})
            .select("event_type", wide("total_value").alias("total_value")).orderBy("event_type"))


def pareto_by_part(spark: SparkSession, folder: str) -> DataFrame:
    return M.pareto(_quantity_by_brand(spark, folder), "p_brand", "quantity").select(
        "p_brand", "quantity", rounded("cumulative_pct").alias("cumulative_pct"))


def top_contributor(spark: SparkSession, folder: str) -> DataFrame:
    return M.ranked(_quantity_by_brand(spark, folder), "p_brand", "quantity", 1)


def top_contributor_share(spark: SparkSession, folder: str) -> DataFrame:
    return M.share_of_total(_quantity_by_brand(spark, folder), "p_brand", "quantity", 3).select(
        "p_brand", "quantity", rounded("share_pct").alias("share_pct"))


def _variance(spark: SparkSession, folder: str, by_purchase=(), by_item=()) -> DataFrame:
    lines = _lines(spark, folder).withColumnRenamed("l_partkey", "p_partkey")
    return M.price_variance(lines, table(spark, folder, "part"), item="p_partkey", quantity=F.col("quantity"),
                            spend=F.col("price"), standard_price=amount("p_retailprice"),
                            by_purchase=by_purchase, by_item=by_item)


def price_variance_total(spark: SparkSession, folder: str) -> DataFrame:
    return _variance(spark, folder).select(
        wide("spend").alias("spend"), wide("standard_spend").alias("standard_spend"), wide("variance").alias("variance"),
        rounded(M.rate(F.col("variance"), F.col("standard_spend"), M.PERCENT)).alias("variance_pct"))


def price_variance_by_supplier(spark: SparkSession, folder: str) -> DataFrame:
    per_supplier = _variance(spark, folder, by_purchase=["l_suppkey"]).withColumnRenamed("l_suppkey", "s_suppkey")
    named = M.by_dimension(per_supplier, table(spark, folder, "supplier"), ["s_suppkey"], ["s_name"],
                           {"variance": "variance"})
    return M.ranked(named.select("s_name", wide("variance").alias("variance")), "s_name", "variance")


def _variance_by_type(spark: SparkSession, folder: str) -> DataFrame:
    return _variance(spark, folder, by_item=["p_type"]).select("p_type", wide("variance").alias("variance"))


def price_variance_by_type(spark: SparkSession, folder: str) -> DataFrame:
    return M.ranked(_variance_by_type(spark, folder), "p_type", "variance")


def top_contributor_abs_share(spark: SparkSession, folder: str) -> DataFrame:
    shares = M.share_of_absolute(_variance_by_type(spark, folder), "p_type", "variance", 1)
    found = E.top_contributor(shares, "p_type", "variance", "share_pct", evidence_id="top_type",
                              metric_id="variance", query="share_of_absolute", value_label="USD variance")
    return found.select("id", "type", rounded("current").alias("current"), "text")


def shortage_by_part(spark: SparkSession, folder: str) -> DataFrame:
    """Open quantity beyond shipped quantity of each part."""
    lines = _lines(spark, folder).withColumnRenamed("l_partkey", "p_partkey")
    demand = M.sums_by(lines.where("l_linestatus = 'O'"), ["p_partkey"], {"demand": "quantity"})
    stock = M.sums_by(lines.where("l_linestatus = 'F'"), ["p_partkey"], {"stock": "quantity"})
    return M.shortage(table(spark, folder, "part"), demand, stock, "p_partkey", "p_name").select(
        "p_partkey", "p_name", wide("shortage_qty").alias("shortage_qty"))


def lineage_drill_through(spark: SparkSession, folder: str) -> DataFrame:
    return M.drill_through(T.read_rows(staged_orders(spark, folder).rows, ORDERS), "o_orderpriority", "1-URGENT",
                           ["o_orderdate", "o_orderkey", "o_totalprice", "_source_file", "_source_row_number"],
                           ["o_orderdate", "o_orderkey"])


# ------------------------------------------------------------------ package

BRAND_CHART = P.Chart("brand_pareto", "pareto_by_brand", "Which brands sell most?", "pareto", "p_brand", "Quantity",
                      cumulative=2, unit="units")
SELECTED_BRANDS = ("Brand#3", "Brand#7", "Brand#11")
TRADE_DASHBOARD = P.Dashboard(
    title="Trade",
    queries={
        "order_count": lambda v: H.active(v["history_trade_orders"]).agg(F.count("*").alias("value")),
        "order_value": lambda v: H.active(v["history_trade_orders"]).agg(M.total("o_totalprice").alias("value")),
        "urgent_share": lambda v: H.active(v["history_trade_orders"]).agg(M.rate(
            F.sum(F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_totalprice"))), F.sum("o_totalprice"),
            M.PERCENT).alias("value")),
        "latest_order": lambda v: H.active(v["history_trade_orders"]).agg(F.max("o_orderdate").alias("value")),
        "value_by_priority": ("select o_orderpriority, sum(o_totalprice) as order_value from history_trade_orders "
                              "where is_active group by o_orderpriority order by o_orderpriority"),
    },
    kpis=(P.Kpi("order_count", "order_count", "Orders", "integer", "orders"),
          P.Kpi("order_value", "order_value", "Order value", "decimal", "USD"),
          P.Kpi("urgent_share", "urgent_share", "Urgent share", "percent", "%")),
    charts=(P.Chart("value_by_priority", "value_by_priority", "Where is the value?", dimension="priority", unit="USD"),),
    period_query="latest_order", lineage_query="order_count",
)


def _brand_points(spark: SparkSession, folder: str) -> DataFrame:
    return P.chart_points(pareto_by_part(spark, folder), BRAND_CHART)


def chart_points(spark: SparkSession, folder: str) -> DataFrame:
    return _brand_points(spark, folder)


def filter_points(spark: SparkSession, folder: str) -> DataFrame:
    return P.filter_points(_brand_points(spark, folder), BRAND_CHART, {"p_brand": SELECTED_BRANDS})


def filter_options(spark: SparkSession, folder: str) -> DataFrame:
    return P.filter_options(_brand_points(spark, folder), BRAND_CHART)


def kpi_package(spark: SparkSession, folder: str) -> DataFrame:
    """The result package of a merged history, flattened to one row per figure shown."""
    # Every figure reads the merged history, so it is computed once.
    merged = settle(H.without_change(H.merge(first_load(spark, folder), second_batch(spark, folder), ORDERS, "R2")))
    facts = P.RunFacts(TRADE.project_id, 1, "R2", Q.PASS, {}, {"orders": 0})
    root = f"{checkpoint_folder(spark)}/package-{uuid.uuid4().hex}"

    def publish(name: str, frame: DataFrame) -> tuple[str, DataFrame]:
        frame.write.parquet(f"{root}/{name}")
        return f"{root}/{name}", spark.read.parquet(f"{root}/{name}")

    package = P.build_package(spark, TRADE_DASHBOARD, {"history_trade_orders": merged}, facts, publish, generated_at=EXTRACTED_AT)
    shown = [("kpi", k["id"], k["period"], k["value"], k["display"]) for k in package["kpis"]]
    shown += [("quality", package["quality"]["status"], "", float(package["quality"]["failed"]), ""),
              ("lineage", "rows", package["report"]["period"], float(package["lineage"]["rows"]), "")]
    frame = spark.createDataFrame(shown, "section string, id string, label string, value double, display string")
    for chart in package["charts"]:
        series = chart["series"][0]
        frame = frame.unionByName(spark.read.parquet(series["points_table"]).select(
            F.lit("chart").alias("section"), F.lit(chart["id"]).alias("id"), F.col("x").alias("label"),
            F.col("y").alias("value"), F.lit("").alias("display")))
        frame = frame.unionByName(spark.createDataFrame(
            [("points", chart["id"], "", float(series["point_count"]), "")], frame.schema))
    return frame.withColumn("value", rounded("value"))


def _open_demand(inputs) -> DataFrame:
    lines = inputs["quantity_lines"]
    gap = F.coalesce(F.sum(F.when(F.col("l_linestatus") == "O", F.col("quantity"))
                           .otherwise(-F.col("quantity"))), F.lit(0))
    return lines.groupBy(F.col("l_partkey").alias("part_key")).agg(
        F.greatest(gap, F.lit(0)).cast("decimal(18,4)").alias("open_qty"))


OPEN_DEMAND = Rule("open_demand", "1", ("quantity_lines",), "rule_open_demand",
                   {"part_key": "BIGINT", "open_qty": AMOUNT}, _open_demand)


def declared_rule(spark: SparkSession, folder: str) -> DataFrame:
    return run_rule(OPEN_DEMAND, {"quantity_lines": _lines(spark, folder)})


OPEN_PARTS = Rule("open_parts", "1", ("open_demand",), "rule_open_parts", {"open_parts": "BIGINT", "open_qty": AMOUNT},
                  lambda inputs: inputs["open_demand"].where("open_qty > 0").agg(
                      F.count("*").alias("open_parts"), F.coalesce(F.sum("open_qty"), F.lit(0)).cast("decimal(18,4)").alias("open_qty")))


def rule_chain(spark: SparkSession, folder: str) -> DataFrame:
    """A rule over the written output of another."""
    return run_rule(OPEN_PARTS, {"open_demand": settle(declared_rule(spark, folder))})


def published_run(spark: SparkSession, folder: str) -> DataFrame:
    """Orders and customers staged, gated, merged and published by one run; what its tables and ledgers then hold."""
    project = Project("trade", (ORDERS, CUSTOMERS), (
        Relationship("orders_to_customer", "orders", "customer", ("o_custkey",), ("c_custkey",)),))
    store = Store(spark, f"{checkpoint_folder(spark)}/published-{uuid.uuid4().hex}", project, buckets=8)
    run_project(spark, project, {s.source_id: f"{folder}/{s.source_id}.parquet" for s in project.sources}, "R1", store,
                file_format="parquet")
    held = [store.history(s).agg(F.lit(f"history {s.source_id}").alias("part"), F.count_if(F.col("is_active")).alias("n"))
            for s in project.sources]
    ledgers = {name: store.ledger(name, schema) for name, schema in (
        ("runs", RUN_SCHEMA), ("checks", CHECK_LEDGER_SCHEMA), ("quarantine", QUARANTINE_SCHEMA))}
    runs = ledgers["runs"].select(F.inline(F.array(*[
        F.struct(F.lit(f"run {c}").alias("part"), F.col(c).alias("n"))
        for c in ("rows_extracted", "rows_rejected", "rows_filtered", "rows_inserted", "rows_updated")])))
    blocked = ledgers["checks"].agg(F.lit("blocked checks").alias("part"), F.count_if(F.col("status") == Q.BLOCK).alias("n"))
    held += [runs, blocked, ledgers["quarantine"].groupBy(F.concat(F.lit("quarantine "), "reason_code").alias("part")).agg(
        F.count("*").alias("n"))]
    return reduce(DataFrame.unionByName, held)


# ------------------------------------------------------------------ calendar, families, drift, reshaping

def calendar(spark: SparkSession, folder: str) -> DataFrame:
    """Every day from the first order to the last, with fiscal years that start in April."""
    day = F.col("o_orderdate").cast("date")
    span = table(spark, folder, "orders").agg(F.min(day).cast("string"), F.max(day).cast("string")).first()
    return M.calendar(spark, span[0], span[1], holidays=("2000-01-01",), fiscal_year_start=4)


def heatmap(spark: SparkSession, folder: str) -> DataFrame:
    lines = _lines(spark, folder)
    return M.heatmap(lines.withColumn("ship_year", F.year("ship_date")), "ship_year", "l_linestatus", "quantity").select(
        "ship_year", "l_linestatus", wide("value").alias("value"))


def rolling_rate(spark: SparkSession, folder: str) -> DataFrame:
    """Four-week rolling discount rate."""
    lines = _lines(spark, folder).withColumn("week", F.trunc("ship_date", "week"))
    weekly = M.rolling(M.sums_by(lines, ["week"], _daily_sums()), (F.datediff("week", F.lit("1970-01-05").cast("date")) / 7).cast("int"),
                       ["discounted", "price"], 4)
    return weekly.select("week", rounded(M.rate(F.col("rolling_discounted"), F.col("rolling_price"), M.PPM)).alias("rate"))


def _customer_sets(spark: SparkSession, folder: str) -> DataFrame:
    month = F.trunc(F.col("o_orderdate").cast("date"), "month")
    orders = table(spark, folder, "orders").select("o_custkey", "o_orderpriority", month.alias("month"))
    return settle(M.distinct_sets(orders, ["o_orderpriority", "month"], "o_custkey"))


def distinct_customers_rolling(spark: SparkSession, folder: str) -> DataFrame:
    """Customers with orders of each priority, per month and over three months, from one set per month."""
    sets = _customer_sets(spark, folder)
    monthly = M.distinct_count(sets, ["o_orderpriority", "month"], "distinct_customers")
    return monthly.join(M.rolling_distinct(sets, ["o_orderpriority"], "month", 3), ["o_orderpriority", "month"])


def distinct_customers_total(spark: SparkSession, folder: str) -> DataFrame:
    """Customers of each priority and of all, merged from the same monthly sets: distinct counts do not add up, sets do."""
    sets = _customer_sets(spark, folder)
    return M.distinct_count(sets, ["o_orderpriority"], "distinct_customers").unionByName(
        M.distinct_count(sets, [], "distinct_customers").withColumn("o_orderpriority", F.lit("all")))


def growth_rate(spark: SparkSession, folder: str) -> DataFrame:
    monthly = M.sums_by(_lines(spark, folder).withColumn("month", F.date_format("ship_date", "yyyy-MM")), ["month"],
                        {"price": "price"})
    number = F.substring("month", 1, 4).cast("int") * 12 + F.substring("month", 6, 2).cast("int")
    return M.growth(monthly, number, "price").select(
        "month", wide("change").alias("change"), rounded("growth_pct").alias("growth_pct"))


def order_aging(spark: SparkSession, folder: str) -> DataFrame:
    orders = _order_text(spark, folder)
    dated = with_one_row(orders, orders.agg(F.max("o_orderdate").alias("as_of")))
    return M.aging(dated, "o_orderdate", F.col("as_of"), (30, 60, 90), {"total": "o_totalprice"}).select(
        "age_days", "row_count", wide("total").alias("total"))


def actual_against_target(spark: SparkSession, folder: str) -> DataFrame:
    """Quantity sold per brand against a goal of a thousand units per listed part."""
    goals = table(spark, folder, "part").groupBy("p_brand").agg((F.count("*") * 1000).cast("decimal(38,4)").alias("goal"))
    return M.against_target(_quantity_by_brand(spark, folder), goals, ["p_brand"], "quantity", "goal").select(
        "p_brand", "quantity", "goal", wide("gap").alias("gap"), rounded("attainment_pct").alias("attainment_pct"))


def partial_period(spark: SparkSession, folder: str) -> DataFrame:
    monthly = table(spark, folder, "orders").groupBy(
        F.date_format(F.col("o_orderdate").cast("date"), "yyyy-MM").alias("month")).agg(F.count("*").alias("orders"))
    return M.partial_latest(monthly, "month", "orders", 0.5)


def insight_ranking(spark: SparkSession, folder: str) -> DataFrame:
    """Part types by how much, how strongly and for how many lines their price varies."""
    types = _variance(spark, folder, by_item=["p_type"])
    shares = with_one_row(types, types.agg(F.sum(F.abs("variance")).alias("all_variance")))
    candidates = shares.select(
        F.col("p_type").alias("id"),
        (F.abs("variance").cast("double") / F.col("all_variance").cast("double")).alias("impact"),
        F.abs(F.col("variance").cast("double") / F.col("standard_spend").cast("double")).alias("magnitude"),
        F.lit(1.0).alias("persistence"), F.lit(1.0).alias("population"), F.lit(1.0).alias("confidence"))
    return M.rank_insights(candidates).select("id", rounded("score").alias("score"))


def insight_factors(spark: SparkSession, folder: str) -> DataFrame:
    """Brands by how far, how long and how surely their newest month departs from their usual one."""
    day = F.col("l_shipdate").cast("date")
    monthly = table(spark, folder, "lineitem").groupBy("l_partkey", (F.year(day) * 12 + F.month(day)).alias("month")).agg(
        F.sum(amount("l_quantity")).alias("quantity"), F.count("*").alias("n"))
    brands = monthly.join(table(spark, folder, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey").groupBy(
        "p_brand", "month").agg(F.sum("quantity").alias("quantity"), F.sum("n").alias("n"))
    factors = M.insight_factors(settle(brands), "p_brand", "month", "quantity", "n")
    return factors.select("id", *[rounded(c).alias(c) for c in ("impact", "magnitude", "persistence", "population", "confidence")])


def fill_down(spark: SparkSession, folder: str) -> DataFrame:
    """A customer written only on urgent orders, repeated down to the next one."""
    sparse = staged_orders(spark, folder).rows.withColumn(
        "o_custkey", F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_custkey")))
    return S.fill_down(sparse, ["o_custkey"], segment_rows=1000).select("_source_row_number", "o_custkey")


def weekly_rows(spark: SparkSession, folder: str) -> DataFrame:
    """A sheet with three rows per event type and a column per week, turned into one row per type and week."""
    days = _event_days(spark, folder)
    thursday = F.date_add(F.col("event_date"), 3 - F.weekday("event_date"))
    week = F.format_string("%d-W%02d", F.year(thursday), F.weekofyear("event_date"))
    counted = days.groupBy("event_type", week.alias("week")).agg(
        F.count("*").alias("quantity"), F.count_if(F.col("value") > 20).alias("defects"))
    reported = F.round(F.col("defects") / F.col("quantity") * M.PPM) + F.when(F.col("event_type") == "error", 5000).otherwise(0)
    cells = counted.select("event_type", "week", F.inline(F.array(*[
        F.struct(F.lit(name).alias("category"), value.cast("decimal(18,4)").alias("cell"))
        for name, value in (("Quantity", F.col("quantity")), ("Defects", F.col("defects")), ("PPM", reported))])))
    ends = days.agg(F.min("event_date").cast("string"), F.max("event_date").cast("string")).first()
    # The calendar says which weeks the sheet has; two dates come to the driver.
    named = [r["week"] for r in M.calendar(spark, *ends).select("week").distinct().orderBy("week").collect()] if ends[0] else []
    sheet = cells.groupBy("event_type", "category").pivot("week", named).agg(F.max("cell"))
    rows = S.weeks_to_rows(sheet, ["event_type"], "category",
                           {"quantity": "Quantity", "defects": "Defects", "reported": "PPM"}, 1.0, M.PPM)
    # A week without events leaves empty cells in the sheet.
    return rows.where("quantity is not null").select("event_type", "week", *[wide(c).alias(c) for c in ("quantity", "defects", "reported")],
                       "well_formed", rounded("calculated").alias("calculated"), "agrees")


def dimension_versions(spark: SparkSession, folder: str) -> DataFrame:
    columns = ["o_orderkey", "o_totalprice"]
    opened = S.version_rows(None, first_load(spark, folder), columns, "2000-06-01")
    versions = S.version_rows(opened, second_batch(spark, folder), columns, "2001-09-01")
    return versions.select(*columns, "valid_from", "valid_to", "is_current")


def dimension_late_change(spark: SparkSession, folder: str) -> DataFrame:
    """After the versions of May 2000 and September 2001, urgent orders report a price that holds since December 2000; orders
    that the second extract lacks have ended."""
    columns = ["o_orderkey", "o_totalprice"]
    opened = S.version_rows(None, first_load(spark, folder), columns, "2000-06-01")
    known = settle(S.rebuilt_versions(opened, settle(second_batch(spark, folder)), columns, "2001-09-01", closes=True))
    orders = _order_text(spark, folder).where("o_orderpriority = '1-URGENT'").withColumn(
        "o_totalprice", (F.col("o_totalprice") + 2).cast("decimal(18,4)"))
    late = _clean(_stage(orders, ORDERS, F.col("_file_row"), "orders_late.csv", "R3"))
    return S.rebuilt_versions(known, late, columns, "2000-12-01").select(*columns, "valid_from", "valid_to", "is_current")


def dataset_drift(spark: SparkSession, folder: str) -> DataFrame:
    limits = {"row_count_pct": 5.0, "null_rate": 0.01, "category_count": 0}
    return D.dataset_drift(second_batch(spark, folder), first_load(spark, folder), ORDERS, limits, "2001-08").select(
        "measure", "status")


def category_drift(spark: SparkSession, folder: str) -> DataFrame:
    """States and priorities of the second extract against the first, in which only pending orders are of recent months."""
    source = replace(ORDERS, categories={**ORDERS.categories, "o_orderstatus": ("F", "O", "P")})
    return D.category_drift(settle(second_batch(spark, folder)), settle(first_load(spark, folder)), source)


def duplicate_content(spark: SparkSession, folder: str) -> DataFrame:
    """The same orders under another file name and in another order are recognised by content."""
    staged = staged_orders(spark, folder).rows
    renamed = staged.withColumn("_source_file", F.lit("copy_of_orders.csv")).repartition(4, "o_custkey")
    found = already_loaded(audit_staging(renamed, ORDERS.names), audit_staging(staged, ORDERS.names))
    return found.select("_source_file", "rows_staged", "content_hash")


def reconciled_copy(spark: SparkSession, folder: str) -> DataFrame:
    path = f"{checkpoint_folder(spark)}/copy-{uuid.uuid4().hex}"
    orders = _order_text(spark, folder).select("o_orderkey", "o_totalprice", "o_orderdate")
    return A.reconciled_copy(orders, path, ["o_totalprice"])


QUERIES: dict[str, Query] = {query.__name__: query for query in (
    chunk_audit, changed_chunks, partial_replace_blocked, related_join_salted, insight_factors, dimension_late_change,
    stage_raw_orders, stage_csv_orders, quarantine_csv_orders, skipped_files, project_by_name, typed_clean_orders, row_hashes_orders, staging_audit, clean_numeric_text,
    serial_dates, column_profile, quarantine_typed_values, quarantine_summary, quarantine_customers, exact_duplicates,
    flag_text, conflicting_keys, check_blank_keys, check_category_allowed, population_equation, population_unbalanced, control_totals,
    quality_report_orders, quality_verdict, non_negative_measures, relationship_orphans, orphan_keys,
    relationship_one_to_one, relationship_cardinality, related_join, run_ledger_latest, row_count_movement, history_append, history_upsert,
    history_months_append, history_months_upsert, history_months_replace_period, history_months_touched,
    history_mark_inactive, history_physical_delete, history_snapshot, history_reactivate, history_replace_period,
    history_rerun, history_add_column, history_counts, archive_roundtrip, sum_totals, active_totals, average_guarded,
    weighted_rate, trend_by_date, latest_two_dates, period_change_rate, period_change_value, latest_snapshot_total,
    latest_snapshot_by_group, pareto_by_part, top_contributor, top_contributor_share, price_variance_total,
    price_variance_by_supplier, price_variance_by_type, top_contributor_abs_share, shortage_by_part,
    lineage_drill_through, chart_points, filter_points, filter_options, kpi_package, declared_rule, rule_chain, published_run, calendar, heatmap, rolling_rate, distinct_customers_rolling, distinct_customers_total,
    growth_rate,
    order_aging, actual_against_target, partial_period, insight_ranking, fill_down, weekly_rows, dimension_versions,
    dataset_drift, category_drift, duplicate_content, reconciled_copy,
)}
