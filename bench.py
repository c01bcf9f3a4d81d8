"""Times every query: one warm-up, then the median of up to three runs. Prints one JSON line.

``figures`` adds whole runs of a project (stage, gate, merge, measure, publish) over orders
and customers: a first load, and a second run that merges into the stored history.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the cores, ``BENCH_QUERIES`` (comma
separated) limits the queries and ``BENCH_RUNS`` the timed runs. After ``BENCH_SECONDS``
the remaining queries are timed once.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
import uuid

from holdfast.plans.queries import CUSTOMERS, ORDERS, QUERIES, TRADE_DASHBOARD
from holdfast.plans.run import run_project
from holdfast.scale import checkpoint_folder
from holdfast.session import local_session
from holdfast.sources.store import Store
from holdfast.spec import Project, Relationship


def run_once(spark, query, folder: str) -> float:
    started = time.perf_counter()
    query(spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def whole_runs(spark, folder: str) -> dict[str, float]:
    project = Project("trade", (ORDERS, CUSTOMERS), (
        Relationship("orders_to_customer", "orders", "customer", ("o_custkey",), ("c_custkey",)),))
    store = Store(spark, f"{checkpoint_folder(spark)}/bench-{uuid.uuid4().hex}", project)
    inputs = {"orders": f"{folder}/orders.parquet", "customer": f"{folder}/customer.parquet"}
    seconds = {}
    for name in ("first_run", "second_run"):
        started = time.perf_counter()
        outcome = run_project(spark, project, inputs, name, store, dashboard=TRADE_DASHBOARD, file_format="parquet")
        if not outcome.succeeded:
            raise SystemExit(f"{name}: {outcome.error_message}")
        seconds[name] = round(time.perf_counter() - started, 3)
    return seconds


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    only = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n]
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8,
                          **{"spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    seconds, began = {}, time.perf_counter()
    budget = float(os.environ.get("BENCH_SECONDS", "180"))
    for name, query in QUERIES.items():
        if only and name not in only:
            continue
        warm = run_once(spark, query, folder)
        times = [run_once(spark, query, folder)]
        while len(times) < runs and time.perf_counter() - began < budget:
            times.append(run_once(spark, query, folder))
        seconds[name] = round(statistics.median(times), 3)
        print(f"{name:30s} first {warm:6.2f}  median {seconds[name]:6.2f}", file=sys.stderr, flush=True)
    figures = {} if only else whole_runs(spark, folder)
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "figures": figures,
        "sf": os.path.basename(folder.rstrip("/")), "cores": cpus, "spark": spark.version,
        "shuffle_partitions": spark.conf.get("spark.sql.shuffle.partitions")}))
    spark.stop()


if __name__ == "__main__":
    main()
