"""Chunk digests, salted joins, insight factors, late versions, distinct sets, over-long CSV rows and the period gate."""

from __future__ import annotations

import hashlib
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from holdfast.operators import chunks as K
from holdfast.operators import tagging as T
from holdfast.operators.relationships import CardinalityError, related_rows
from holdfast.operators.reshape import rebuilt_versions
from holdfast.plans import metrics as M
from holdfast.plans.run import CHECK_LEDGER_SCHEMA, QUARANTINE_SCHEMA, run_project
from holdfast.sources.staging import stage_files
from holdfast.sources.store import Store
from holdfast.spec import Project, Source


def extract(spark, texts):
    return spark.createDataFrame([("f.csv", i + 1, t) for i, t in enumerate(texts)], "_source_file string, _source_row_number long, a string").repartition(3)


def test_changed_ranges_are_found_from_the_root(spark):
    texts = [None if i % 7 == 0 else "" if i % 5 == 0 else f"v{i}" for i in range(103)]
    other = [*texts[:41], "changed", *texts[42:]]
    trees = [K.hash_tree(K.chunk_audit(extract(spark, t), ["a"], 4), 3) for t in (texts, other, texts[:20], [*texts, "more"])]
    assert [len(t) for t in trees] == [4, 4, 3, 4]
    assert [level.count() for level in trees[0]] == [26, 9, 3, 1]

    def changed(a, b):
        return sorted(r["chunk"] for r in K.changed_chunks(trees[a], trees[b], 3).collect())

    assert changed(0, 1) == [10] and changed(0, 0) == []
    assert changed(0, 2) == list(range(5, 26)) and changed(0, 3) == [25]
    audit = K.chunk_audit(extract(spark, texts), ["a"], 4).where("chunk = 25").first()
    assert (audit["first_row"], audit["last_row"], audit["rows_staged"]) == (101, 103, 3)
    # NULL and empty are told apart, and so is the order of rows.
    a, b, c = (K.chunk_audit(extract(spark, t), ["a"]).first()["chunk_sha256"] for t in ([None, "x"], ["", "x"], ["x", None]))
    assert len({a, b, c}) == 3
    assert K.hash_tree(K.chunk_audit(extract(spark, ["x"]).limit(0), ["a"]))[0].count() == 0


def test_a_hot_key_is_spread_and_loses_nothing(spark):
    left = spark.range(3000).select("id", F.when(F.col("id") % 3 > 0, F.lit(1)).when(F.col("id") % 30 == 0, None).otherwise(F.col("id")).alias("k"))
    right = spark.createDataFrame([(1, "hot"), (3, "three"), (None, "nobody")], "r long, name string")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = related_rows(left, right, [("k", "r")], ["name"], row_id=["id"], hot_share=10)
        per_task = [r["n"] for r in joined.where("name = 'hot'").groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
        assert sum(per_task) == 2000 and len(per_task) > 1 and max(per_task) < 1500
        assert joined.count() == 3000 and joined.where("name = 'three'").count() == 1
        assert joined.where("name is null").count() == 3000 - 2001
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert related_rows(left, right, [("k", "r")], ["name"], row_id=["id"], how="inner", hot_share=10).count() == 2001
    with pytest.raises(CardinalityError):
        related_rows(left, right.unionByName(right), [("k", "r")], ["name"], row_id=["id"])
    with pytest.raises(CardinalityError):
        related_rows(left, right, [("k", "r")], ["name"], row_id=["id"], cardinality="one_to_one")
    twice = related_rows(left, right.unionByName(right), [("k", "r")], ["name"], row_id=["id"], cardinality="many_to_many", hot_share=10)
    assert twice.where("name = 'hot'").count() == 4000
    with pytest.raises(ValueError):
        related_rows(left, right, [("k", "r")], ["name"], row_id=["id"], how="full")


def test_insight_factors_know_runs_and_gaps(spark):
    rows = [("a", m, v, 1) for m, v in zip(range(1, 9), (1, 1, 1, 1, 9, 9, 9, 9))]  # four months above
    rows += [("b", m, v, 2) for m, v in ((1, 9), (2, 1), (4, 9), (5, 1), (7, 9), (8, 9))]  # two above, after a gap
    rows += [("c", 8, 5, 10)]  # seen once: it is its own usual value
    found = {r["id"]: r for r in M.insight_factors(
        spark.createDataFrame(rows, "g string, m int, v int, n int"), "g", "m", "v", "n").collect()}
    assert [round(found[g]["persistence"], 4) for g in "abc"] == [0.5, 0.25, 0.125]
    assert [round(found[g]["confidence"], 4) for g in "abc"] == [1.0, 0.75, 0.125]
    assert [round(found[g]["population"], 4) for g in "abc"] == [round(8 / 30, 4), 0.4, round(10 / 30, 4)]
    assert found["c"]["impact"] == found["c"]["magnitude"] == 0
    assert round(found["a"]["magnitude"], 4) == 0.8 and round(sum(r["impact"] for r in found.values()), 6) == 1


def versions(spark, *rows):
    frame = spark.createDataFrame([(k, v, a, b) for k, v, a, b in rows], "k string, v string, valid_from string, valid_to string")
    return frame.select("k", "v", F.md5("k").alias("business_key_hash"), F.md5("v").alias("row_content_hash"),
                        F.col("valid_from").cast("date"), F.col("valid_to").cast("date"), F.col("valid_to").isNull().alias("is_current"))


def batch(spark, *rows):
    return spark.createDataFrame(rows, "k string, v string").select("k", "v", F.md5("k").alias("business_key_hash"), F.md5("v").alias("row_content_hash"))


def shown(frame):
    return sorted((r["k"], r["v"], str(r["valid_from"]), str(r["valid_to"]), r["is_current"]) for r in frame.collect())


def test_versions_are_rebuilt_from_hashes_as_bytes(spark):
    stored = versions(spark, ("x", "1", "2026-01-01", None))
    rebuilt = rebuilt_versions(stored, batch(spark, ("x", "2")), ["k", "v"], "2026-02-01")
    assert "unhex(" in rebuilt._jdf.queryExecution().optimizedPlan().toString()
    assert {r["business_key_hash"] for r in rebuilt.collect()} == {r["business_key_hash"] for r in stored.collect()}


def test_late_changes_split_versions(spark):
    stored = versions(spark, ("x", "1", "2026-01-01", "2026-03-01"), ("x", "2", "2026-03-01", None), ("y", "1", "2026-01-01", None),
                      ("z", "1", "2026-01-01", "2026-02-01"))
    late = rebuilt_versions(stored, batch(spark, ("x", "late"), ("y", "1"), ("new", "1")), ["k", "v"], "2026-02-01")
    assert shown(late) == [
        ("new", "1", "2026-02-01", "None", True), ("x", "1", "2026-01-01", "2026-02-01", False), ("x", "2", "2026-03-01", "None", True),
        ("x", "late", "2026-02-01", "2026-03-01", False), ("y", "1", "2026-01-01", "None", True), ("z", "1", "2026-01-01", "2026-02-01", False)]
    same_day = rebuilt_versions(stored, batch(spark, ("x", "other"), ("z", "back")), ["k", "v"], "2026-03-01")
    assert ("x", "other", "2026-03-01", "None", True) in shown(same_day) and ("z", "back", "2026-03-01", "None", True) in shown(same_day)
    # What a batch that shows everything lacks has ended, but a key known to change later has not.
    ended = shown(rebuilt_versions(stored, batch(spark, ("none", "1")), ["k", "v"], "2026-02-15", closes=True))
    assert ("y", "1", "2026-01-01", "2026-02-15", False) in ended and ("x", "2", "2026-03-01", "None", True) in ended
    assert ("z", "1", "2026-01-01", "2026-02-01", False) in ended


def test_distinct_sets_merge(spark):
    rows = [(m, v) for m in ("2026-01-01", "2026-02-01", "2026-04-01") for v in (*range(-5, 5), 10 ** 12, 32768, None)]
    rows += [("2026-04-01", 77), ("2026-05-01", 77), ("2026-05-01", 77)]
    frame = spark.createDataFrame(rows, "m string, v long").select(F.col("m").cast("date").alias("m"), "v")
    sets = M.distinct_sets(frame, ["m"], "v", sketch=True)
    total = M.distinct_count(sets, [], "n").first()
    assert total["n"] == 13 and total["n_estimate"] == 13
    rolling = {str(r["m"]): r["rolling_distinct"] for r in M.rolling_distinct(sets.drop("sketch"), [], "m", 2).collect()}
    assert rolling == {"2026-01-01": 12, "2026-02-01": 12, "2026-04-01": 13, "2026-05-01": 13}
    assert M.rolling_distinct(sets.drop("sketch"), [], "m", 2).where("m = date'2026-03-01'").isEmpty()


SALES = Source("sales", {"sale_id": "VARCHAR", "sold_on": "DATE", "note": "VARCHAR"}, key=("sale_id",), load_mode="replace_period",
               event_date="sold_on", least_period_share=0.8)


def test_cells_beyond_the_header_are_not_lost(spark, write_csv, tmp_path):
    path = write_csv("sales.csv", "sale_id,sold_on,note", "S1,2026-01-05,fine", "S2,2026-01-05,one,too many", 'S3,2026-01-05,"a, ""b"", c"',
                     "S4,2026-01-05", "S5,2026-01-05,,", '"S,6",2026-01-05,"x","y"')
    staged = stage_files(spark, SALES, [path], run_id="R", report_id="r")
    rows = {r["sale_id"]: r for r in staged.rows.collect()}
    assert {r["_source_file_hash"] for r in rows.values()} == {hashlib.sha256(open(path, "rb").read()).hexdigest()}
    assert rows["S4"]["note"] is None and rows["S3"]["note"] == 'a, "b", c' and rows["S3"]["_source_row_number"] == 4
    tagged = T.tag_counted(T.read_rows(staged.rows, SALES))
    held = {r["source_row"]: r for r in T.quarantine_rows(tagged, SALES).collect()}
    assert {k: r["reason_code"] for k, r in held.items()} == {3: "SURPLUS_CELLS", 6: "SURPLUS_CELLS", 7: "SURPLUS_CELLS"}
    assert "one,too many" in held[3]["raw_values"]
    assert {r["sale_id"] for r in T.clean_rows(tagged, SALES).collect()} == {"S1", "S3", "S4"}


def test_a_partial_month_is_refused_and_recorded(spark, tmp_path, write_csv):
    project = Project("shop", (SALES,))
    store = Store(spark, str(tmp_path / "store"), project, buckets=2)
    header = "sale_id,sold_on,note"
    months = [f"S{m}-{i},2026-{m:02d}-{i + 1:02d},x" for m in (1, 2) for i in range(10)]
    first = write_csv("first.csv", header, *months[:10])
    assert run_project(spark, project, {"sales": first}, "R1", store, periods={"sales": "2026-01"}).succeeded
    part = write_csv("part.csv", header, *months[:7])
    refused = run_project(spark, project, {"sales": part}, "R2", store, periods={"sales": "2026-01"})
    assert not refused.succeeded and store.history(SALES).count() == 10
    check = store.ledger("checks", CHECK_LEDGER_SCHEMA).where("check_id like '%period.complete' and run_id = 'R2'").first()
    assert (check["status"], check["expected"], check["actual"]) == ("BLOCK", "10", "7")
    most = write_csv("most.csv", header, *months[:8])
    assert run_project(spark, project, {"sales": most}, "R3", store, periods={"sales": "2026-01"}).succeeded
    assert store.history(SALES).count() == 8
    second = write_csv("second.csv", header, *months[10:], "S9,2026-02-20,x,surplus")
    assert run_project(spark, project, {"sales": second}, "R4", store, periods={"sales": "2026-02"}).succeeded
    assert store.history(SALES).count() == 18
    assert store.ledger("quarantine", QUARANTINE_SCHEMA).where("reason_code = 'SURPLUS_CELLS'").count() == 1
    free = replace(SALES, least_period_share=0.0)
    loose = Store(spark, str(tmp_path / "loose"), Project("shop", (free,)), buckets=2)
    for run, path in (("R1", first), ("R2", part)):
        assert run_project(spark, loose.project, {"sales": path}, run, loose, periods={"sales": "2026-01"}).succeeded
    assert loose.history(free).count() == 7


def test_a_file_loaded_before_is_not_staged_again(spark, tmp_path, write_csv):
    source = replace(SALES, load_mode="upsert", least_period_share=0.0)
    project = Project("shop", (source,))
    store = Store(spark, str(tmp_path / "store"), project, buckets=2)
    header = "sale_id,sold_on,note"
    first = write_csv("week 1.csv", header, "S1,2026-01-05,x", "S2,2026-02-05,x")
    assert run_project(spark, project, {"sales": first}, "R1", store, skip_loaded=True).sources["sales"].inserted == 2
    renamed, new = write_csv("again.csv", header, "S1,2026-01-05,x", "S2,2026-02-05,x"), write_csv("new.csv", header, "S3,2026-01-06,x")
    twin = write_csv("twin of new.csv", header, "S3,2026-01-06,x")
    second = run_project(spark, project, {"sales": [renamed, new, twin]}, "R2", store, skip_loaded=True)
    assert second.sources["sales"].rows_extracted == 1 and second.sources["sales"].inserted == 1
    assert [p.rsplit("/", 1)[1] for p in second.skipped_files["sales"]] == ["again.csv", "twin of new.csv"]
    third = run_project(spark, project, {"sales": [renamed]}, "R3", store, skip_loaded=True)
    assert third.succeeded and third.sources == {} and store.history(source).count() == 3
    # Asked for or not, a file that no published run has loaded is staged.
    assert run_project(spark, project, {"sales": [renamed]}, "R4", store).sources["sales"].unchanged == 2
