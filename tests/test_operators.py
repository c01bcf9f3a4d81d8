"""Tagging, skew handling, relationships, profile, staging and rules on small frames."""

from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from holdfast import scale
from holdfast.operators import history as H
from holdfast.operators import quality as Q
from holdfast.operators import relationships as R
from holdfast.operators import tagging as T
from holdfast.operators.profile import column_profile
from holdfast.plans import metrics as M
from holdfast.plans.rules import Rule, RuleError, run_rule, unique_outputs
from holdfast.sources.staging import StagingError, bind_files, stage_files, stage_frame, staging_audit
from holdfast.spec import Project, Relationship, Source, SpecError

ITEMS = Source("items", {"item": "VARCHAR", "day": "DATE", "qty": "DECIMAL(18,4)", "flag": "BOOLEAN"}, key=("item",),
               load_mode="upsert", event_date="day", non_negative=("qty",), control_totals=("qty",),
               required_columns=("item", "qty"), file_patterns=("items*.csv",))


def staged(spark, rows, source=ITEMS, run_id="R1"):
    frame = spark.createDataFrame([(i + 2, *r) for i, r in enumerate(rows)],
                                  "n int, " + ", ".join(f"{c} string" for c in source.names))
    return stage_frame(frame, source, run_id=run_id, report_id="p", row_number=F.col("n"), source_file=F.lit("f"))


def clean(spark, rows, run_id="R1", source=ITEMS):
    tagged = T.tag_counted(T.read_rows(staged(spark, rows, source, run_id).rows, source))
    return T.clean_rows(tagged, source)


def brute_force_tags(rows):
    seen, tags = set(), []
    for item, day, qty, flag in rows:
        bad = ("UNPARSEABLE_DATE" if day == "bad" else "UNPARSEABLE_NUMBER" if qty == "bad"
               else "UNPARSEABLE_VALUE" if flag == "bad" else "NEGATIVE_MEASURE" if qty and qty.startswith("-") else None)
        # An unreadable value and a blank one leave the same fingerprint.
        content = (item, *[None if v in ("bad", "", None) else v for v in (day, qty, flag)])
        tags.append(bad or ("EXACT_DUPLICATE" if content in seen else None))
        seen.add(content)
    return tags


@pytest.mark.parametrize("options", [
    {"known_copies": 5}, {}, {"hot_share": 2}, {"hot_share": 10**9}, {"known_copies": 10**6, "broadcast_rows": 10}])
def test_tags_match_brute_force_with_a_hot_group(spark, options):
    pick = random.Random(7)
    rows = [("hot", "2026-01-01", "1", "true")] * 120
    rows += [(f"i{pick.randrange(40)}", pick.choice(["2026-01-01", "bad", "", None]),
              pick.choice(["1", "2", "-3", "bad", None]), pick.choice(["true", "bad", None])) for _ in range(240)]
    pick.shuffle(rows)
    typed = T.read_rows(staged(spark, rows).rows, ITEMS)
    copies = T.find_copies(typed)
    if options.get("known_copies") == 5:
        copies = scale.settle(copies)
        options = {"known_copies": copies.count()}
    got = T.tag(typed, copies, **options).orderBy("_source_row_number").select("_reason", "_status").collect()
    assert [r._reason for r in got] == brute_force_tags(rows)
    assert all((r._status == "accepted") == (r._reason is None) for r in got)


def plan_of(frame) -> str:
    return frame._jdf.queryExecution().optimizedPlan().toString()


def test_hashes_travel_as_bytes(spark):
    typed = T.read_rows(staged(spark, [("a", "2026-01-01", "1", "true"), ("a", "2026-01-01", "1", "true"), (None, "", "", "")]).rows, ITEMS)
    copies = T.find_copies(typed)
    assert "unhex(" in plan_of(copies) and "unhex(" in plan_of(T.tag(typed, scale.settle(copies)))
    rows, hashes = spark.createDataFrame([("00ff" * 8, 1), (None, 2)], "h string, n int"), ["h"]
    assert scale.packed(rows, hashes).schema["h"].dataType.typeName() == "binary"
    assert scale.unpacked(scale.packed(rows, hashes), hashes).collect() == rows.collect()


def test_report_balances_and_short_circuits(spark):
    good = staged(spark, [("a", "2026-01-01", "1", "true"), ("b", "", "-1", ""), ("a", "2026-01-01", "1", "true")])
    typed = T.read_rows(good.rows, ITEMS)
    report = {r.check_id.removeprefix("source.items."): r for r in Q.source_report(
        typed, T.repeated_keys(typed), T.tag_counted(typed), ITEMS, good.present).collect()}
    assert report["population.equation"].status == "PASS" and report["population.equation"].expected == "3"
    assert (report["control_total.qty"].expected, report["control_total.qty"].actual) == ("1.0000", "1.0000")
    assert report["row.exact_duplicate"].status == "WARNING"

    clash = staged(spark, [("a", "2026-01-01", "1", ""), ("a", "2026-01-01", "2", ""), (" ", "", "1", "")])
    typed = T.read_rows(clash.rows, ITEMS)
    blocked = Q.source_report(typed, T.repeated_keys(typed), T.tag_counted(typed), ITEMS, clash.present)
    assert [(r.check_id.split(".")[-1], r.status) for r in blocked.collect()] == [
        ("required_columns", "PASS"), ("business_key_not_blank", "BLOCK"), ("duplicate_business_key", "BLOCK")]
    assert tuple(Q.verdict(blocked).first()) == ("BLOCK", 1, 0, 2)


def test_a_lost_or_doubled_row_blocks(spark):
    good = staged(spark, [("a", "2026-01-01", "1", "true"), ("b", "", "-1", ""), ("c", "2026-01-01", "4", "true")])
    typed = T.read_rows(good.rows, ITEMS)
    tagged = T.tag_counted(typed)
    for wrong, rows, value in ((tagged.where("item <> 'c'"), "1", "4.0000"), (tagged.union(tagged.where("item = 'c'")), "-1", "-4.0000")):
        report = {r.check_id.removeprefix("source.items."): (r.status, r.difference) for r in Q.source_report(
            typed, T.repeated_keys(typed), wrong, ITEMS, good.present).collect()}
        assert report["population.equation"] == ("BLOCK", rows) and report["control_total.qty"] == ("BLOCK", value)


def test_running_total_equals_a_plain_window(spark):
    """Ties, rows without a value, and ranges that hold nothing else; NULL until the first value."""
    pick = random.Random(3)
    rows = [(f"g{i:04d}", pick.choice([0, 0, None, pick.randrange(50)])) for i in range(300)] + [(f"n{i}", None) for i in range(200)]
    frame = spark.createDataFrame(rows, "g string, v long")
    for order, ordered in (
            ([F.desc_nulls_last("v"), F.asc("g")], sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))),
            ([F.desc("g")], sorted(rows, key=lambda r: r[0], reverse=True))):
        expected, total = {}, None
        for g, v in ordered:
            total = total if v is None else (total or 0) + v
            expected[g] = total
        got = scale.running_total(frame.repartition(7), "v", order, "running")
        assert {r.g: r.running for r in got.collect()} == expected


def test_relationships(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b"), (3, None)], "id int, k string")
    right = spark.createDataFrame([("a",), ("c",), ("c",), (None,), (None,)], "k string")
    link = Relationship("l_to_r", "l", "r", ("k",), ("k",), "one_to_one", require_match=False)
    report = {r.check_id.split(".")[-1]: (r.status, r.actual) for r in R.relationship_report(left, right, link).collect()}
    assert report == {"right_cardinality": ("BLOCK", "2"), "left_cardinality": ("BLOCK", "1"), "match": ("WARNING", "3")}
    open_link = Relationship("l_to_r", "l", "r", ("k",), ("k",), confirmed=False)
    assert [r.check_id for r in R.relationship_report(left, right, open_link).collect()] == ["relationship.l_to_r.approval"]
    loose = Relationship("l_to_r", "l", "r", ("k",), ("k",), "many_to_many", require_match=True)
    assert [(r.check_id.split(".")[-1], r.status) for r in R.relationship_report(left, right, loose).collect()] == [
        ("match", "BLOCK")]


def test_profile_counts_all_distinct_values(spark):
    rows = [(str(i), "2026-01-01" if i % 2 else "2026-01-01 10:00", "1,5" if i % 3 else None, "x" if i else " ")
            for i in range(60)]
    profile = {r.column_name: r for r in column_profile(
        spark.createDataFrame(rows, "a string, b string, c string, d string"), ["a", "b", "c", "d"]).collect()}
    assert profile["a"].distinct_count == 60 and profile["a"].candidate_unique_key
    assert (profile["b"].date_like_text, profile["b"].distinct_count) == (60, 2)
    assert (profile["c"].nulls, profile["c"].number_like_text, profile["c"].distinct_count) == (20, 40, 1)
    assert (profile["d"].nulls, profile["d"].text) == (1, 59)
    whole = column_profile(spark.createDataFrame(rows, "a string, b string, c string, d string"), ["a"]).first()
    assert whole.candidate_unique_key and whole.integer_like_text == 60
    assert column_profile(spark.createDataFrame([], "a string"), ["a"]).first().distinct_count == 0


def test_csv_rows_keep_their_line_numbers_across_splits(spark, tmp_path):
    names = {}
    for name, count in (("items_b.csv", 700), ("items_a.csv", 300)):
        lines = ["item,day,qty,flag,extra"] + [f"{name}-{i},2026-01-01,{i},true,x" for i in range(count)]
        (tmp_path / name).write_text("\n".join(lines) + "\n")
        names[name] = hashlib.sha256((tmp_path / name).read_bytes()).hexdigest()
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "512")
    try:
        got = stage_files(spark, ITEMS, [str(tmp_path / n) for n in names], run_id="R", report_id="p")
        rows = got.rows.collect()
        audit = {r._source_file.rsplit("/", 1)[-1]: r for r in staging_audit(got.rows, ITEMS.names).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len(rows) == 1000 and got.present == ("item", "day", "qty", "flag", "extra")
    for row in rows:
        file_name, index = row.item.rsplit("-", 1)
        assert row._source_file.endswith(file_name) and row._source_row_number == int(index) + 2
        assert row._source_file_hash == names[file_name]
    ordered = sorted(rows, key=lambda r: r._row_order)
    assert [r.item for r in ordered] == ([f"items_a.csv-{i}" for i in range(300)]
                                         + [f"items_b.csv-{i}" for i in range(700)])
    assert (audit["items_b.csv"].first_row, audit["items_b.csv"].last_row, audit["items_b.csv"].rows_staged) == (2, 701, 700)


def test_headers_of_one_source_must_agree(spark, tmp_path):
    (tmp_path / "items_1.csv").write_text("item,day,qty,flag\na,2026-01-01,1,true\n")
    (tmp_path / "items_2.csv").write_text("item,day,amount,flag\nb,2026-01-01,1,true\n")
    with pytest.raises(Exception, match="FAILED_READ_FILE"):
        stage_files(spark, ITEMS, [str(tmp_path)], run_id="R", report_id="p").rows.collect()


def test_audit_ignores_row_order(spark):
    rows = [("a", "2026-01-01", "1", "true"), ("b", "2026-01-02", "2", None)]
    one, two, other = (staging_audit(staged(spark, r).rows, ITEMS.names).first().content_hash
                       for r in (rows, rows[::-1], rows[:1]))
    assert one == two != other


def test_files_bind_to_one_source():
    project = Project("p", (ITEMS, Source("stock", {"k": "VARCHAR"}, key=("k",), load_mode="append",
                                          file_patterns=("stock*.csv",))))
    assert bind_files(project, ["/x/Items_1.csv", "/x/stock.csv"]) == {"items": ["/x/Items_1.csv"], "stock": ["/x/stock.csv"]}
    with pytest.raises(StagingError, match="no source"):
        bind_files(project, ["/x/other.csv"])


def test_specs_refuse_contradictions():
    with pytest.raises(SpecError, match="type"):
        Source("s", {"a": "FLOAT"}, key=("a",), load_mode="upsert")
    with pytest.raises(SpecError, match="no type is declared"):
        Source("s", {"a": "VARCHAR"}, key=("b",), load_mode="upsert")
    with pytest.raises(SpecError, match="numeric"):
        Source("s", {"a": "VARCHAR"}, key=("a",), load_mode="upsert", control_totals=("a",))
    with pytest.raises(SpecError, match="does not exist"):
        Project("p", (ITEMS,), (Relationship("r", "items", "other", ("item",), ("k",)),))
    with pytest.raises(SpecError, match="snake"):
        Project("Bad", (ITEMS,))


def open_qty_rule(evaluate):
    return Rule("open_qty", "1", ("lines",), "rule_open", {"item": "VARCHAR", "open_qty": "DECIMAL(18,4)"}, evaluate)


def test_rule_output_is_checked(spark):
    lines = {"lines": spark.createDataFrame([("a", 5), ("a", 2)], "item string, qty int")}
    good = open_qty_rule(lambda i: i["lines"].groupBy("item").agg(F.sum("qty").cast("decimal(18,4)").alias("open_qty")))
    assert [tuple(r) for r in run_rule(good, lines).collect()] == [("a", 7)]
    for bad, message in ((lambda i: i["lines"], "columns"), (lambda i: [("a", 1)], "not a DataFrame"),
                         (lambda i: i["lines"].select("item", F.col("qty").alias("open_qty")), "types"),
                         (lambda i: 1 / 0, "ZeroDivisionError")):
        with pytest.raises(RuleError, match=message):
            run_rule(open_qty_rule(bad), lines)
    with pytest.raises(RuleError, match="twice"):
        unique_outputs([good, good])
    with pytest.raises(RuleError, match="not supported"):
        Rule("r", "1", ("x",), "t", {"a": "FLOAT"}, lambda i: None)


# ------------------------------------------------------------------ history

def state(history):
    return {r.item: (None if r.qty is None else int(r.qty), r.is_active, r.first_seen_run_id, r.last_seen_run_id)
            for r in history.collect()}


def test_history_keeps_every_key_once_and_reruns_change_nothing(spark):
    pick = random.Random(11)
    history = spark.createDataFrame([], ITEMS.history_schema())
    expected = {}
    for step in range(4):
        run = f"R{step}"
        batch = {f"i{k}": pick.randrange(3) for k in pick.sample(range(30), 15)}
        rows = [(k, "2026-01-01", str(q), "true") for k, q in batch.items()]
        mode, rule = (("snapshot", "mark_inactive"), ("upsert", "ignore"))[step % 2]
        merged = H.merge(history, clean(spark, rows, run), ITEMS, run, load_mode=mode, deletion_rule=rule)
        if mode == "snapshot":
            expected = {k: (q, False, f, l) for k, (q, _, f, l) in expected.items()}
        for k, q in batch.items():
            expected[k] = (q, True, expected[k][2] if k in expected else run, run)
        history = scale.settle(H.without_change(merged))
        assert state(history) == expected
        again = H.merge(history, clean(spark, rows, run), ITEMS, run, load_mode=mode, deletion_rule=rule)
        assert tuple(H.change_counts(again).first())[:3] == (0, 0, len(batch))
        assert state(again) == expected


def test_lookback_limits_what_is_retired(spark):
    first = clean(spark, [("old", "2026-01-01", "1", ""), ("new", "2026-03-01", "1", ""), ("undated", "", "1", "")])
    stored = H.new_rows(first, ITEMS, "R1")
    batch = clean(spark, [("next", "2026-03-10", "1", "")], "R2")
    near = H.merge(stored, batch, ITEMS, "R2", deletion_rule="mark_inactive", lookback_days=30)
    assert {k: v[1] for k, v in state(near).items()} == {"old": True, "new": False, "undated": True, "next": True}
    far = H.merge(stored, batch, ITEMS, "R2", deletion_rule="soft_delete", lookback_days=0)
    assert {k for k, v in state(far).items() if v[1]} == {"next"}
    gone = H.merge(stored, batch, ITEMS, "R2", deletion_rule="physical", lookback_days=30)
    assert set(state(gone)) == {"old", "undated", "next"}
    undated = clean(spark, [("next", "", "1", "")], "R2")
    kept = H.merge(stored, undated, ITEMS, "R2", deletion_rule="mark_inactive", lookback_days=30)
    assert all(v[1] for v in state(kept).values())


def test_append_and_replace_period(spark):
    stored = H.new_rows(clean(spark, [("a", "2026-01-05", "1", ""), ("b", "2026-02-05", "1", "")]), ITEMS, "R1")
    batch = clean(spark, [("a", "2026-02-09", "9", ""), ("c", "2026-02-10", "3", "")], "R2")
    assert state(H.merge(stored, batch, ITEMS, "R2", load_mode="append")) == {
        "a": (1, True, "R1", "R1"), "b": (1, True, "R1", "R1"), "c": (3, True, "R2", "R2")}
    # ``a`` survives outside the period, so the batch cannot overwrite it.
    assert set(state(H.merge(stored, batch, ITEMS, "R2", load_mode="replace_period", period="2026-02"))) == {"a", "c"}
    for period, message in ((None, "named"), ("2026-01", "do not lie"), ("202", "not YYYY"), ("2026-13", "calendar")):
        with pytest.raises(H.HistoryError, match=message):
            H.merge(stored, batch, ITEMS, "R2", load_mode="replace_period", period=period)
    with pytest.raises(H.HistoryError, match="no dated rows"):
        H.merge(stored, batch.limit(0), ITEMS, "R2", load_mode="replace_period", period="2026")
    with pytest.raises(H.HistoryError, match="load mode"):
        H.merge(stored, batch, ITEMS, "R2", load_mode="guess")


def test_undeclared_history_columns_are_refused_until_added(spark):
    old = Source("items", {"item": "VARCHAR", "day": "DATE"}, key=("item",), load_mode="upsert", event_date="day")
    stored = H.new_rows(clean(spark, [("a", "2026-01-01")], source=old), old, "R1")
    batch = clean(spark, [("a", "2026-01-01", "5", "true")], "R2")
    with pytest.raises(H.HistoryError, match="add_columns"):
        H.merge(stored, batch, ITEMS, "R2")
    evolved = H.add_columns(H.add_columns(stored, ITEMS, ["qty", "flag"]), ITEMS, ["qty"])
    assert state(H.merge(evolved, batch, ITEMS, "R2")) == {"a": (5, True, "R1", "R2")}


def test_metrics_on_nothing_are_empty_not_wrong(spark):
    nothing = spark.createDataFrame([], "g string, d date, n decimal(18,4), m decimal(18,4)")
    assert nothing.agg(M.total("n"), M.average("n"), M.rate(F.sum("n"), F.sum("m"), 100)).first()[:] == (0, None, None)
    zero = nothing.sparkSession.createDataFrame([("a", 0), ("b", 0)], "g string, v long")
    assert [r.share_pct for r in M.share_of_total(zero, "g", "v").collect()] == [None, None]
    assert [r.cumulative_pct for r in M.pareto(zero, "g", "v").collect()] == [None, None]
