"""One run of a project: stage, check, gate, merge, measure, publish.

The driver only ever receives check rows and one-row counts. Each layer is written once
and read back by the next, so no step depends on the memory of an executor.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from datetime import datetime, timezone
from typing import TypeVar
from urllib.parse import unquote

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from holdfast.operators import history as H
from holdfast.operators import quality as Q
from holdfast.operators.relationships import relationship_report
from holdfast.operators.tagging import clean_rows, quarantine_rows, read_rows, repeated_keys, tag
from holdfast.plans.package import Dashboard, RunFacts, build_package, run_query, write_package
from holdfast.plans.rules import Rule, run_rule, unique_outputs
from holdfast.scale import settle
from holdfast.sources.staging import Staged, file_digests, source_paths, stage_files, staging_audit
from holdfast.sources.store import FILE_SCHEMA, Store, Table, kept_by_month, split_loaded
from holdfast.spec import KEY_HASH, Project, Source

T = TypeVar("T")
PARALLEL_SOURCES = 4
RUN_SCHEMA = ("run_id string, report_id string, report_version int, status string, started_at timestamp, "
              "finished_at timestamp, rows_extracted long, rows_rejected long, rows_filtered long, "
              "rows_inserted long, rows_updated long, rows_unchanged long, quality_status string, "
              "demo_data boolean, error_message string")
CHECK_LEDGER_SCHEMA = f"run_id string, {Q.CHECK_SCHEMA}, checked_at timestamp"
QUARANTINE_SCHEMA = ("run_id string, report_id string, source_id string, source_sheet string, source_row long, "
                     f"{KEY_HASH} string, reason_code string, reason_message string, raw_values string, "
                     "resolution_status string")


@dataclass
class SourceOutcome:
    rows_extracted: int = 0
    rows_rejected: int = 0
    rows_filtered: int = 0
    quality_status: str = Q.PASS
    inserted: int = 0
    updated: int = 0
    unchanged: int = 0
    deactivated: int = 0
    ignored: int = 0
    control_totals: list[tuple] = field(default_factory=list)


@dataclass
class Outcome:
    run_id: str
    status: str = "RUNNING"
    quality_status: str = Q.PASS
    quality_counts: dict[str, int] = field(default_factory=dict)
    sources: dict[str, SourceOutcome] = field(default_factory=dict)
    rule_rows: dict[str, int] = field(default_factory=dict)
    skipped_files: dict[str, list[str]] = field(default_factory=dict)
    package: dict | None = None
    error_message: str | None = None

    @property
    def succeeded(self) -> bool:
        return self.status == "COMPLETE"


@dataclass
class _Prepared:
    outcome: SourceOutcome
    checks: list[Row]
    clean: DataFrame


def run_project(spark: SparkSession, project: Project, inputs: Mapping[str, str | Sequence[str]], run_id: str,
                store: Store, *, dashboard: Dashboard | None = None, rules: Sequence[Rule] = (),
                periods: Mapping[str, str] | None = None, add_columns: Mapping[str, Sequence[str]] | None = None,
                file_format: str = "csv", package_path: str | None = None, demo_data: bool = False,
                skip_loaded: bool = False) -> Outcome:
    """Run every supplied source of a project and publish all of them together.

    With ``skip_loaded`` a file whose content a published run has loaded is not staged again, whatever its name; a source
    without another file keeps its history.

    A BLOCK ends the run as FAILED with history untouched. Any error after the gate does
    the same and is raised.
    """
    outcome = Outcome(run_id)
    started = datetime.now(timezone.utc)
    paths = source_paths(inputs)
    if missing := [s.source_id for s in project.sources if s.required and s.source_id not in paths]:
        outcome.status, outcome.quality_status = "FAILED", Q.BLOCK
        outcome.error_message = f"required sources were not supplied: {missing}"
        return outcome
    unique_outputs(rules)
    store.forget_run(run_id)
    try:
        _run(spark, project, paths, outcome, store, dashboard, rules, periods or {}, add_columns or {},
             file_format, demo_data, skip_loaded)
    except Exception as problem:
        outcome.status, outcome.error_message = "FAILED", str(problem)
        raise
    finally:
        store.append("runs", _run_row(spark, project, outcome, started, demo_data), run_id)
    if package_path and outcome.package is not None:
        write_package(spark, outcome.package, package_path)
    return outcome


def _run(spark: SparkSession, project: Project, paths: Mapping[str, list[str]], outcome: Outcome, store: Store,
         dashboard: Dashboard | None, rules: Sequence[Rule], periods: Mapping[str, str],
         add_columns: Mapping[str, Sequence[str]], file_format: str, demo_data: bool, skip_loaded: bool) -> None:
    run_id, base, number = outcome.run_id, store.current(), store.next_number()
    supplied = [s for s in project.sources if s.source_id in paths]
    files = {}
    if skip_loaded:
        paths, files = _new_files(spark, store, supplied, paths, outcome)
        supplied = [s for s in supplied if s.source_id in paths]

    def prepare(source: Source) -> _Prepared:
        staged = stage_files(spark, source, paths[source.source_id], run_id=run_id,
                             report_id=project.project_id, file_format=file_format)
        return prepare_source(staged, store, run_id)

    prepared = _for_each(spark, supplied, prepare)
    outcome.sources = {sid: p.outcome for sid, p in prepared.items()}

    checks = [row for p in prepared.values() for row in p.checks]
    empty = {s.source_id: spark.createDataFrame([], s.typed_schema()) for s in project.sources}
    clean = {sid: prepared[sid].clean if sid in prepared else frame for sid, frame in empty.items()}
    for source in supplied:
        period = periods.get(source.source_id)
        if source.load_mode == "replace_period" and source.least_period_share and period:
            counts = Q.period_counts(store.history(source, base), clean[source.source_id], source, period)
            checks += Q.period_report(counts, source).collect()  # one check
    for link in project.relationships:
        checks += relationship_report(clean[link.left], clean[link.right], link).collect()
    _record_checks(spark, store, run_id, checks)
    outcome.quality_status, outcome.quality_counts = _verdict(checks)
    if outcome.quality_status == Q.BLOCK:
        outcome.status = "FAILED"
        outcome.error_message = "a quality or relationship check blocked the run"
        return

    tables: dict[str, Table] = _for_each(spark, supplied, lambda source: _merge_source(
        store, base, number, run_id, source, prepared[source.source_id],
        periods.get(source.source_id), add_columns.get(source.source_id, ())))
    views = {project.view_name(s.source_id): _current(store, base, tables, s) for s in project.sources}
    if rules:
        queries = dashboard.queries if dashboard else {}
        for rule in rules:
            rule_inputs = {n: run_query(spark, queries, n, views) for n in rule.inputs}
            table = store.write_table(rule.output_table, run_rule(rule, rule_inputs), number, run_id)
            tables[rule.output_table] = table
            views[rule.output_table] = store.read(table)
            outcome.rule_rows[rule.rule_id] = views[rule.output_table].count()
    if dashboard:
        facts = RunFacts(
            project.project_id, project.version, run_id, outcome.quality_status, outcome.quality_counts,
            {sid: s.rows_extracted for sid, s in outcome.sources.items()},
            [total for s in outcome.sources.values() for total in s.control_totals], project.template_version,
            any(not link.confirmed for link in project.relationships), demo_data)

        def publish(name: str, frame: DataFrame) -> tuple[str, DataFrame]:
            table = store.write_table(name, frame, number, run_id)
            tables[name] = table
            return table.path, store.read(table)

        outcome.package = build_package(spark, dashboard, views, facts, publish)
    store.commit(base, number, run_id, tables)
    for source_id, loaded in files.items():
        store.append("files", loaded, run_id, source_id)
    outcome.status = "COMPLETE"


def _new_files(spark: SparkSession, store: Store, supplied: Sequence[Source], paths: Mapping[str, list[str]],
               outcome: Outcome) -> tuple[dict[str, list[str]], dict[str, DataFrame]]:
    """Paths of the files not loaded yet, one of those with the same content, and what the file ledger will say of them."""
    ledger, kept, files = store.ledger("files", FILE_SCHEMA), {}, {}
    for source in supplied:
        judged = settle(split_loaded(file_digests(spark, paths[source.source_id]), ledger, source.source_id))
        new = settle(judged.where("not loaded").groupBy("file_sha256").agg(F.min("source_file").alias("source_file")))
        names = {unquote(r["source_file"]) for r in new.collect()}  # files that the driver has listed
        outcome.skipped_files[source.source_id] = sorted(
            unquote(r["source_file"]) for r in judged.select("source_file").collect() if unquote(r["source_file"]) not in names)
        if names:
            kept[source.source_id], files[source.source_id] = sorted(names), new.select("source_file", "file_sha256")
    return kept, files


def _for_each(spark: SparkSession, sources: Sequence[Source], work: Callable[[Source], T]) -> dict[str, T]:
    """Sources do not depend on each other, so their jobs are submitted side by side."""
    with ThreadPoolExecutor(max_workers=max(1, min(len(sources), PARALLEL_SOURCES))) as pool:
        return dict(zip([s.source_id for s in sources], pool.map(inheritable_thread_target(spark)(work), sources)))


def prepare_source(staged: Staged, store: Store, run_id: str) -> _Prepared:
    """Stage, type, check and split one source. A blocked key check leaves no clean rows."""
    source, spark = staged.source, store.spark
    rows_path = store.scratch(run_id, source.source_id, "rows")
    read_rows(staged.rows, source).write.mode("overwrite").parquet(rows_path)
    rows = spark.read.parquet(rows_path)
    audit = staging_audit(rows.select("_raw.*", "_source_id", "_source_file", "_source_row_number"), source.names)
    store.append("audit", audit.drop("_source_id"), run_id, source.source_id)

    repeated = settle(repeated_keys(rows))
    keys = _settled_row(Q.key_facts(rows, repeated))
    counted_keys = keys.first()
    result = SourceOutcome(rows_extracted=counted_keys["raw_rows"])
    checks = Q.as_rows(keys, [Q.required_columns_check(source, staged.present), *Q.key_checks(source)]).collect()
    if any(c["status"] == Q.BLOCK for c in checks):
        result.quality_status = Q.BLOCK
        return _Prepared(result, checks, spark.createDataFrame([], source.typed_schema()))

    tagged_path = store.scratch(run_id, source.source_id, "tagged")
    tagged = tag(rows, repeated, counted_keys["repeated_keys"], on=(KEY_HASH,))
    tagged.write.mode("overwrite").partitionBy("_status").parquet(tagged_path)
    tagged = spark.read.schema(tagged.schema).parquet(tagged_path)

    facts = _settled_row(Q.source_facts(rows, tagged, source))
    counted = facts.first()
    checks += Q.as_rows(facts, Q.row_checks(source)).collect()
    result.rows_rejected, result.rows_filtered = counted["rejected_rows"], counted["filtered_rows"]
    if result.rows_rejected or result.rows_filtered:
        store.append("quarantine", quarantine_rows(tagged, source), run_id, source.source_id)
    result.quality_status, _ = _verdict(checks)
    result.control_totals = [
        (f"{source.source_id}.{name}", counted[f"total_{name}"],
         counted[f"accepted_{name}"] + counted[f"rejected_{name}"] + counted[f"filtered_{name}"])
        for name in source.control_totals]
    return _Prepared(result, checks, clean_rows(tagged, source))


def _settled_row(facts: DataFrame) -> DataFrame:
    """A one-row aggregate, computed once and kept as a literal row."""
    return facts.sparkSession.createDataFrame(facts.toArrow())


def _merge_source(store: Store, base, number: int, run_id: str, source: Source, ready: _Prepared,
                  period: str | None, added: Sequence[str]) -> Table:
    earlier = base.tables.get(source.source_id)
    if kept_by_month(source) and (earlier is None or earlier.months is not None):
        table, stored = store.merge_months(source, base, ready.clean, number, run_id, add_columns=added, period=period)
    else:
        stored = store.history(source, base)
        if added:
            stored = H.add_columns(stored, source, added)
        merged = H.merge(stored, ready.clean, source, run_id, period=period)
        table = store.write_history(source, merged.select(*source.history_schema().names, "_change"), number, run_id,
                                    first_load=earlier is None)
    written = store.last_written(table)
    counts = H.change_counts(written).first()
    result = ready.outcome
    result.inserted, result.updated = counts["inserted"], counts["updated"]
    result.unchanged, result.deactivated = counts["unchanged"], counts["deactivated"]
    accepted = result.rows_extracted - result.rows_rejected - result.rows_filtered
    if source.load_mode in ("append", "replace_period"):
        result.ignored = accepted - result.inserted
    elif source.deletion_rule == "physical":
        result.deactivated = stored.count() + result.inserted - written.count()
    return table


def _current(store: Store, base, tables: Mapping[str, Table], source: Source) -> DataFrame:
    if source.source_id in tables:
        return store.read(tables[source.source_id]).drop("_change")
    return store.history(source, base)


def _verdict(checks: Sequence[Row]) -> tuple[str, dict[str, int]]:
    """Worst status of a handful of check rows, and how many have each status."""
    counts = {status: sum(c["status"] == status for c in checks) for status in (Q.PASS, Q.WARNING, Q.BLOCK)}
    worst = next((s for s in (Q.BLOCK, Q.WARNING) if counts[s]), Q.PASS)
    return worst, counts


def _record_checks(spark: SparkSession, store: Store, run_id: str, checks: Sequence[Row]) -> None:
    if checks:
        frame = Q.checks_frame(spark, [tuple(c) for c in checks])
        store.append("checks", frame.withColumn("checked_at", F.current_timestamp()), run_id)


def _run_row(spark: SparkSession, project: Project, outcome: Outcome, started: datetime, demo_data: bool) -> DataFrame:
    parts = outcome.sources.values()
    row = (outcome.run_id, project.project_id, project.version, outcome.status, started, datetime.now(timezone.utc),
           *[sum(getattr(p, n) for p in parts) for n in
             ("rows_extracted", "rows_rejected", "rows_filtered", "inserted", "updated", "unchanged")],
           outcome.quality_status, demo_data, outcome.error_message)
    return spark.createDataFrame([row], RUN_SCHEMA)
