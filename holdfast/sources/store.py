"""Where published tables live: versioned Parquet folders and one small manifest per run.

Every table of a run is written to a new folder first. One manifest file then names the
folders that are current, so all sources of a run appear together or not at all, and
nothing that a plan reads is ever overwritten. Two writers cannot both create the same
manifest number; the second one fails.

History with an event date lies in one folder per month. A run writes the months its batch
touches and carries the others over by name, so its cost follows the batch and not history.
History without one is bucketed by its key hash: the next merge reads it bucket by bucket and
only shuffles the batch.
"""

from __future__ import annotations

import json
import zlib
from datetime import date, timedelta
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field, replace
from itertools import islice

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from holdfast.operators import history as H
from holdfast.sources.files import list_names, path_exists, read_text, remove_folder, write_new
from holdfast.scale import packed, unpacked
from holdfast.spec import CONTENT_HASH, KEY_HASH, Project, Source


# Month of rows without an event date.
NO_MONTH = "none"


def kept_by_month(source: Source) -> bool:
    return bool(source.event_date) and source.columns.get(source.event_date) == "DATE"


def month_of(source: Source) -> Column:
    return F.coalesce(F.date_format(F.col(source.event_date), "yyyy-MM"), F.lit(NO_MONTH))


class PublishConflict(RuntimeError):
    """Another run was published after this one started."""


@dataclass
class Table:
    path: str
    schema: dict
    buckets: int = 0
    # Folder of each month, of histories that are kept by month; ``path`` is what the last run wrote.
    months: dict[str, str] | None = None

    def spark_schema(self) -> T.StructType:
        return T.StructType.fromJson(self.schema)


@dataclass
class Manifest:
    number: int = 0
    run_id: str = ""
    tables: dict[str, Table] = field(default_factory=dict)


class Store:
    """Published tables and ledgers of one project below ``root``."""

    def __init__(self, spark: SparkSession, root: str, project: Project, buckets: int | None = None) -> None:
        self.spark, self.root, self.project = spark, root.rstrip("/"), project
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))

    # ------------------------------------------------------------ manifest

    def _manifest(self, name: str) -> dict | None:
        """A stored manifest; an unreadable one is the trace of a crash and counts as absent."""
        try:
            return json.loads(read_text(self.spark, f"{self.root}/_manifest/{name}"))
        except json.JSONDecodeError:
            return None

    def _manifests(self) -> Iterator[tuple[int, dict]]:
        """Readable manifests, newest first."""
        for name in reversed(list_names(self.spark, f"{self.root}/_manifest")):
            if (stored := self._manifest(name)) is not None:
                yield int(name.split(".")[0]), stored

    def current(self) -> Manifest:
        for number, stored in self._manifests():
            return Manifest(number, stored["run_id"], {n: Table(**t) for n, t in stored["tables"].items()})
        return Manifest()

    def next_number(self) -> int:
        names = list_names(self.spark, f"{self.root}/_manifest")
        return int(names[-1].split(".")[0]) + 1 if names else 1

    def commit(self, base: Manifest, number: int, run_id: str, tables: dict[str, Table]) -> Manifest:
        """Publish: tables not written by this run stay as they are in ``base``."""
        if self.current().number != base.number:
            raise PublishConflict(f"{run_id}: another run was published meanwhile")
        merged = {**base.tables, **tables}
        text = json.dumps({"run_id": run_id, "tables": {n: t.__dict__ for n, t in merged.items()}})
        try:
            write_new(self.spark, f"{self.root}/_manifest/{number:010d}.json", text)
        except Py4JJavaError as problem:
            raise PublishConflict(f"{run_id}: manifest {number} exists already") from problem
        return Manifest(number, run_id, merged)

    def expire(self, keep: int) -> None:
        """Remove table folders that none of the newest ``keep`` manifests names."""
        newest = islice(self._manifests(), max(1, keep))
        wanted = set()
        for _, stored in newest:
            for table in stored["tables"].values():
                wanted |= {table["path"], *(m.rsplit("/", 1)[0] for m in (table.get("months") or {}).values())}
        for table in list_names(self.spark, f"{self.root}/tables"):
            for version in list_names(self.spark, f"{self.root}/tables/{table}"):
                path = f"{self.root}/tables/{table}/{version}"
                if path not in wanted:
                    remove_folder(self.spark, path)

    # ------------------------------------------------------------ tables

    def _folder(self, name: str, number: int, run_id: str) -> str:
        return f"{self.root}/tables/{name}/v{number:010d}-{run_id}"

    def _catalog_name(self, path: str) -> str:
        tail = "_".join(path.rsplit("/", 2)[-2:])
        safe = "".join(c if c.isalnum() else "_" for c in tail.lower())
        return f"holdfast_{self.project.project_id}_{safe}_{zlib.crc32(self.root.encode()):08x}"

    def write_history(self, source: Source, frame: DataFrame, number: int, run_id: str, *,
                      first_load: bool = False) -> Table:
        """Write a new version of one history, one file per bucket.

        After a merge with bucketed history every task already holds a single bucket; a
        first load is shuffled into buckets here.
        """
        path = self._folder(source.source_id, number, run_id)
        name = self._catalog_name(path)
        laid_out = frame.repartition(self.buckets, KEY_HASH) if first_load else frame
        self.spark.sql(f"DROP TABLE IF EXISTS `{name}`")
        (laid_out.write.format("parquet").mode("overwrite").option("path", path)
         .bucketBy(self.buckets, KEY_HASH).sortBy(KEY_HASH).saveAsTable(name))
        return Table(path, frame.schema.jsonValue(), self.buckets)

    def merge_months(self, source: Source, base: Manifest, clean: DataFrame, number: int, run_id: str, *,
                     add_columns: Sequence[str] = (), **options: str | int | None) -> tuple[Table, DataFrame]:
        """Merge a batch into the months it touches; returns the new table and the stored rows of those months.

        Touched are the months of the batch, those where its keys are stored, and those where rows may be retired. A
        look at the key hashes, one column, finds keys in other months; nothing else of them is read and none of their
        files is written.
        """
        table = base.tables.get(source.source_id) or Table("", source.history_schema().jsonValue(), months={})
        mode = options.get("load_mode") or source.load_mode
        batch = clean.select(KEY_HASH, month_of(source).alias("_month"))
        mine = {row[0] for row in batch.select("_month").distinct().collect()}  # one row per month of the batch
        stored = set(table.months)
        period = options.get("period")
        if mode in ("append", "replace_period"):
            if mode == "replace_period":
                H.check_period(clean, source, period)
                first, after = H.period_bounds(period)
                mine |= {m for m in stored if m != NO_MONTH and f"{first:%Y-%m}" <= m <= f"{after - timedelta(days=1):%Y-%m}"}
            others = sorted(stored - mine)
            if others:
                # These modes never touch a key that is known already.
                clean = clean.join(self.read(table, others).select(KEY_HASH), KEY_HASH, "left_anti")
        else:
            mine |= self._months_to_retire(source, clean, stored, mode, options)
            others = sorted(stored - mine)
            if others:
                held = self.read(table, others).select(KEY_HASH, month_of(source).alias("_month")).join(
                    batch.select(KEY_HASH), KEY_HASH, "left_semi")
                mine |= {row[0] for row in held.select("_month").distinct().collect()}  # one row per month
        before = self.read(table, sorted(mine & stored)).drop("_change")
        if add_columns:
            before = H.add_columns(before, source, add_columns)
        H.require_columns(before, source)
        # The batch was held against its period before known keys left it.
        merged = (H.append(before.where(H.outside_period(source, period)), clean, source, run_id) if mode == "replace_period"
                  else H.merge(before, clean, source, run_id, **options))
        merged = merged.select(*source.history_schema().names, "_change")
        path = self._folder(source.source_id, number, run_id)
        # A month that holds most rows is split into several files.
        hashes = (KEY_HASH, CONTENT_HASH)
        dealt = unpacked(packed(merged.withColumn("_month", month_of(source)), hashes).hint("rebalance", "_month"), hashes)
        dealt.write.mode("overwrite").option("compression", "zstd").partitionBy("_month").parquet(path)
        written = {n.split("=", 1)[1]: f"{path}/{n}" for n in list_names(self.spark, path) if n.startswith("_month=")}
        kept = {m: p for m, p in table.months.items() if m not in mine}
        return Table(path, merged.schema.jsonValue(), months={**kept, **written}), before

    def _months_to_retire(self, source: Source, clean: DataFrame, stored: set[str], mode: str, options) -> set[str]:
        """Stored months in which rows that the batch does not show may be retired."""
        rule = options.get("deletion_rule") or source.deletion_rule
        if rule == "ignore":
            return set()
        days = options.get("lookback_days")
        days = source.lookback_days if days is None else days
        if mode != "upsert" or not days:
            return stored
        end: date | None = clean.agg(F.max(source.period_column)).first()[0]
        return set() if end is None else {m for m in stored if m != NO_MONTH and m >= f"{end - timedelta(days=days):%Y-%m}"}

    def write_table(self, name: str, frame: DataFrame, number: int, run_id: str) -> Table:
        path = self._folder(name, number, run_id)
        frame.write.mode("overwrite").parquet(path)
        return Table(path, frame.schema.jsonValue())

    def read(self, table: Table, months: Sequence[str] | None = None) -> DataFrame:
        """A table; of a history kept by month only the ``months`` asked for."""
        if table.months is not None:
            folders = [p for m, p in sorted(table.months.items()) if months is None or m in months]
            if not folders:
                return self.spark.createDataFrame([], table.spark_schema())
            return self.spark.read.schema(table.spark_schema()).parquet(*folders)
        if not table.buckets:
            return self.spark.read.schema(table.spark_schema()).parquet(table.path)
        name = self._catalog_name(table.path)
        if not self.spark.catalog.tableExists(name):
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in table.spark_schema().fields)
            self.spark.sql(
                f"CREATE TABLE `{name}` ({columns}) USING parquet CLUSTERED BY ({KEY_HASH}) "
                f"SORTED BY ({KEY_HASH}) INTO {table.buckets} BUCKETS LOCATION '{table.path}'")
        return self.spark.table(name)

    def history(self, source: Source, manifest: Manifest | None = None) -> DataFrame:
        """Current history of a source, empty before its first publication."""
        table = (manifest or self.current()).tables.get(source.source_id)
        if table is None:
            return self.spark.createDataFrame([], source.history_schema())
        return self.read(table).drop("_change")

    def last_written(self, table: Table) -> DataFrame:
        """What the last run wrote of a table, with ``_change``."""
        if table.months is None:
            return self.read(table)
        return self.read(replace(table, months={m: p for m, p in table.months.items() if p.startswith(f"{table.path}/")}))

    # ------------------------------------------------------------ ledgers

    def scratch(self, run_id: str, *parts: str) -> str:
        return "/".join([self.root, "runs", run_id, *parts])

    def _ledger(self, name: str) -> str:
        return f"{self.root}/ledger/{name}"

    def forget_run(self, run_id: str) -> None:
        """Drop what an earlier attempt of this run left in the ledgers and in scratch."""
        for name in ("runs", "checks", "quarantine", "audit", "files"):
            remove_folder(self.spark, f"{self._ledger(name)}/run_id={run_id}")
        remove_folder(self.spark, self.scratch(run_id))

    def append(self, ledger: str, frame: DataFrame, run_id: str, source_id: str | None = None) -> None:
        """Write one run's rows, of one source where given; writing them again replaces them.

        Each call owns its partition folder, so sources can be written side by side.
        """
        part = f"run_id={run_id}" + (f"/source_id={source_id}" if source_id else "")
        frame.drop("run_id", *(["source_id"] if source_id else [])).write.mode("overwrite").parquet(
            f"{self._ledger(ledger)}/{part}")

    def ledger(self, name: str, schema: T.StructType | str) -> DataFrame:
        if not path_exists(self.spark, self._ledger(name)):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self._ledger(name))


FILE_SCHEMA = "source_file string, file_sha256 string, run_id string, source_id string"


def split_loaded(digests: DataFrame, ledger: DataFrame, source_id: str) -> DataFrame:
    """Files with ``loaded``: whether a published run has loaded the same content for the source, under whatever name."""
    known = ledger.where(F.col("source_id") == source_id).select("file_sha256").distinct().withColumn("loaded", F.lit(True))
    return digests.join(known, "file_sha256", "left").withColumn("loaded", F.coalesce("loaded", F.lit(False)))


def newest_entries(ledger: DataFrame) -> DataFrame:
    """Newest entry of each run, of all runs."""
    return (ledger.withColumn("_at", F.struct("finished_at", "started_at"))
            .groupBy("run_id").agg(F.max_by(F.struct(*ledger.columns), "_at").alias("r")).select("r.*"))


def latest_runs(ledger: DataFrame, limit: int = 50) -> DataFrame:
    """Newest entry of each run, newest runs first; the limit is held between 1 and 200."""
    return newest_entries(ledger).orderBy(F.desc_nulls_last("started_at"), "run_id").limit(max(1, min(limit, 200)))


def checks_of_run(checks: DataFrame, run_id: str) -> DataFrame:
    return checks.where(F.col("run_id") == run_id).orderBy("checked_at", "check_id")
