"""Extracts that arrive over time, taken in one at a time in order of arrival.

A stream only discovers files; each file goes through the same batch run as any other
extract. Deletion rules read a batch as the complete picture of its window, so one
extract is exactly one micro-batch. Delivery is at least once and the effect is once: a
replayed batch has the same run id, and merging the same rows again changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from holdfast.plans.package import Dashboard
from holdfast.plans.run import Outcome, run_project
from holdfast.plans.rules import Rule
from holdfast.sources.store import Store
from holdfast.spec import Project


# Columns of Spark's file source.
FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


class BlockedBatch(RuntimeError):
    """A quality check blocked an extract; the stream stops before taking the next one."""


def load_arrivals(spark: SparkSession, project: Project, source_id: str, folder: str, store: Store,
                  checkpoint: str, *, pattern: str = "*.csv", file_format: str = "csv",
                  other_inputs: Callable[[str], Mapping[str, str | Sequence[str]]] | None = None,
                  period_of: Callable[[str], str] | None = None, dashboard: Dashboard | None = None,
                  rules: Sequence[Rule] = (), run_prefix: str = "STREAM",
                  on_run: Callable[[Outcome], None] | None = None) -> StreamingQuery:
    """Load every file not loaded yet and stop. Start it again to take in later arrivals.

    ``other_inputs`` gives the files of the project's other sources for an arrived file,
    ``period_of`` the period a ``replace_period`` file restates.
    """
    # Only the path column is asked for, so file contents are not read here.
    arrivals = (spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("pathGlobFilter", pattern)
                .option("maxFilesPerTrigger", 1).load(folder).select("path"))

    def take_in(batch: DataFrame, batch_id: int) -> None:
        found = [row["path"] for row in batch.collect()]  # one path: maxFilesPerTrigger is 1
        if not found:
            return
        [path] = found
        run_id = f"{run_prefix}-{batch_id:08d}"
        inputs = {**(other_inputs(path) if other_inputs else {}), source_id: path}
        periods = {source_id: period_of(path)} if period_of else None
        outcome = run_project(spark, project, inputs, run_id, store, dashboard=dashboard, rules=rules,
                              periods=periods, file_format=file_format)
        if on_run:
            on_run(outcome)
        if not outcome.succeeded:
            raise BlockedBatch(f"{run_id}: {path}: {outcome.error_message}")

    return (arrivals.writeStream.foreachBatch(take_in).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
