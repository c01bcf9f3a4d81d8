"""Recovery archive: active history as Parquet by year and month of the event date."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast.sources.files import path_exists, remove_folder, write_new
from holdfast.spec import Source


def archive_path(root: str, report_id: str) -> str:
    return f"{root.rstrip('/')}/report={report_id}"


def write_archive(history: DataFrame, source: Source, root: str, report_id: str) -> str:
    """Write active rows; the rebalance lets Spark split a month that holds most rows."""
    date = F.col(source.period_column)
    (history.where("is_active")
     .withColumn("year", F.year(date)).withColumn("month", F.month(date))
     .hint("rebalance", "year", "month")
     .write.mode("overwrite").partitionBy("year", "month").parquet(archive_path(root, report_id)))
    return archive_path(root, report_id)


def read_archive(spark: SparkSession, source: Source, root: str, report_id: str) -> DataFrame:
    """History as archived. An archive of nothing is empty; a missing archive is an error."""
    path = archive_path(root, report_id)
    if not path_exists(spark, path):
        raise FileNotFoundError(f"there is no archive at {path}")
    schema = source.history_schema()
    return spark.read.schema(schema).parquet(path).select(*schema.names)


class CopyMismatch(RuntimeError):
    """A copy does not hold what its origin holds."""


def reconciled_copy(frame: DataFrame, path: str, totals: Sequence[str]) -> DataFrame:
    """Copy a trusted table and mark the copy complete once its counts and totals agree.

    The copy is read back from where it was written. The mark is a file beside the data,
    so a reader can tell a finished copy from a broken one.
    """
    spark = frame.sparkSession
    remove_folder(spark, path)
    frame.write.mode("overwrite").parquet(f"{path}/data")
    copied = spark.read.schema(frame.schema).parquet(f"{path}/data")

    def facts(side: DataFrame) -> DataFrame:
        return side.agg(F.count("*").alias("row_count"), *[F.coalesce(F.sum(t), F.lit(0)).alias(t) for t in totals])

    want, got = facts(frame).first(), facts(copied).first()
    if want != got:
        raise CopyMismatch(f"{path}: copied {got.asDict()}, expected {want.asDict()}")
    write_new(spark, f"{path}/_COMPLETE", str(got["row_count"]))
    return copied
