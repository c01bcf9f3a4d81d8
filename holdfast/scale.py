"""Building blocks that keep plans even when one key, or one total order, is very large."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# A group with more than one in HOT_SHARE of the counted rows is hot. By arithmetic there
# are fewer than HOT_SHARE such groups, whatever the data, so they may be broadcast.
HOT_SHARE = 1000
# Largest number of narrow rows (two hashes and two numbers, about 100 bytes) sent to every executor.
BROADCAST_ROWS = 250_000


def checkpoint_folder(spark: SparkSession) -> str:
    """Shared folder for checkpoints: the cluster's own setting, a local one only in local mode."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", "")
    if not configured:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        configured = tempfile.mkdtemp(prefix="holdfast-")
    context.setCheckpointDir(configured)
    return context.getCheckpointDir()


def settle(frame: DataFrame) -> DataFrame:
    """Write a frame once into the checkpoint folder and read it from there afterwards, column by column."""
    path = f"{checkpoint_folder(frame.sparkSession).rstrip('/')}/settled-{uuid.uuid4().hex}"
    frame.write.option("compression", "zstd").parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def packed(frame: DataFrame, hashes: Sequence[str]) -> DataFrame:
    """Columns of hexadecimal hashes as 16 bytes instead of 32 characters, which shuffles do not compress."""
    return frame.withColumns({name: F.unhex(name) for name in hashes})


def unpacked(frame: DataFrame, hashes: Sequence[str]) -> DataFrame:
    """``packed`` columns as they were."""
    return frame.withColumns({name: F.lower(F.hex(name)) for name in hashes})


def with_one_row(frame: DataFrame, row: DataFrame) -> DataFrame:
    """Attach the columns of a one-row aggregate to every row, as one scalar subquery.

    A filter on an attached value can reach the scan, which a join with one row prevents.
    """
    if len(row.columns) == 1:
        return frame.withColumn(row.columns[0], row.scalar())
    packed = row.select(F.struct(*row.columns)).scalar()
    return frame.withColumn("_one_row", packed).select("*", "_one_row.*").drop("_one_row")


def lookup(rows: DataFrame, groups: DataFrame, on: Sequence[str], facts: Sequence[str], *,
           size: str, row_id: str, known_groups: int | None = None,
           broadcast_rows: int = BROADCAST_ROWS, hot_share: int = HOT_SHARE) -> DataFrame:
    """Left join ``rows`` to facts kept once per group, with no task holding a whole hot group.

    ``groups`` carries the number of rows of each group in ``size``; ``row_id`` is distinct
    per row. A known, small number of groups is broadcast and ``rows`` is not shuffled at
    all. Otherwise the few hot groups are broadcast and their rows take part in the
    remaining shuffle under their own id, which spreads them evenly.
    """
    wanted = groups.select(*on, *facts, size)
    if known_groups == 0:
        types = {f.name: f.dataType for f in groups.schema.fields}
        return rows.select("*", *[F.lit(None).cast(types[f]).alias(f) for f in facts])
    if known_groups is not None and known_groups <= broadcast_rows:
        return rows.join(F.broadcast(wanted.drop(size)), list(on), "left")

    counted = with_one_row(wanted, groups.agg(F.sum(size).alias("_all")))
    is_hot = F.col(size) * hot_share > F.col("_all")
    # Never NULL, so that a matched hot group is recognised even when its facts are NULL.
    hot = counted.where(is_hot).select(*on, F.lit(True).alias("_hot"), *[F.col(f).alias(f"_hot_{f}") for f in facts])
    key = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in on])
    cold = counted.where(~is_hot).select(key.alias("_join_key"), *[F.col(f).alias(f"_cold_{f}") for f in facts])
    spread = F.when(F.col("_hot"), F.concat(F.lit("row "), F.col(row_id).cast("string"))).otherwise(key)
    joined = (rows.join(F.broadcast(hot), list(on), "left").withColumn("_join_key", spread)
              .join(cold, "_join_key", "left"))
    return joined.select(
        *[F.col(c) for c in rows.columns],
        *[F.when(F.col("_hot"), F.col(f"_hot_{f}")).otherwise(F.col(f"_cold_{f}")).alias(f) for f in facts])


def running_total(frame: DataFrame, value: str, order: Sequence[Column], name: str) -> DataFrame:
    """Sum of ``value`` over all rows up to and including this one, in a total order.

    Rows are range-partitioned; each range sums its own rows and adds the total of the
    ranges before it. As in a plain window, rows without a value add nothing and the sum
    is NULL until the first value.
    """
    up_to_here = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranges = settle(frame.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    totals = ranges.groupBy("_range").agg(F.sum(value).alias("_range_total"), F.count(value).alias("_range_values"))
    # One row per partition of the range exchange.
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    earlier = [F.coalesce(F.sum(f"_range_{c}").over(before), F.lit(0)).alias(f"_earlier_{c}") for c in ("total", "values")]
    running = F.coalesce(F.sum(value).over(up_to_here), F.lit(0)) + F.col("_earlier_total")
    has_value = F.count(value).over(up_to_here) + F.col("_earlier_values") > 0
    return (ranges.join(F.broadcast(totals.select("_range", *earlier)), "_range")
            .withColumn(name, F.when(has_value, running)).drop("_range", "_earlier_total", "_earlier_values"))
