"""Reshaping of spreadsheet layouts and versioned dimensions."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from holdfast.scale import packed, unpacked
from holdfast.spec import CONTENT_HASH, KEY_HASH, ROW_ORDER

# Fixed value: the header of a week column.
WEEK_COLUMN = re.compile(r"^\d{4}-W\d{2}$")
# Rows one task fills at a time.
SEGMENT_ROWS = 100_000


def fill_down(rows: DataFrame, columns: Sequence[str], *, group: str = "_source_file", order: str = ROW_ORDER,
              segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """Repeat the last value above into empty cells of approved columns, file by file.

    A file is cut into segments of consecutive rows. Each segment is filled on its own and
    takes what is still empty from the last value of the segments above it, so a file of
    any length is spread over the cluster.
    """
    cut = rows.withColumn("_segment", F.floor(F.col(order) / segment_rows))
    above = Window.partitionBy(group).orderBy("_segment").rowsBetween(Window.unboundedPreceding, -1)
    last = cut.groupBy(group, "_segment").agg(*[
        F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(f"_last_{c}") for c in columns])
    carried = last.select(group, "_segment", *[F.last(f"_last_{c}", ignorenulls=True).over(above).alias(f"_above_{c}")
                                               for c in columns])
    down = Window.partitionBy(group, "_segment").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = cut.withColumns({f"_inside_{c}": F.last(c, ignorenulls=True).over(down) for c in columns})
    filled = inside.join(carried, [group, "_segment"], "left")
    return filled.select(*[F.coalesce(f"_inside_{c}", f"_above_{c}").alias(c) if c in columns else F.col(c)
                           for c in rows.columns])


def weeks_to_rows(wide: DataFrame, keys: Sequence[str], category: str, roles: Mapping[str, str],
                  tolerance: float, scale: int) -> DataFrame:
    """One row per key and week from three category rows with a column per week.

    ``roles`` maps ``quantity``, ``defects`` and ``reported`` to the category that holds each.
    Weeks are found by their header. A key without exactly one row of each category is
    marked malformed, and zero quantity has no rate.
    """
    weeks = [c for c in wide.columns if WEEK_COLUMN.fullmatch(c)]
    long = wide.unpivot([*keys, category], weeks, "week", "cell")

    def cell(role: str) -> Column:
        return F.max(F.when(F.col(category) == roles[role], F.col("cell"))).alias(role)

    def seen(role: str) -> Column:
        return F.count_if(F.col(category) == roles[role]) == 1

    grouped = long.groupBy(*keys, "week").agg(
        *[cell(r) for r in ("quantity", "defects", "reported")],
        (seen("quantity") & seen("defects") & seen("reported") & (F.count("*") == 3)).alias("well_formed"))
    calculated = F.when(F.col("quantity") != 0, F.col("defects").cast("double") / F.col("quantity").cast("double") * scale)
    agrees = F.abs(F.col("calculated") - F.col("reported").cast("double")) <= tolerance
    return grouped.withColumn("calculated", calculated).withColumn("agrees", agrees)


def version_rows(versions: DataFrame | None, clean: DataFrame, columns: Sequence[str], effective: str) -> DataFrame:
    """Type-2 dimension: a changed row closes its current version and opens another.

    Current versions meet the batch in one full join, one row per key; closed ones pass through.
    """
    since = F.lit(effective).cast("date")
    names = [*columns, KEY_HASH, CONTENT_HASH]
    fresh = clean.select(*names, since.alias("valid_from"), F.lit(None).cast("date").alias("valid_to"),
                         F.lit(True).alias("is_current"))
    if versions is None:
        return fresh
    current = versions.where("is_current")
    both = (current.select(F.col(KEY_HASH).alias("_key"), F.struct(*current.columns).alias("_old"))
            .join(clean.select(F.col(KEY_HASH).alias("_key"), F.struct(*names).alias("_new")), "_key", "full_outer"))
    changed = F.coalesce(F.col(f"_old.{CONTENT_HASH}") != F.col(f"_new.{CONTENT_HASH}"), F.lit(False))
    known = F.struct(*[F.col(f"_old.{n}").alias(n) for n in names], F.col("_old.valid_from").alias("valid_from"),
                     F.when(changed, since).otherwise(F.col("_old.valid_to")).alias("valid_to"), (~changed).alias("is_current"))
    opened = F.struct(*[F.col(f"_new.{n}").alias(n) for n in names], since.alias("valid_from"),
                      F.lit(None).cast("date").alias("valid_to"), F.lit(True).alias("is_current"))
    rows = F.array_compact(F.array(F.when(F.col("_old").isNotNull(), known),
                                   F.when(changed | F.col("_old").isNull(), opened)))
    return versions.where(~F.col("is_current")).unionByName(both.select(F.inline(rows)))


def rebuilt_versions(versions: DataFrame, changes: DataFrame, columns: Sequence[str], effective: str, *, closes: bool = False) -> DataFrame:
    """Type-2 dimension after changes that may be older than what is stored.

    Old and new change points of a key are put in order and versions are read off anew: each lasts until the next point. A
    late change therefore splits the version it falls into and leaves the later ones as they are; on the same day the
    newer report counts. Points that change nothing are dropped. With ``closes`` the batch shows every key that there
    still is: keys it lacks end on its day, unless they are known to change later.
    """
    since, names, hashes = F.lit(effective).cast("date"), [*columns, KEY_HASH, CONTENT_HASH], (KEY_HASH, CONTENT_HASH)
    versions, changes = packed(versions, hashes), packed(changes, hashes)
    nothing = [F.lit(None).cast(versions.schema[n].dataType).alias(n) if n != KEY_HASH else F.col(n) for n in names]

    def points(frame: DataFrame, at: Column, content: list, rank: int) -> DataFrame:
        return frame.select(*content, at.alias("valid_from"), F.lit(rank).alias("_rank"))

    # Rank settles points of one day: an end is overruled by any content, stored content by the batch.
    told = points(versions, F.col("valid_from"), names, 1).unionByName(
        points(versions.where("valid_to IS NOT NULL"), F.col("valid_to"), nothing, 0)).unionByName(points(changes, since, names, 2))
    if closes:
        gone = versions.select(KEY_HASH, "valid_from").groupBy(KEY_HASH).agg(F.max("valid_from").alias("_last")).where(F.col("_last") < since)
        gone = gone.join(changes.select(KEY_HASH), KEY_HASH, "left_anti")
        told = told.unionByName(points(gone, since, nothing, 0))
    by_day = told.groupBy(KEY_HASH, "valid_from").agg(F.max_by(F.struct(*names), "_rank").alias("_row"))
    in_order = Window.partitionBy(KEY_HASH).orderBy("valid_from")
    content = F.col(f"_row.{CONTENT_HASH}")
    changed = by_day.withColumn("_before", F.lag(content).over(in_order)).where(~content.eqNullSafe(F.col("_before")))
    lasting = changed.withColumn("valid_to", F.lead("valid_from").over(in_order)).where(content.isNotNull())
    return unpacked(lasting.select(*[F.col(f"_row.{n}").alias(n) for n in names], "valid_from", "valid_to",
                                   F.col("valid_to").isNull().alias("is_current")), hashes)
