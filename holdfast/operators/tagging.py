"""Typing, fingerprinting and tagging of staged rows.

A row ends up ``accepted``, ``rejected`` (a value cannot be trusted) or ``filtered`` (an
exact copy of an earlier row), with one reason. The three sets are disjoint and complete.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.functions.values import fingerprint, is_blank, typed_columns
from holdfast.scale import BROADCAST_ROWS, HOT_SHARE, lookup, packed, settle, unpacked
from holdfast.spec import CONTENT_HASH, EXTRA_CELLS, KEY_HASH, LINEAGE_COLUMNS, ROW_ORDER, Source, is_numeric

ACCEPTED, REJECTED, FILTERED = "accepted", "rejected", "filtered"

# Reason codes and the text stored with each.
NEGATIVE_MEASURE = "NEGATIVE_MEASURE"
UNPARSEABLE_NUMBER = "UNPARSEABLE_NUMBER"
UNPARSEABLE_DATE = "UNPARSEABLE_DATE"
UNPARSEABLE_VALUE = "UNPARSEABLE_VALUE"
EXACT_DUPLICATE = "EXACT_DUPLICATE"
SURPLUS_CELLS = "SURPLUS_CELLS"
REASON_TEXT = {
    NEGATIVE_MEASURE: "A quantity was negative, which this report does not allow.",
    UNPARSEABLE_NUMBER: "A value that should be a number could not be read as one.",
    UNPARSEABLE_DATE: "A value that should be a date could not be read as one.",
    UNPARSEABLE_VALUE: "A value did not match the type this column is configured to hold.",
    EXACT_DUPLICATE: "An identical copy of this record appeared in the same file.",
    # Own.
    SURPLUS_CELLS: "The line has more cells than the header, so its values may belong to other columns.",
}


def blank_key(source: Source, text=F.col) -> Column:
    return reduce(lambda a, b: a | b, [is_blank(text(name)) for name in source.key])


def reject_reason(source: Source, text: dict[str, Column], typed: dict[str, Column]) -> Column:
    """First rule a row breaks: unreadable values in column order, then negative measures."""
    rules = []
    for name, kind in source.columns.items():
        if kind == "VARCHAR":
            continue
        reason = (UNPARSEABLE_NUMBER if is_numeric(kind)
                  else UNPARSEABLE_DATE if kind == "DATE" else UNPARSEABLE_VALUE)
        rules.append(F.when(~is_blank(text[name]) & typed[name].isNull(), F.lit(reason)))
    rules += [F.when(typed[name] < 0, F.lit(NEGATIVE_MEASURE)) for name in source.non_negative]
    return F.coalesce(*rules, F.lit(None).cast("string"))


def read_rows(staged: DataFrame, source: Source) -> DataFrame:
    """Type and fingerprint every staged row: a projection, no shuffle.

    Typed columns carry the declared names; the text they came from is kept in ``_raw``.
    """
    text = {name: F.col(name) for name in source.names}
    extra = [EXTRA_CELLS] if EXTRA_CELLS in staged.columns else []
    with_typed = staged.select(
        F.struct(*[F.col(n) for n in source.names]).alias("_raw"),
        *[value.alias(name) for name, value in typed_columns(source, text).items()],
        *LINEAGE_COLUMNS, ROW_ORDER, *extra)
    surplus = [F.when(F.col(EXTRA_CELLS).isNotNull(), F.lit(SURPLUS_CELLS))] if extra else []
    raw = {name: F.col(f"_raw.{name}") for name in source.names}
    typed = {name: F.col(name) for name in source.names}
    return with_typed.select(
        "*",
        fingerprint(typed[n] for n in source.key).alias(KEY_HASH),
        fingerprint(typed[n] for n in source.names).alias(CONTENT_HASH),
        F.coalesce(*surplus, reject_reason(source, raw, typed)).alias("_reject_reason"),
        blank_key(source, lambda n: raw[n]).alias("_blank_key"))


def find_copies(rows: DataFrame) -> DataFrame:
    """Rows that occur more than once, once per group: the first position and the count.

    Only two hashes and a position are shuffled, and copies are merged before the shuffle.
    """
    hashes = (KEY_HASH, CONTENT_HASH)
    copies = (packed(rows, hashes).groupBy(*hashes)
              .agg(F.min(ROW_ORDER).alias("_first_order"), F.count("*").alias("copies"))
              .where("copies > 1"))
    return unpacked(copies, hashes)


def repeated_keys(rows: DataFrame) -> DataFrame:
    """Keys that occur more than once, with the number of different contents of each.

    More than one content is a conflict. Where there is none, the key alone identifies
    the copies, so one pass answers both questions.
    """
    contents = rows.groupBy(KEY_HASH, CONTENT_HASH).agg(
        F.min(ROW_ORDER).alias("_first_order"), F.count("*").alias("copies"))
    return (contents.groupBy(KEY_HASH)
            .agg(F.count("*").alias("variants"), F.sum("copies").alias("copies"),
                 F.min("_first_order").alias("_first_order"))
            .where("copies > 1"))


def conflicting_keys(rows: DataFrame) -> DataFrame:
    """Keys whose rows disagree; counted over all raw rows, also ones rejected later."""
    return repeated_keys(rows).where("variants > 1").select(KEY_HASH, "variants", "copies")


def tag(rows: DataFrame, copies: DataFrame, known_copies: int | None = None, *,
        on: tuple[str, ...] = (KEY_HASH, CONTENT_HASH),
        broadcast_rows: int = BROADCAST_ROWS, hot_share: int = HOT_SHARE) -> DataFrame:
    """Give every row its ``_status`` and ``_reason``. The earliest copy of a row is the one kept."""
    hashes = (KEY_HASH, CONTENT_HASH)
    placed = lookup(packed(rows, hashes), packed(copies, on), on, ("_first_order",), size="copies", row_id=ROW_ORDER,
                    known_groups=known_copies, broadcast_rows=broadcast_rows, hot_share=hot_share)
    placed = unpacked(placed, hashes)
    is_copy = F.coalesce(F.col(ROW_ORDER) > F.col("_first_order"), F.lit(False))
    return placed.select(
        "*",
        F.when(F.col("_reject_reason").isNotNull(), F.lit(REJECTED))
        .when(is_copy, F.lit(FILTERED)).otherwise(F.lit(ACCEPTED)).alias("_status"),
        F.coalesce("_reject_reason", F.when(is_copy, F.lit(EXACT_DUPLICATE))).alias("_reason"),
    ).drop("_first_order", "_reject_reason")


def tag_counted(rows: DataFrame) -> DataFrame:
    """Tag rows after counting the copied groups, so that a small set of them is broadcast."""
    copies = settle(find_copies(rows))
    return tag(rows, copies, copies.count())


def clean_rows(tagged: DataFrame, source: Source) -> DataFrame:
    """Accepted rows with a complete key: typed columns, hashes and their origin."""
    return tagged.where((F.col("_status") == ACCEPTED) & ~F.col("_blank_key")).select(
        *source.names, KEY_HASH, CONTENT_HASH, "_run_id", "_source_id", "_source_file", "_source_row_number")


def quarantine_rows(tagged: DataFrame, source: Source) -> DataFrame:
    """Rejected and filtered rows with their reason and their raw text as sorted-key JSON."""
    messages = F.create_map(*[F.lit(part) for pair in REASON_TEXT.items() for part in pair])
    values, as_json = [F.col(f"_raw.{n}").alias(n) for n in sorted(source.names)], {"ignoreNullFields": "false"}
    raw_json = F.to_json(F.struct(*values), as_json)
    if EXTRA_CELLS in tagged.columns:
        with_line = F.to_json(F.struct(F.col(EXTRA_CELLS).alias("_line"), *values), as_json)
        raw_json = F.when(F.col(EXTRA_CELLS).isNull(), raw_json).otherwise(with_line)
    return tagged.where(F.col("_status") != ACCEPTED).select(
        F.col("_run_id").alias("run_id"), F.col("_report_id").alias("report_id"),
        F.col("_source_id").alias("source_id"), F.col("_source_sheet").alias("source_sheet"),
        F.col("_source_row_number").alias("source_row"),
        F.lit(None).cast("string").alias(KEY_HASH),
        F.col("_reason").alias("reason_code"), messages[F.col("_reason")].alias("reason_message"),
        raw_json.alias("raw_values"), F.lit("OPEN").alias("resolution_status"))


def reason_summary(quarantine: DataFrame) -> DataFrame:
    return (quarantine.groupBy("reason_code").agg(F.count("*").alias("row_count"))
            .orderBy("reason_code"))
