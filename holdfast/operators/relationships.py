"""Checks across sources: unmatched keys and cardinality.

Keys are counted before they are joined, so the join sees each key once however many
rows share it.
"""

from __future__ import annotations

from collections.abc import Sequence

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.operators.quality import BLOCK, PASS, WARNING, as_rows, check
from holdfast.scale import HOT_SHARE, settle, with_one_row
from holdfast.spec import Relationship


def _keyed(frame: DataFrame, keys: Sequence[str]) -> DataFrame:
    return (frame.select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)])
            .groupBy(*[f"k{i}" for i in range(len(keys))]).agg(F.count("*").alias("key_rows")))


def orphan_keys(left: DataFrame, right: DataFrame, left_keys: Sequence[str], right_keys: Sequence[str]) -> DataFrame:
    """Left keys without a partner and how many rows carry each. NULL matches nothing."""
    names = [f"k{i}" for i in range(len(left_keys))]
    partners = _keyed(right, right_keys).select(*names)
    found = _keyed(left, left_keys).join(partners, names, "left_anti")
    return found.select(*[F.col(n).alias(k) for n, k in zip(names, left_keys)], "key_rows")


def repeated_key_values(frame: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key values held by more than one row; NULLs count as one value."""
    return _keyed(frame, keys).where("key_rows > 1").select(
        *[F.col(f"k{i}").alias(k) for i, k in enumerate(keys)], "key_rows")


# Parts of a hot key per task of its share: hashing puts some tasks in charge of more parts than others.
PARTS_PER_TASK = 8


class CardinalityError(RuntimeError):
    """The data breaks the cardinality that a relationship declares."""


def related_rows(left: DataFrame, right: DataFrame, on: Sequence[tuple[str, str]], columns: Sequence[str], *, row_id: Sequence[str],
                 cardinality: str = "many_to_one", how: str = "left", hot_share: int = HOT_SHARE) -> DataFrame:
    """Rows of ``left`` with ``columns`` of their partners, however many rows share a key.

    Keys with more than one in ``hot_share`` of the left rows, of which there are fewer than ``hot_share``, are salted:
    their rows are dealt by ``row_id`` over several parts for each shuffle partition of their share, and their partners are
    copied to each part. ``row_id`` tells the rows of a key apart. A declared cardinality that the data breaks is an
    error. ``how`` is ``left`` or ``inner``; a NULL key matches nothing.
    """
    if how not in ("left", "inner"):
        raise ValueError(f"a salted join keeps left rows or partners of left rows; {how!r} would copy right ones")
    left_keys, right_keys = [l for l, _ in on], [r for _, r in on]
    for side, frame, keys, single in (("right", right, right_keys, cardinality in ("many_to_one", "one_to_one")),
                                      ("left", left, left_keys, cardinality in ("one_to_many", "one_to_one"))):
        has_key = reduce(and_, [F.col(k).isNotNull() for k in keys])
        if single and not repeated_key_values(frame.where(has_key), keys).isEmpty():
            raise CardinalityError(f"{side} keys {keys} repeat, against {cardinality}")
    has_key = reduce(and_, [F.col(k).isNotNull() for k in left_keys])
    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counted = settle(left.where(has_key).groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(left_keys)]).agg(F.count("*").alias("_n")))
    shares = with_one_row(counted, counted.agg(F.sum("_n").alias("_all")))
    hot = shares.where(F.col("_n") * hot_share > F.col("_all")).select(
        *[f"_k{i}" for i in range(len(on))], F.greatest(F.lit(1), F.ceil(F.col("_n") * PARTS_PER_TASK * parts / F.col("_all"))).cast("int").alias("_parts"))

    def with_parts(frame: DataFrame, keys: Sequence[str]) -> DataFrame:
        same = reduce(and_, [F.col(k) == F.col(f"_k{i}") for i, k in enumerate(keys)])
        return frame.join(F.broadcast(hot), same, "left").drop(*[f"_k{i}" for i in range(len(on))])

    salted = with_parts(left.where(has_key), left_keys).withColumn(
        "_salt", F.when(F.col("_parts").isNotNull(), F.pmod(F.xxhash64(*row_id), F.col("_parts"))).otherwise(0).cast("int")).drop("_parts")
    partners = right.select(*[F.col(r).alias(f"_right_{r}") for r in right_keys], *columns)
    copied = with_parts(partners, [f"_right_{r}" for r in right_keys]).withColumn(
        "_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    matched = reduce(and_, [F.col(l) == F.col(f"_right_{r}") for l, r in on] + [F.col("_salt") == F.col("_part")])
    joined = salted.join(copied, matched, how).select(*left.columns, *columns)
    return joined.unionByName(left.where(~has_key), allowMissingColumns=True) if how == "left" else joined


def relationship_report(left: DataFrame, right: DataFrame, link: Relationship) -> DataFrame:
    """Check rows of one relationship over this run's clean rows."""
    spark, rid = left.sparkSession, f"relationship.{link.relationship_id}"
    if not link.confirmed:
        return as_rows(spark.range(1), [check(
            f"{rid}.approval", "relationship", "block", F.lit(BLOCK), "nobody has confirmed what this link means")])
    facts = orphan_keys(left, right, link.left_keys, link.right_keys).agg(
        F.coalesce(F.sum("key_rows"), F.lit(0)).alias("unmatched"))
    checks = []

    def single(side: str, frame: DataFrame, keys: Sequence[str]) -> None:
        nonlocal facts
        counted = repeated_key_values(frame, keys).agg(F.count("*").alias(f"{side}_repeated"))
        facts = with_one_row(facts, counted)
        repeated = F.col(f"{side}_repeated")
        checks.append(check(
            f"{rid}.{side}_cardinality", "relationship", "block",
            F.when(repeated > 0, F.lit(BLOCK)).otherwise(F.lit(PASS)),
            F.concat(repeated.cast("string"), F.lit(f" {side} keys break {link.cardinality}")),
            expected="0", actual=repeated))

    if link.cardinality in ("many_to_one", "one_to_one"):
        single("right", right, link.right_keys)
    if link.cardinality == "one_to_one":
        single("left", left, link.left_keys)
    unmatched = F.col("unmatched")
    checks.append(check(
        f"{rid}.match", "relationship", "block" if link.require_match else "warning",
        F.when(unmatched > 0, F.lit(BLOCK if link.require_match else WARNING)).otherwise(F.lit(PASS)),
        F.concat(unmatched.cast("string"), F.lit(f" {link.left} rows have no {link.right} row")),
        expected="0", actual=unmatched))
    return as_rows(facts, checks)
