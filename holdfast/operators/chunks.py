"""Audit of staged rows by ranges: a digest per fixed number of rows, and a tree of digests over the ranges.

Two extracts of a file are compared from the root down, so only ranges below differing nodes are looked at.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROWS_PER_CHUNK = 10_000
FAN_OUT = 256


def row_text(columns: Sequence[str]) -> Column:
    """A row's cells, told apart by a control character; a missing cell is no empty one."""
    return F.concat_ws("\x1f", *[F.coalesce(F.col(c), F.lit("\x00")) for c in columns])


def _ordered(number: str, digest: str) -> Column:
    return F.sha2(F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct(number, digest))), lambda r: r[digest])), 256)


def chunk_audit(rows: DataFrame, columns: Sequence[str], rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """Per file and range of row numbers: first and last row, rows, and the SHA-256 over the rows' own in order.

    Data rows are numbered from 1; range k holds rows k * n + 1 to (k + 1) * n. A range never has more rows than that, so
    no task holds more than one range's digests however large or hot a file is.
    """
    numbered = rows.select("_source_file", F.col("_source_row_number").alias("row_number"), F.sha2(row_text(columns), 256).alias("digest"))
    chunk = F.floor((F.col("row_number") - 1) / rows_per_chunk).cast("long").alias("chunk")
    return numbered.groupBy("_source_file", chunk).agg(
        F.min("row_number").alias("first_row"), F.max("row_number").alias("last_row"), F.count("*").alias("rows_staged"),
        _ordered("row_number", "digest").alias("chunk_sha256"))


def hash_tree(chunks: DataFrame, fan_out: int = FAN_OUT) -> list[DataFrame]:
    """Levels of digests ``_source_file, node, digest`` from the ranges up to one node per file."""
    levels = [chunks.select("_source_file", F.col("chunk").alias("node"), F.col("chunk_sha256").alias("digest"))]
    most = chunks.agg(F.max("chunk").alias("n")).first()["n"] or 0
    while most > 0:
        below = levels[-1].withColumnRenamed("node", "child").withColumn("node", F.floor(F.col("child") / fan_out).cast("long"))
        levels.append(below.groupBy("_source_file", "node").agg(_ordered("child", "digest").alias("digest")))
        most //= fan_out
    return levels


def changed_chunks(before: Sequence[DataFrame], after: Sequence[DataFrame], fan_out: int = FAN_OUT) -> DataFrame:
    """Ranges ``_source_file, chunk`` whose digests differ, or that only one extract has, with both digests.

    ``before`` and ``after`` are hash trees. A tree with fewer levels differs from the root of the other one down.
    """
    suspects = None
    for level in reversed(range(max(len(before), len(after)))):
        sides = []
        for tree, name in ((before, "before_sha256"), (after, "after_sha256")):
            nodes = tree[level] if level < len(tree) else tree[0].limit(0)
            if suspects is not None:
                nodes = nodes.withColumn("parent", F.floor(F.col("node") / fan_out).cast("long")).join(
                    suspects.withColumnRenamed("node", "parent"), ["_source_file", "parent"], "left_semi").drop("parent")
            sides.append(nodes.withColumnRenamed("digest", name))
        both = sides[0].join(sides[1], ["_source_file", "node"], "full_outer")
        differing = both.where(~F.col("before_sha256").eqNullSafe(F.col("after_sha256")))
        suspects = differing.select("_source_file", "node")
    return differing.withColumnRenamed("node", "chunk")
