"""Exact dedup over content-defined chunk recipes, in DataFrame operations only.

A text without white space is cut after the first punctuation mark past ``min_chars``, at the latest at
``max_chars``, so equal stretches of different documents give equal chunks. Chunks are deduplicated by content and
the 64-bit identifiers are verified there: a hash with two contents is replaced by a longer identifier. Documents are
then told apart by their ordered identifier lists alone; no whole text is shuffled, and chunk content only once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.llm.scratch import stored
from holdfast.scale import lookup

# Characters that do not count when texts are compared: [\x20\x09-\x0D].
WHITE_SPACE = " \t\n\x0b\x0c\r"
MIN_CHARS, MAX_CHARS = 256, 1024


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), WHITE_SPACE, "")


def chunks(text: Column, min_chars: int = MIN_CHARS, max_chars: int = MAX_CHARS) -> Column:
    """Ordered chunks of a text; their concatenation is the text, and an empty text has none."""
    cut = rf"(?s).{{{min_chars},{max_chars - 1}}}?\p{{P}}|.{{1,{max_chars}}}"
    return F.regexp_extract_all(text, F.lit(cut), F.lit(0))


def clashing_hashes(pieces: DataFrame, hash_of: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """Hashes (``chunk_hash``) that more than one content of column ``chunk`` has. Content is compared, not digests."""
    distinct = pieces.groupBy(hash_of(F.col("chunk")).alias("chunk_hash"), "chunk").agg(F.lit(1).alias("one"))
    return distinct.groupBy("chunk_hash").agg(F.count("*").alias("contents")).where("contents > 1").select("chunk_hash")


def recipes(docs: DataFrame, min_chars: int = MIN_CHARS, max_chars: int = MAX_CHARS,
            hash_of: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """``doc_id, n_chars, text_sha256, recipe`` per row; ``recipe`` is the list of verified chunk identifiers."""
    text = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    plain = text.withColumn("plain", normalised(F.col("text")))
    pieces = plain.select(F.explode(chunks(F.col("plain"), min_chars, max_chars)).alias("chunk"))
    clashes = stored(clashing_hashes(pieces, hash_of), "clashes")
    identifier = lambda c: hash_of(c).cast("string")
    if not clashes.isEmpty():
        # A hash with two contents identifies none of them: those chunks are named by a scalar list lookup.
        known = clashes.agg(F.array_sort(F.collect_set("chunk_hash")).alias("all")).scalar()
        plain = plain.withColumn("clashes", known)
        identifier = lambda c: F.when(
            F.array_contains("clashes", hash_of(c)), F.concat(F.lit("sha "), F.sha2(c, 256), F.lit(" "), F.length(c)),
        ).otherwise(hash_of(c).cast("string"))
    return plain.select(
        "doc_id", F.char_length("text").cast("long").alias("n_chars"), F.sha2("plain", 256).alias("text_sha256"),
        F.transform(chunks(F.col("plain"), min_chars, max_chars), identifier).alias("recipe"))


def exact_duplicates(docs: DataFrame, **options) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Of equal texts the row with most code points in the original stays, then the smallest ``doc_id`` (NULL last).
    A NULL text is an empty one; empty texts equal each other. Repeated rows of one ``doc_id`` and one text are the
    same document: all of them are kept or none. An empty table gives no rows; other columns are not read.
    """
    rows = stored(recipes(docs, **options), "recipes")
    # Two steps of whole numbers, both summed before the shuffle: a group may hold a third of all rows.
    sized = rows.groupBy("recipe", "n_chars").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n"))
    groups = (sized.groupBy("recipe")
              .agg(F.sum("n").alias("group_size"), F.max("n_chars").alias("keep_chars"),
                   F.max_by("first_id", "n_chars").alias("keep_id")).where("group_size > 1"))
    found = lookup(rows.withColumn("row", F.monotonically_increasing_id()), stored(groups, "copies"), ["recipe"],
                   ["keep_id", "keep_chars", "group_size"], size="group_size", row_id="row")
    alone = F.col("group_size").isNull()
    return found.select(
        "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | ((F.col("n_chars") == F.col("keep_chars")) & F.col("doc_id").eqNullSafe(F.col("keep_id")))).alias("kept"),
        "text_sha256")
