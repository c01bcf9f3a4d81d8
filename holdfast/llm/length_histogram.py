"""Exact token counts as a histogram of encoded lengths.

Documents are encoded once and counted by length; everything about context limits follows from the histogram, whose
size is the number of different lengths. Sums over lengths are taken in two levels, blocks of ``BLOCK`` lengths and
lengths of a block, so the only total order is over blocks.
"""

from __future__ import annotations

import base64

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from holdfast.llm.scratch import once, small_batches, stored

RANKS = "byte_bpe_50k.tiktoken"
BLOCK = 1024


def _encoding(name: str):
    import public_tokenizers
    import tiktoken

    with open(name if "/" in name else public_tokenizers.path(name), "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def encoded_length(text: Column, ranks: str = RANKS) -> Column:
    """Number of tokens of a text; NULL and empty have none, special tokens are ordinary text."""
    def count(texts: pd.Series) -> pd.Series:
        encode = once(("ranks", ranks), lambda: _encoding(ranks)).encode_ordinary
        return pd.Series([len(encode(t)) if t else 0 for t in texts], dtype="int64")

    return F.pandas_udf(count, LongType())(text)


def histogram(docs: DataFrame, ranks: str = RANKS) -> DataFrame:
    """``length, docs``: how many documents have each encoded length. Repeated rows count each."""
    small_batches(docs.sparkSession)
    counts = docs.select(encoded_length(F.col("text"), ranks).alias("length")).groupBy("length")
    return stored(counts.agg(F.count("*").alias("docs")), "lengths")


def running(counts: DataFrame) -> DataFrame:
    """``length, docs`` and for each length ``docs_to, tokens_to`` (documents up to it and their tokens), ``docs_over,
    tokens_over`` (suffix sums over the longer ones). No lengths give no rows."""
    blocks = counts.withColumn("block", F.floor(F.col("length") / BLOCK))
    tokens = F.col("length") * F.col("docs")
    sums = stored(blocks.groupBy("block").agg(F.sum("docs").alias("block_docs"), F.sum(tokens).alias("block_tokens")), "blocks")
    # One row per block of lengths up to the longest document: few, whatever the number of documents.
    after = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0))
    bases = sums.select(
        "block", *[zero(F.sum(f"block_{x}").over(w)).alias(f"{x}_{side}")
                   for x in ("docs", "tokens") for side, w in (("before", before), ("after", after))])
    to = Window.partitionBy("block").orderBy("length").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    over = Window.partitionBy("block").orderBy(F.col("length").desc()).rowsBetween(Window.unboundedPreceding, -1)
    return blocks.join(bases, "block").select(
        "length", "docs",
        (F.sum("docs").over(to) + F.col("docs_before")).alias("docs_to"),
        (F.sum(tokens).over(to) + F.col("tokens_before")).alias("tokens_to"),
        (zero(F.sum("docs").over(over)) + F.col("docs_after")).alias("docs_over"),
        (zero(F.sum(tokens).over(over)) + F.col("tokens_after")).alias("tokens_over"))


def context_limits(counts: DataFrame) -> DataFrame:
    """What each length would mean as a context limit: ``context_limit, docs, docs_to, tokens_to, docs_over,
    tokens_over, kept_tokens`` (all tokens after truncation) and ``quantile`` (share of documents that fit).

    Between two lengths ``kept_tokens`` is linear, so these rows answer every limit: see ``at_limit``.
    """
    return running(counts).select(
        F.col("length").alias("context_limit"), "docs", "docs_to", "tokens_to", "docs_over", "tokens_over",
        (F.col("tokens_to") + F.col("length") * F.col("docs_over")).alias("kept_tokens"),
        (F.col("docs_to") / (F.col("docs_to") + F.col("docs_over"))).alias("quantile"))


def at_limit(counts: DataFrame, limit: int) -> DataFrame:
    """One row for any limit: ``context_limit, docs_over, kept_tokens, lost_tokens``; zeros for an empty table."""
    over = F.greatest(F.col("length") - limit, F.lit(0)) * F.col("docs")
    return counts.agg(
        F.lit(limit).cast("long").alias("context_limit"),
        F.coalesce(F.sum(F.when(F.col("length") > limit, F.col("docs"))), F.lit(0)).alias("docs_over"),
        F.coalesce(F.sum(F.least("length", F.lit(limit)) * F.col("docs")), F.lit(0)).alias("kept_tokens"),
        F.coalesce(F.sum(over), F.lit(0)).alias("lost_tokens"))


def quantiles(counts: DataFrame, shares: list[float]) -> DataFrame:
    """``share, length``: the least length that at least that share of the documents does not exceed."""
    limits = context_limits(counts)
    return limits.sparkSession.createDataFrame([(s,) for s in shares], "share double").join(
        F.broadcast(limits.agg(*[F.min(F.when(F.col("quantile") >= s, F.col("context_limit"))).alias(f"q{i}") for i, s in enumerate(shares)])
                    .select(F.explode(F.array(*[F.struct(F.lit(s).alias("share"), F.col(f"q{i}").alias("length"))
                                                for i, s in enumerate(shares)])).alias("q")).select("q.*")), "share", "left")
