"""Language identification with language-bitmask n-gram filters.

One Bloom filter serves all languages: its slots hold bitmasks with a bit per language, so one lookup of an n-gram
(the AND of its slots) returns every language that has it. A text's n-grams are looked up together, the bits are
counted per language and the counts corrected for the filter's false positives; the largest share decides.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from holdfast.llm.scratch import once, small_batches, stored

UNKNOWN = "und"
SIZES = (2, 3, 4)
SLOTS = 1 << 20
LOOKUPS = 2
# Documents a language is learned from, about: a uniform sample by hash of larger ones.
SAMPLE_PER_LANGUAGE = 2000
# An n-gram belongs to a language when this share of its sampled documents has it, and two at least.
LEAST_SHARE = 0.02
# Code points handled at once.
SLICE = 1 << 18
FOLDS = 5


@dataclass(frozen=True)
class Filters:
    """``languages`` by falling number of documents; ``slots`` of shape (words of 64 languages, slots)."""

    languages: tuple[str, ...]
    slots: np.ndarray

    def false_positives(self) -> np.ndarray:
        """Chance per language that an n-gram nobody inserted is found."""
        filled = [np.count_nonzero(self.slots[i // 64] >> np.uint64(i % 64) & np.uint64(1)) for i in range(len(self.languages))]
        return (np.array(filled, dtype=float) / self.slots.shape[1]) ** LOOKUPS


def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def grams(text: str) -> np.ndarray:
    """64-bit hashes of the n-grams of letters of a text, in lower case, words parted by one space; none without letters."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    letter = once(("letters",), _letters)[points]
    if not letter.any():
        return np.empty(0, dtype=np.uint64)
    points = np.where(letter, points, 32).astype(np.uint64)
    points = np.concatenate(([32], points, [32])).astype(np.uint64)
    points = points[np.concatenate(([True], (points[1:] != 32) | (points[:-1] != 32)))]
    hashes, rolled = [], points
    for n in range(2, max(SIZES) + 1):
        if len(points) < n:
            break
        rolled = rolled[:-1] * np.uint64(0x100000001B3) + points[n - 1:]
        if n in SIZES:
            mixed = (rolled ^ (rolled >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            hashes.append(mixed ^ (mixed >> np.uint64(32)))
    return np.concatenate(hashes)


def slices(text: str):
    for start in range(0, len(text), SLICE):
        yield text[start:start + SLICE]


def places(hashes: np.ndarray, slots: int) -> list[np.ndarray]:
    """The slots of each n-gram; ``slots`` is a power of two."""
    return [(hashes >> np.uint64(24 * i) & np.uint64(slots - 1)).astype(np.int64) for i in range(LOOKUPS)]


def held_out(doc_id: Column) -> Column:
    """Documents a model must not learn from: crc32 of the id as text, modulo the number of folds, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def learn(docs: DataFrame, slots: int = SLOTS, sample: int = SAMPLE_PER_LANGUAGE) -> Filters:
    """Filters from ``text`` and ``lang`` of a table; rows without either teach nothing.

    About ``sample`` documents of each language are read (all of a smaller language), chosen by hash. The driver gets
    the languages and at most ``slots`` slots per 64 languages, whatever the corpus.
    """
    spark = docs.sparkSession
    small_batches(spark)
    known = docs.where("lang is not null and text is not null").select("doc_id", "lang", "text")
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = tuple(sorted(counts, key=lambda name: (-counts[name], name)))
    words = max(1, -(-len(languages) // 64))
    table = np.zeros((words, slots), dtype=np.uint64)
    if not languages:
        return Filters(languages, table)
    shares = spark.createDataFrame([(name, i, min(1.0, sample / counts[name])) for i, name in enumerate(languages)],
                                   "lang string, number int, share double")
    chance = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / (1 << 30)
    chosen = known.join(F.broadcast(shares), "lang").where(chance < F.col("share")).select("number", "text")

    def count(batches):
        for batch in batches:
            for number, texts in batch.groupby("number").text:
                seen = [np.unique(np.concatenate([grams(part) for part in slices(t)] or [np.empty(0, np.uint64)])) for t in texts]
                values, n = np.unique(np.concatenate(seen), return_counts=True)
                yield pd.DataFrame({"number": np.int32(number), "gram": values.view(np.int64), "docs": n, "rows": 0})
                yield pd.DataFrame({"number": [number], "gram": [0], "docs": [0], "rows": [len(texts)]})

    counted = stored(
        chosen.mapInPandas(count, "number int, gram long, docs long, rows long")
        .groupBy("number", "gram").agg(F.sum("docs").alias("docs"), F.sum("rows").alias("rows")), "grams")
    sizes = counted.groupBy("number").agg(F.sum("rows").alias("all"))
    common = (counted.join(F.broadcast(sizes), "number")
              .where(F.col("docs") >= F.greatest(F.col("all") * LEAST_SHARE, F.least(F.lit(2), F.col("all")))))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("number") % 64)

    def spread(batches):
        for batch in batches:
            for at in places(batch.gram.to_numpy().view(np.uint64), slots):
                yield pd.DataFrame({"slot": at, "word": batch.word, "mask": batch["mask"]})

    filled = (common.select("gram", F.floor(F.col("number") / 64).cast("int").alias("word"), bit.alias("mask"))
              .mapInPandas(spread, "slot long, word int, mask long")
              .groupBy("slot", "word").agg(F.bit_or("mask").alias("mask")).toPandas())
    table[filled.word.to_numpy(), filled.slot.to_numpy()] = filled["mask"].to_numpy().view(np.uint64)
    return Filters(languages, table)


def shares_of(text: str | None, filters: Filters, wrong: np.ndarray) -> np.ndarray | None:
    """Corrected share of the text's n-grams that each language has; ``None`` without letters."""
    total, found = 0, np.zeros(len(filters.languages))
    for part in slices(text or ""):
        hashes = grams(part)
        total += len(hashes)
        first, *others = places(hashes, filters.slots.shape[1])
        for word, row in enumerate(filters.slots):
            masks = row[first]
            for at in others:
                masks &= row[at]
            here = range(64 * word, min(64 * word + 64, len(found)))
            found[here] += [np.count_nonzero(masks & np.uint64(1 << i % 64)) for i in here]
    if not total:
        return None
    return np.clip((found / total - wrong) / np.maximum(1 - wrong, 1e-9), 0, 1)


def judged(spark: SparkSession, filters: Filters) -> Column:
    """A struct ``lang_pred, score`` of column ``text``: its language, and that language's corrected share of its n-grams.

    ``und`` and 0 for NULL, for texts without a letter and if nothing was learned. On ties the language with more
    documents wins, then the first by name. Only the text is looked at.
    """
    small_batches(spark)
    shared = spark.sparkContext.broadcast((filters.languages, filters.slots))

    def classify(texts: pd.Series) -> pd.DataFrame:
        own = Filters(*shared.value)
        wrong = own.false_positives()
        out = []
        for text in texts:
            shares = shares_of(text, own, wrong) if own.languages else None
            out.append((UNKNOWN, 0.0) if shares is None else (own.languages[int(shares.argmax())], float(shares.max())))
        return pd.DataFrame(out, columns=["lang_pred", "score"])

    kind = StructType([StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    return F.pandas_udf(classify, kind)(F.col("text"))


def identify(docs: DataFrame, **options) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` per row, learned from the documents that are not held out.

    A NULL id is not held out. Repeated rows are judged alike; an empty table gives no rows.
    """
    out = held_out(F.col("doc_id"))
    filters = learn(docs.where(~out), **options)
    found = docs.select("doc_id", out.alias("held_out"), judged(docs.sparkSession, filters).alias("judged"))
    return found.select("doc_id", "held_out", "judged.*")


def known_languages(docs: DataFrame, least_score: float) -> DataFrame:
    """The rows of ``docs`` in a language that was learned from it, with a score of ``least_score`` or more.

    Every labelled row may teach. Rows without a letter go. If no row has a label nothing is known of any language, and
    all rows with a letter stay. A label ``und`` is a language like others. Repeated rows are judged alike.
    """
    filters = learn(docs)
    own = [F.col(f"`{c}`") for c in docs.columns]
    if not filters.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    kept = docs.select(F.struct(*own).alias("row"), judged(docs.sparkSession, filters).alias("judged"))
    seen = F.col("row.text").rlike(r"\p{L}") & (F.col("judged.score") >= least_score)
    return kept.where(seen).select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
