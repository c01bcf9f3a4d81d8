"""Benchmark decontamination with a positional inverted index, in DataFrame operations only.

The index is sharded by document: every task writes the postings ``(term, row, position)`` of its own documents, sorted
by term, so building it shuffles nothing, and reading few terms skips most row groups. A query is answered from its
rarest terms: the two rarest posting lists, adjusted by the offsets of their terms, are intersected first and the
other terms are looked up only for the starts that are left.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from holdfast.llm.scratch import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW_WORDS = 10
# Terms of the query set sent to every executor, about 40 bytes each; a larger set is joined by a shuffle.
BROADCAST_TERMS = 200_000
# The posting that says how many words a document has.
LENGTH_TERM = -1


def words(text: Column) -> Column:
    """Words of a text, A-Z in lower case; NULL has none."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


@dataclass(frozen=True)
class Index:
    """``terms``: ``term, word, n``; ``postings``: ``term, row, position``; ``rows``: ``row, doc_id, text_hash, n_words``."""

    terms: DataFrame
    postings: DataFrame
    rows: DataFrame


def build_index(docs: DataFrame, vocabulary: DataFrame | None = None) -> Index:
    """Index every position of every word of ``docs``, or of the words in column ``word`` of ``vocabulary``.

    A vocabulary leaves out only postings that no query on it can ask for. Repeated rows are rows of their own, a
    NULL text is a row without words.
    """
    tokens = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"),
                         F.monotonically_increasing_id().alias("row"), words(F.col("text")).alias("words"))
    if vocabulary is None:
        vocabulary = tokens.select(F.explode("words").alias("word"))
    named = stored(vocabulary.select("word").distinct().withColumn("term", F.monotonically_increasing_id()), "terms")
    # One entry more than there are words: the last is matched by no word and carries the length.
    tokens = tokens.select("doc_id", "text_hash", "row", F.posexplode(F.concat("words", F.array(F.lit("")))).alias("position", "word"))
    ends = named.limit(0).unionByName(named.sparkSession.range(1).select(
        F.lit("").alias("word"), F.lit(LENGTH_TERM).cast("long").alias("term")))
    known = named.unionByName(ends)
    if named.count() <= BROADCAST_TERMS:
        known = F.broadcast(known)
    own = [F.when(F.col("term") == LENGTH_TERM, F.col(c)).alias(c) for c in ("doc_id", "text_hash")]
    entries = stored(
        tokens.join(known, "word").select("term", "row", "position", *own)
        .sortWithinPartitions("term", "row", "position"), "postings")
    postings = entries.where(F.col("term") >= 0).select("term", "row", "position")
    rows = entries.where(F.col("term") == LENGTH_TERM).select(
        "row", "doc_id", "text_hash", F.col("position").alias("n_words"))
    counts = postings.groupBy("term").agg(F.count("*").alias("n"))
    return Index(stored(named.join(counts, "term"), "counts"), postings, rows)


def phrase_windows(items: DataFrame, size: int = WINDOW_WORDS) -> DataFrame:
    """``item_id, terms``: every run of ``size`` words of an item; all words of a shorter one; none of an empty one."""
    listed = items.select("item_id", words(F.col("text")).alias("words")).where(F.size("words") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - size, F.lit(0)))
    return (listed.select("item_id", "words", F.explode(starts).alias("start"))
            .select("item_id", F.slice("words", F.col("start") + 1, F.lit(size)).alias("terms")))


def exact_phrases(index: Index, phrases: DataFrame) -> DataFrame:
    """``phrase, row, start, length``: every occurrence of the word lists (column ``words``) of ``phrases``.

    ``phrase`` identifies a list; lists with a word the corpus lacks drop out at once.
    """
    parts = phrases.select("phrase", F.size("words").alias("length"), F.posexplode("words").alias("at", "word"))
    known = parts.join(index.terms, "word")
    by_phrase = Window.partitionBy("phrase")
    ranked = stored(
        known.withColumn("known", F.count("*").over(by_phrase)).where("known = length")
        .withColumn("rank", F.row_number().over(by_phrase.orderBy("n", "term", "at")))
        .select("phrase", "length", "at", "term", "rank"), "ranked")
    first, second = (ranked.where(F.col("rank") == r).select("phrase", "length", "at", "term") for r in (1, 2))
    starts = (index.postings.join(first, "term")
              .select("phrase", "length", "row", (F.col("position") - F.col("at")).alias("start")).where("start >= 0"))
    # The second list, moved by its own offset, meets the first at the start of the phrase.
    others = (index.postings.join(second, "term")
              .select("phrase", "row", (F.col("position") - F.col("at")).alias("start")))
    pairs = starts.where("length > 1").join(others, ["phrase", "row", "start"])
    candidates = stored(starts.where("length = 1").unionByName(pairs), "candidates")
    rest = ranked.where("rank > 2").groupBy("phrase").agg(F.collect_list(F.struct("at", "term")).alias("rest"))
    wanted = (candidates.where("length > 2").join(rest, "phrase")
              .select("phrase", "length", "row", "start", F.explode("rest").alias("part"))
              .select("phrase", "length", "row", "start", F.col("part.term").alias("term"),
                      (F.col("start") + F.col("part.at")).alias("position")))
    met = wanted.join(index.postings, ["term", "row", "position"])
    long = (met.groupBy("phrase", "length", "row", "start").agg(F.count("*").alias("met"))
            .where("met = length - 2").drop("met"))
    return long.unionByName(candidates.where("length <= 2"))


def near_phrases(index: Index, phrases: DataFrame, slop: int) -> DataFrame:
    """``phrase, row, position``: places of a phrase's rarest word with all its other words within ``slop`` words.

    Positions are matched by blocks of ``slop + 1`` words, so a list meets only its own block and the next ones.
    """
    parts = phrases.select("phrase", F.explode(F.array_distinct("words")).alias("word"))
    by_phrase = Window.partitionBy("phrase")
    known = (parts.withColumn("wanted", F.count("*").over(by_phrase)).join(index.terms, "word")
             .withColumn("known", F.count("*").over(by_phrase)).where("known = wanted")
             .withColumn("rank", F.row_number().over(by_phrase.orderBy("n", "term"))))
    ranked = stored(known.select("phrase", "wanted", "term", "rank"), "ranked")
    places = index.postings.join(ranked, "term")
    block = F.floor(F.col("position") / (slop + 1))
    anchors = places.where("rank = 1").select("phrase", "wanted", "row", "position")
    near = anchors.withColumn("block", F.explode(F.array(*[block + d for d in (-1, 0, 1)])))
    others = (places.where("rank > 1").withColumn("block", block)
              .select("phrase", "row", "block", "term", F.col("position").alias("other")))
    met = (near.join(others, ["phrase", "row", "block"]).where(F.abs(F.col("other") - F.col("position")) <= slop)
           .select("phrase", "wanted", "row", "position", "term").distinct()
           .groupBy("phrase", "wanted", "row", "position").agg(F.count("*").alias("met")).where("met = wanted - 1"))
    return met.select("phrase", "row", "position").unionByName(
        anchors.where("wanted = 1").select("phrase", "row", "position"))


def _marked(docs: DataFrame, items: DataFrame, size: int) -> DataFrame:
    windows = stored(phrase_windows(items, size).select("item_id", F.col("terms").alias("words")), "windows")
    distinct = stored(windows.select("words").distinct().withColumn("phrase", F.monotonically_increasing_id()), "phrases")
    owners = stored(distinct.join(windows, "words").select("phrase", "item_id").distinct(), "owners")
    index = build_index(docs, distinct.select(F.explode("words").alias("word")))
    places = stored(exact_phrases(index, distinct), "places")

    before = Window.partitionBy("row").orderBy("start", "length").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("length")
    # Occurrences at one start differ only in length: the longest covers the others.
    spans = places.groupBy("row", "start").agg(F.max("length").alias("length"))
    reach = F.greatest(F.col("start"), F.coalesce(F.max(end).over(before), F.lit(0)))
    hits = (spans.withColumn("new", F.greatest(end - reach, F.lit(0)))
            .groupBy("row").agg(F.sum("new").alias("n_hit")))
    found = (places.select("row", "phrase").distinct().join(owners, "phrase").select("row", "item_id").distinct()
             .groupBy("row").agg(F.collect_list(F.col("item_id").cast("string")).alias("items")))
    items_of = F.array_sort(F.coalesce("items", F.array().cast("array<string>")))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return (index.rows.join(hits, "row", "left").join(found, "row", "left")
            .select("doc_id", "text_hash", F.col("n_words").cast("long").alias("n_words"), n_hit.alias("n_hit"),
                    F.size(items_of).cast("long").alias("n_items"),
                    F.sha2(F.concat_ws(",", items_of), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated")))


def decontaminate(docs: DataFrame, items: DataFrame, size: int = WINDOW_WORDS) -> DataFrame:
    """One row per document row: ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated``.

    A word inside any occurrence of an item's window is hit. NULL and empty texts have no words and are clean; items
    without words match nothing; items with a NULL ``item_id`` hit words but are not listed. Items that repeat an id
    count once. Other columns are not read.
    """
    return _marked(docs, items, size).drop("text_hash")


def clean_documents(docs: DataFrame, items: DataFrame, size: int = WINDOW_WORDS) -> DataFrame:
    """The rows of ``docs`` in which no window of an item occurs, with all their columns."""
    marked = _marked(docs, items, size).where("contaminated").select("doc_id", "text_hash").distinct()
    own_hash = F.xxhash64(F.coalesce(docs.text, F.lit("")))
    return docs.join(marked, docs.doc_id.eqNullSafe(marked.doc_id) & (own_hash == marked.text_hash), "left_anti")
