"""Substring dedup by suffix orders built with a difference cover, one for each bucket of anchors.

1. Copies of a whole text need no suffixes: all but the first are repeats from end to end.
2. Every string of ``LENGTH`` bytes has an anchor: of its ``GRAM``-byte grams the one with the least hash, the last if
   several. Equal strings have equal anchors at equal places, so only strings whose anchors are of one hash can be equal;
   anchors that occur once are left out, which loses nothing.
3. The strings of one anchor lie side by side in its context, at most twice ``LENGTH`` bytes. Of equal contexts the first
   stands for all: strings in the others are repeats.
4. Different contexts of one anchor go to one bucket. Its suffixes are ordered by the difference cover {1, 2} modulo 3:
   triples of symbols at sampled places are sorted and named, the string of names is ordered in the same way, and the
   remaining suffixes are merged in by their first symbols and the order of the sampled suffix behind them.
5. Neighbours in the order are compared by their first ``LENGTH`` bytes. All but the earliest start of each run are
   repeats, and the bytes they cover go.

An anchor with more different contexts than a task should order (a short passage in very many texts) is left to hashes of
its strings, which are grouped by a partial aggregate.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.llm.scratch import TEXTS_PER_BATCH, dropped, once, small_batches, stored
from holdfast.scale import lookup

LENGTH, GRAM = 100, 32
SYMBOL = 7  # bytes of a first symbol, 9 bits each; symbols overlap, so their order is the order of the bytes
# Bytes of a document hashed at once.
SLICE = 1 << 20
# Anchors or rows sent to every executor, 8 bytes each; more are joined by a shuffle.
BROADCAST_ANCHORS = 1_000_000
# Names of one order have so many bits, three names one number; an order has fewer bytes than there are names.
NAME_BITS = 21
# Contexts of a bucket, about, and most of one anchor.
BUCKET = 6_000
MULTIPLIER = 0x9E3779B97F4A7C15


# ------------------------------------------------------------------ stretches that can repeat

def _powers(base: int, n: int) -> np.ndarray:
    factors = np.full(n + 1, base % 2**64, dtype=np.uint64)
    factors[0] = 1
    return np.cumprod(factors, dtype=np.uint64)


def _slide(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every run of ``width`` values."""
    done = 1
    while done < width:
        step = min(done, width - done)
        values = np.minimum(values[:-step], values[step:])
        done += step
    return values


def anchors(data: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each anchor with the first of the strings of ``length`` bytes that have it, which are neighbours, and their
    number; each string once."""
    hashes, begins, counts = [], [], []
    ahead, back = once(("powers", length), lambda: (
        _powers(MULTIPLIER, SLICE + length), _powers(pow(MULTIPLIER, -1, 2**64), SLICE + length)))
    for start in range(0, len(data) - length + 1, SLICE):
        part = np.frombuffer(data, np.uint8, min(SLICE + length - 1, len(data) - start), start).astype(np.uint64) + np.uint64(1)
        sums = np.concatenate(([np.uint64(0)], np.cumsum(part * ahead[:len(part)], dtype=np.uint64)))
        own = (sums[gram:] - sums[:-gram]) * back[:len(part) - gram + 1]
        own = (own ^ (own >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
        own ^= own >> np.uint64(29)
        # The low bits hold the place, counted down: of equal hashes the last is least.
        low = np.uint64((1 << 22) - 1)
        ranked = (own & ~low) | (low - np.arange(len(own), dtype=np.uint64))
        at = (low - (_slide(ranked, length - gram + 1) & low)).astype(np.int64)
        new = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        hashes.append(own[at[new]].view(np.int64))
        begins.append(new + start)
        counts.append(np.diff(np.append(new, len(at))))
    if not hashes:
        return tuple(np.empty(0, dtype=np.int64) for _ in range(3))
    return np.concatenate(hashes), np.concatenate(begins), np.concatenate(counts)


def _described(docs: DataFrame, length: int) -> DataFrame:
    """``row, doc_id, text_hash, n_bytes, data, grams, begins, counts`` per row of ``docs``; a text's anchors lie in its row."""
    def describe(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [anchors(d, length, min(GRAM, length)) for d in batch.data]
            yield batch.assign(n_bytes=[len(d) for d in batch.data], **{
                name: [f[i] for f in found] for i, name in enumerate(("grams", "begins", "counts"))})

    small_batches(docs.sparkSession)
    # Arrays of a text's anchors are read few rows at once too.
    docs.sparkSession.conf.set("spark.sql.parquet.columnarReaderBatchSize", TEXTS_PER_BATCH)
    data = F.coalesce("text", F.lit("")).cast("binary")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("string").alias("doc_id"),
                       F.sha2(data, 256).alias("text_hash"), data.alias("data"))
    described = rows.mapInPandas(describe, "row long, doc_id string, text_hash string, data binary, n_bytes long, "
                                           "grams array<long>, begins array<long>, counts array<long>")
    return described.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))


def _few(ids: DataFrame) -> DataFrame:
    """Narrow rows that are sent to every executor if they are few."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_ANCHORS else ids


# ------------------------------------------------------------------ order

def ranks(symbols: np.ndarray) -> np.ndarray:
    """Rank from 1 of every suffix of a string of symbols, which are from 1 and of ``NAME_BITS``; its end comes before every
    symbol."""
    n = len(symbols)
    if n < 4:
        order = sorted(range(n), key=lambda i: symbols[i:].tolist())
        found = np.empty(n, dtype=np.int64)
        found[order] = np.arange(1, n + 1)
        return found
    padded = np.concatenate((symbols, np.zeros(3, dtype=np.int64)))
    # One place behind the end is sampled too, so that the names of one class end with a triple of their own.
    one, two = np.arange(1, n + 1, 3), np.arange(2, n, 3)
    sampled = np.concatenate((one, two))
    triples = padded[sampled] << 2 * NAME_BITS | padded[np.minimum(sampled + 1, n + 2)] << NAME_BITS | padded[np.minimum(sampled + 2, n + 2)]
    distinct, named = np.unique(triples, return_inverse=True)
    named = named.astype(np.int64) + 1
    if len(distinct) < len(sampled):
        named = ranks(named)
    behind = np.zeros(n + 4, dtype=np.int64)
    behind[sampled] = named
    zero, one, two = np.arange(0, n, 3), one[one < n], two
    # A remaining suffix meets the first sampled class one symbol on, the second class two symbols on.
    by_one = lambda at: padded[at] << NAME_BITS | behind[at + 1]
    by_two = lambda at: padded[at] << 2 * NAME_BITS | padded[at + 1] << NAME_BITS | behind[at + 2]
    zero = zero[np.argsort(by_one(zero), kind="stable")]
    one, two = one[np.argsort(behind[one])], two[np.argsort(behind[two])]
    before_one, before_two = np.searchsorted(by_one(one), by_one(zero)), np.searchsorted(by_two(two), by_two(zero))
    found = np.empty(n, dtype=np.int64)
    found[zero] = np.arange(1, len(zero) + 1) + before_one + before_two
    # The others fill the ranks that are left, in their own order.
    rest = np.concatenate((one, two))
    free = np.ones(n + 1, dtype=bool)
    free[0], free[found[zero]] = False, False
    found[rest[np.argsort(behind[rest])]] = np.flatnonzero(free)
    return found


def first_symbols(data: np.ndarray, symbol: int = SYMBOL) -> np.ndarray:
    """Names from 1 of the runs of ``symbol`` bytes, in their order."""
    padded = np.concatenate((data.astype(np.int64) + 1, np.zeros(symbol, dtype=np.int64)))
    runs = np.zeros(len(data), dtype=np.int64)
    for i in range(symbol):
        runs = runs << 9 | padded[i:i + len(data)]
    return np.unique(runs, return_inverse=True)[1].astype(np.int64) + 1


def _repeated(batch: pd.DataFrame, length: int, symbol: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and start of the strings of ``length`` bytes in contexts (``row, begin, context``, earlier ones first) that
    also start earlier."""
    sizes = np.array([len(c) for c in batch.context])
    data = np.frombuffer(b"".join(batch.context), np.uint8)
    owner, inside = np.repeat(np.arange(len(sizes)), sizes), np.arange(len(data)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    # Contexts follow by document and place; strings of one document may interleave.
    document = np.cumsum(np.concatenate(([0], np.diff(batch.row.to_numpy()) != 0)))
    start = batch.begin.to_numpy()[owner] + inside
    place = document[owner] << 40 | start
    whole = np.flatnonzero(inside + length <= sizes[owner])
    whole = whole[np.argsort(ranks(first_symbols(data, symbol))[whole])]
    strings = np.lib.stride_tricks.sliding_window_view(data, length)
    new = np.ones(len(whole), dtype=bool)
    for at in range(1, len(whole), 1 << 15):
        some = whole[at - 1:at + (1 << 15)]
        new[at:at + (1 << 15)] = (strings[some[1:]] != strings[some[:-1]]).any(axis=1)
    begins = np.flatnonzero(new)
    first = np.repeat(np.minimum.reduceat(place[whole], begins), np.diff(np.append(begins, len(whole))))
    again = whole[place[whole] != first]
    return batch.row.to_numpy()[owner[again]], start[again]


def repeated_in_bucket(frame: pd.DataFrame, length: int, symbol: int) -> pd.DataFrame:
    """``row, begin, until``: ranges of starts of repeated strings in the contexts of one bucket."""
    frame = frame.sort_values(["gram", "last", "key", "row", "begin"], ignore_index=True)
    # Anchors are ordered together as far as names reach.
    size, new = frame.context.str.len().to_numpy(), (frame.gram != frame.gram.shift()).to_numpy()
    bytes_of = pd.Series(size).groupby(np.cumsum(new)).sum().to_numpy()
    portion, filled, portions = 0, 0, []
    for n in bytes_of:
        if filled + n >= 1 << NAME_BITS - 1 and filled:
            portion, filled = portion + 1, 0
        filled += n
        portions.append(portion)
    out = [_repeated(p.sort_values(["last", "key", "row", "begin"]), length, symbol)
           for _, p in frame.groupby(np.array(portions)[np.cumsum(new) - 1])]
    found = pd.DataFrame({"row": np.concatenate([r for r, _ in out]), "begin": np.concatenate([s for _, s in out])})
    found = found.sort_values(["row", "begin"], ignore_index=True)
    run = ((found.row != found.row.shift()) | (found.begin != found.begin.shift() + 1)).cumsum()
    ranges = found.groupby(run).agg(row=("row", "first"), begin=("begin", "first"), until=("begin", "last"))
    return ranges.assign(until=ranges.until + 1)


def repeated_starts(contexts: DataFrame, length: int = LENGTH, symbol: int = SYMBOL) -> DataFrame:
    """``row, begin, until``: starts, from ``begin`` and before ``until``, of strings of ``length`` bytes that also start
    earlier, by ``last, key, row`` and then the place. ``contexts`` (``row, last, key, gram, begin, context``) hold all strings
    that have an anchor, the ``gram``; strings of one row begin ``begin`` bytes into it."""
    known = contexts.withColumns({"digest": F.md5("context"), "place": F.struct("last", "key", "row", "begin"),
                                  "until": F.col("begin") + F.octet_length("context") - length + 1})
    counted = stored(known.groupBy("gram", "digest").agg(F.min("place").alias("first"), F.count("*").alias("size")), "contexts")
    several = stored(counted.groupBy("gram").agg(F.count("*").alias("different")).where("different > 1"), "several")
    copies = lookup(known.drop("context").withColumn("id", F.xxhash64("row", "begin")), counted.where("size > 1"),
                    ["gram", "digest"], ["first"], size="size", row_id="id").where("place <> first").select("row", "begin", "until")
    # Of equal contexts the first is ordered.
    firsts = stored(counted.join(several, "gram").select("first.*", "different"), "firsts")
    ordered = stored(contexts.join(firsts.select("row", "begin", "different"), ["row", "begin"]), "ordered")
    crowded = min(BUCKET, (1 << NAME_BITS - 1) // (2 * length))
    few, many = ordered.where(F.col("different") <= crowded), ordered.where(F.col("different") > crowded)
    buckets = few.count() // BUCKET + 1
    near = few.withColumn("bucket", F.pmod(F.xxhash64("gram"), F.lit(buckets))).groupBy("bucket").applyInPandas(
        lambda frame: repeated_in_bucket(frame, length, symbol), "row long, begin long, until long")
    found = copies.unionByName(near)
    if many.isEmpty():
        return found
    each = many.select("row", "last", "key", "begin", F.posexplode(F.transform(
        F.sequence(F.lit(0), F.octet_length("context") - length), lambda i: F.md5(F.substring("context", i + 1, F.lit(length)))))
        .alias("at", "string")).withColumn("begin", F.col("begin") + F.col("at"))
    each = stored(each.withColumn("place", F.struct("last", "key", "row", "begin")), "strings")
    earliest = stored(each.groupBy("string").agg(F.min("place").alias("first"), F.count("*").alias("size")).where("size > 1"), "earliest")
    again = lookup(each.withColumn("id", F.xxhash64("row", "begin")), earliest, ["string"], ["first"], size="size", row_id="id")
    return found.unionByName(again.where("place <> first").select("row", "begin", (F.col("begin") + 1).alias("until")))


# ------------------------------------------------------------------ whole operator

def remove_repeats(docs: DataFrame, length: int = LENGTH, symbol: int = SYMBOL) -> DataFrame:
    """One row per input row: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256``.

    A byte goes when a string of ``length`` bytes that covers it also starts earlier: in a smaller ``doc_id`` (NULL
    last; rows that share one follow the table), or earlier in the document. NULL and empty texts have no bytes. Texts
    shorter than ``length`` are kept whole. An empty table gives no rows; other columns are not read.
    """
    rows = stored(_described(docs, length), "described")
    rank = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row")
    # Of equal texts the first row stands for all; two steps, as a third of the rows may be equal.
    firsts = stored(rows.groupBy("text_hash").agg(F.min(rank).alias("rank")).select(
        F.col("rank.row").alias("row"), F.lit(True).alias("first")), "firsts")
    known = stored(rows.select("row", "doc_id", "text_hash", "n_bytes").join(firsts, "row", "left")
                   .withColumn("first", F.coalesce("first", F.lit(False))), "known")
    copies = known.where("not first").select("row")
    anchored = rows.join(_few(copies), "row", "left_anti").select(
        "row", F.explode(F.arrays_zip("grams", "begins", "counts")).alias("a")).select("row", "a.*").withColumnRenamed("grams", "gram")
    twice = stored(anchored.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram"), "twice")
    wanted = stored(anchored.join(_few(twice), "gram").groupBy("row").agg(
        F.collect_list(F.struct("gram", "begins", "counts")).alias("anchors")), "wanted")

    def texts_of(some: DataFrame, *columns: str) -> DataFrame:
        texts = rows.select("row", "data", *columns)
        return texts.join(_few(some.select("row")), "row", "left_semi").join(some, "row")

    def contexts_of(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [(row, last, key, a["gram"], a["begins"], data[a["begins"]:a["begins"] + a["counts"] + length - 1])
                   for row, last, key, data, found in zip(batch.row, batch["last"], batch.key, batch.data, batch.anchors)
                   for a in found]
            yield pd.DataFrame(out, columns=["row", "last", "key", "gram", "begin", "context"])

    kind = docs.schema["doc_id"].dataType
    keyed = texts_of(wanted, "doc_id").select("row", F.col("doc_id").isNull().alias("last"),
                                              F.coalesce("doc_id", F.lit("0").cast(kind)).alias("key"), "data", "anchors")
    contexts = stored(keyed.mapInPandas(
        contexts_of, f"row long, last boolean, key {kind.simpleString()}, gram long, begin long, context binary"), "contexts")
    starts = stored(repeated_starts(contexts, length, symbol).groupBy("row").agg(
        F.collect_list(F.struct("begin", "until")).alias("starts")), "starts")
    dropped(contexts)

    def cut(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row, data, ranges in zip(batch.row, batch.data, batch.starts):
                ranges = np.array(sorted((r["begin"], r["until"] + length - 1) for r in ranges))
                reach = np.maximum.accumulate(ranges[:, 1])
                new = np.flatnonzero(np.concatenate(([True], ranges[1:, 0] > reach[:-1])))
                begins, ends = ranges[new, 0], reach[np.append(new[1:] - 1, len(ranges) - 1)]
                kept, at = hashlib.sha256(), 0
                for begin, end in zip(begins, ends):
                    kept.update(data[at:begin])
                    at = end
                kept.update(data[at:])
                out.append((row, int((ends - begins).sum()), len(new), kept.hexdigest()))
            yield pd.DataFrame(out, columns=["row", "removed", "spans", "kept"])

    cuts = texts_of(starts).mapInPandas(cut, "row long, removed long, spans long, kept string")
    copy = ~F.col("first") & (F.col("n_bytes") >= length)
    return known.join(stored(cuts, "cuts"), "row", "left").select(
        "doc_id", "n_bytes", F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, 1).otherwise(F.coalesce("spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copy, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept", "text_hash")).alias("kept_sha256"))
