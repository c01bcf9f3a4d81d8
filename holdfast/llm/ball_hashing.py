"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints differ in at most two bits exactly when some value lies within one bit of both. Every distinct
fingerprint emits the 65 values within one bit; those that meet at a value are linked. At most 65 distinct
fingerprints can meet at one, whatever the data, and all of them lie within two bits of each other, so linking each to
the least of them keeps every group and emits no pairs. Copies share a fingerprint and are never expanded.

``similar_documents`` groups by similarity instead, by several narrow fingerprints: a shingle adds a signed weight to each
bit, and each fingerprint emits the values within two bits of it, flipped among the bits whose sums are nearest zero, where
similar texts differ. Two fingerprints up to four bits apart meet that way in the middle. Texts that meet are compared by
their whole shingle sets.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from itertools import repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from holdfast.llm.components import components, similar_components
from holdfast.llm.scratch import dropped, once, small_batches, stored
from holdfast.scale import lookup

SHINGLE_WORDS = 3
SEED = 42
RADIUS = 2
# Similar documents: words of a shingle, and the share of two texts' shingles that both must have.
SIMILAR_WORDS = 5
LEAST_SIMILARITY = 0.8
# Fingerprints of a set, their bits, and the least certain bits of each, of which up to two are flipped: 29 values. By
# simulation two sets at a similarity of 0.8 meet at a value of one fingerprint with a chance of 0.29, at 0.85 of 0.45 and at
# 0.9 of 0.66, so at one of twelve in 98.4 %, 99.9 % and all cases.
PRINTS = 12
PRINT_BITS = 32
UNSURE_BITS = 7
# Of all bits of two similar sets 15 % differ at 0.8, and half of those of sets that meet by chance; more are not compared.
MOST_BITS_APART = 0.35
# Texts to compare sent to every executor by their hash, 8 bytes each; more are met by a shuffle of the texts.
BROADCAST_TEXTS = 500_000
# Values at which sets meet sent to every executor, 8 bytes each; more are met by a shuffle of all values.
BROADCAST_VALUES = 2_000_000
# Values of a ball, and values of all sets that are counted at once, about 7 bytes each in the shuffle; more are counted
# fingerprint by fingerprint.
BALL = 1 + UNSURE_BITS + UNSURE_BITS * (UNSURE_BITS - 1) // 2
VALUES_AT_ONCE = 20_000_000
# Shingles counted at once: 64 bytes each.
BLOCK = 1 << 14
LOWER_CASE = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def shingle_hashes(text: bytes | None, size: int) -> np.ndarray:
    """64-bit hashes of the runs of ``size`` words of UTF-8 text; of all words if they are fewer, none without words."""
    # bytes.split() cuts at [\x20\x09-\x0D] and nowhere else.
    words = (text or b"").translate(LOWER_CASE).split()
    if not words:
        return np.empty(0, "<u8")
    shingles = map(b" ".join, zip(*(words[i:] for i in range(size)))) if len(words) >= size else [b" ".join(words)]
    return np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), "<u8")


def fingerprint(text: bytes | None, size: int = SHINGLE_WORDS) -> int:
    """Signed 64-bit SimHash of UTF-8 text; 0 without words."""
    hashes = shingle_hashes(text, size)
    if not len(hashes):
        return 0
    ones = np.zeros(64, dtype=np.int64)
    for start in range(0, len(hashes), BLOCK):
        block = hashes[start:start + BLOCK].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


@F.pandas_udf(LongType())
def _fingerprints(texts: pd.Series) -> pd.Series:
    return pd.Series([fingerprint(t) for t in texts], dtype="int64")


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, text_hash, fp`` per row. NULL and empty texts have fingerprint zero."""
    small_batches(docs.sparkSession)
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", F.xxhash64(text).alias("text_hash"), _fingerprints(text.cast("binary")).alias("fp"))


def ball(fp: Column) -> Column:
    """All values within half the radius: the fingerprint and those one bit away."""
    return F.concat(F.array(fp), F.transform(F.sequence(F.lit(0), F.lit(63)),
                                             lambda bit: fp.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), bit))))


def links(distinct: DataFrame) -> DataFrame:
    """``a, b``: each fingerprint ``fp`` that meets others at a value, with the least of those."""
    met = distinct.select("fp", F.explode(ball(F.col("fp"))).alias("value"))
    least = F.min("fp").over(Window.partitionBy("value"))
    return (met.select("fp", least.alias("least")).where("fp <> least").distinct()
            .where(F.bit_count(F.col("fp").bitwiseXOR(F.col("least"))) <= RADIUS)
            .select(F.col("fp").alias("a"), F.col("least").alias("b")))


def _classes(rows: DataFrame, nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """``rows`` (``doc_id, text_hash, fp``) with ``component_id`` and ``root``, from the roots of nodes ``fp``."""
    rooted = stored(nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")),
                    "rooted")
    firsts = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"), F.sum("n").alias("rows")).where("rows > 1")
    groups = stored(rooted.join(firsts, "root").select("fp", "root", "component_id", "n"), "classes")
    found = lookup(rows.withColumn("row", F.monotonically_increasing_id()), groups, ["fp"], ["component_id", "root"],
                   size="n", row_id="row")
    return found.select("doc_id", "text_hash", "fp", F.when(F.col("root").isNotNull(), F.col("component_id"))
                        .otherwise(F.col("doc_id")).alias("component_id"), F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per input row: ``doc_id, text_hash, fp, component_id, root``.

    ``root`` is the least fingerprint of the component and names it also where no row has an id.
    ``component_id`` is the smallest ``doc_id`` reachable over links of at most two differing bits, itself included;
    NULL ids count only where a component has no other. Documents without words are copies of each other. An empty
    table gives no rows; other columns are not read.
    """
    rows = stored(fingerprints(docs), "fingerprints")
    nodes = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")), "nodes")
    return _classes(rows, nodes, components(links(nodes)))


def _multipliers() -> tuple[np.ndarray, np.ndarray]:
    # The first ten are drawn as when there were no more, so that sets that met in them still do.
    dice = np.random.default_rng(SEED)
    pick = np.concatenate([dice.integers(0, 1 << 64, (2, 1, n * PRINT_BITS // 8), dtype=np.uint64) for n in (10, PRINTS - 10)], axis=2)
    return pick[0], pick[1] | np.uint64(1)


def narrow_fingerprints(shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """SimHash fingerprints of a set of shingle hashes and, for each in turn, its least certain bits; none for an empty set.

    A shingle adds a weight between -127.5 and 127.5 to each bit, so that sums of few shingles differ in size too.
    """
    if not len(shingles):
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    flip, odd = once(("weights",), _multipliers)
    sums = np.zeros(PRINTS * PRINT_BITS, dtype=np.int64)
    for start in range(0, len(shingles), BLOCK // 16):
        mixed = (shingles[start:start + BLOCK // 16, None] ^ flip) * odd
        mixed ^= mixed >> np.uint64(32)
        sums += mixed.view(np.int8).sum(axis=0, dtype=np.int32)
    sums = (2 * sums + len(shingles)).reshape(PRINTS, PRINT_BITS)
    bits = np.int64(1) << np.arange(PRINT_BITS, dtype=np.int64)
    unsure = np.argsort(np.abs(sums), axis=1, kind="stable")[:, :UNSURE_BITS]
    return ((sums > 0) * bits).sum(axis=1), bits[unsure].ravel()


@F.pandas_udf(StructType([StructField("fp", LongType()), StructField("shingles", LongType()),
                          StructField("prints", ArrayType(LongType())), StructField("unsure", ArrayType(LongType()))]))
def _narrow_fingerprints(texts: pd.Series) -> pd.DataFrame:
    sets = [np.unique(shingle_hashes(t, SIMILAR_WORDS)) for t in texts]
    names = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], dtype=np.uint64).view(np.int64)
    found = [narrow_fingerprints(s) for s in sets]
    return pd.DataFrame({"fp": names, "shingles": [len(s) for s in sets],
                         "prints": [f[0] for f in found], "unsure": [f[1] for f in found]})


def narrow_ball(fp: Column, unsure: Sequence[Column]) -> Column:
    """All values within two bits of the fingerprint, flipped among its ``unsure`` bits: itself, one bit, two bits."""
    flips = [*unsure, *(a.bitwiseOR(b) for i, a in enumerate(unsure) for b in unsure[:i])]
    return F.array(fp, *[fp.bitwiseXOR(bits) for bits in flips])


def ball_values(nodes: DataFrame, which: Sequence[int] = range(PRINTS)) -> DataFrame:
    """``node, bucket``: the values of the balls of each set ``fp`` round the fingerprints ``which``, told apart by the
    number of their fingerprint. A set without words has none."""
    balls = [narrow_ball(F.get("prints", F.lit(i)).bitwiseOR(F.lit(i << PRINT_BITS)),
                         [F.get("unsure", F.lit(i * UNSURE_BITS + k)) for k in range(UNSURE_BITS)]) for i in which]
    return nodes.where(F.size("prints") > 0).select(F.col("fp").alias("node"), F.explode(F.concat(*balls)).alias("bucket"))


def crowded_values(nodes: DataFrame) -> DataFrame:
    """``node, bucket``: the ball values of each set that other sets have too.

    Values of two fingerprints never meet: with many sets a few fingerprints at a time are counted, so that only a part of
    all values is in shuffles at once.
    """
    each = max(1, VALUES_AT_ONCE // max(1, nodes.count() * BALL))
    met = []
    for start in range(0, PRINTS, each):
        values = ball_values(nodes, range(start, min(start + each, PRINTS)))
        crowded = stored(values.groupBy("bucket").agg(F.count("*").alias("sets")).where("sets > 1").select("bucket"), "crowded")
        few = crowded.count() <= BROADCAST_VALUES
        known = values.join(F.broadcast(crowded) if few else crowded, "bucket", "left_semi")
        met.append(stored(known.select("node", "bucket"), "met"))
        dropped(crowded)
    return reduce(DataFrame.unionByName, met)


@F.pandas_udf(ArrayType(LongType()))
def _shingle_sets(texts: pd.Series) -> pd.Series:
    return pd.Series([np.unique(shingle_hashes(t, SIMILAR_WORDS)).view(np.int64) for t in texts])


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``node, elements``: the shingles of the nodes ``wanted`` (``fp, text_hash``), from one text each."""
    wanted = stored(wanted, "wanted")
    if wanted.count() <= BROADCAST_TEXTS:
        wanted = F.broadcast(wanted)
    text = F.coalesce("text", F.lit(""))
    texts = (docs.select(F.xxhash64(text).alias("text_hash"), text.cast("binary").alias("text")).join(wanted, "text_hash")
             .groupBy("fp").agg(F.first("text").alias("text")))
    return stored(texts.select(F.col("fp").alias("node"), _shingle_sets("text").alias("elements")), "shingles")


def similar_documents(docs: DataFrame) -> DataFrame:
    """Like ``near_duplicates``, but linked are texts of which ``LEAST_SIMILARITY`` of the five-word shingles are shared.

    ``fp`` names a set of shingles. Sets whose balls meet are compared whole (``similar_components``).
    """
    small_batches(docs.sparkSession)
    text = F.coalesce("text", F.lit(""))
    rows = stored(docs.select("doc_id", F.xxhash64(text).alias("text_hash"), _narrow_fingerprints(text.cast("binary")).alias("found"))
                  .select("doc_id", "text_hash", "found.*"), "narrow-fingerprints")
    nodes = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n"),
                                          F.min("text_hash").alias("text_hash"), F.first("shingles").alias("shingles"),
                                          F.first("prints").alias("prints"), F.first("unsure").alias("unsure")), "nodes")
    sizes = nodes.select(F.col("fp").alias("node"), F.col("shingles").alias("n"))
    met = crowded_values(nodes)
    members = stored(met.join(sizes, "node"), "members")
    dropped(met)
    hashes = nodes.select("fp", "text_hash")

    def sets(wanted: DataFrame) -> DataFrame:
        return _sets(docs, wanted.withColumnRenamed("node", "fp").join(hashes, "fp"))

    of = {side: nodes.select(F.col("fp").alias(side), F.col("prints").alias(f"of_{side}")) for side in "ab"}
    apart = F.aggregate(F.zip_with("of_a", "of_b", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda n, bits: n + bits)

    def likely(pairs: DataFrame) -> DataFrame:
        return (pairs.join(of["a"], "a").join(of["b"], "b").where(apart <= int(PRINTS * PRINT_BITS * MOST_BITS_APART))
                .select("a", "b"))

    roots = stored(similar_components(members, sets, LEAST_SIMILARITY, likely), "roots")
    dropped(members)
    return _classes(rows.select("doc_id", "text_hash", "fp"), nodes.select("fp", "first_id", "n"), roots)


def as_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def one_of_each_group(docs: DataFrame, grouped: Callable[[DataFrame], DataFrame] = near_duplicates) -> DataFrame:
    """The rows of ``docs`` that stay: of each component the row with the smallest ``doc_id``, NULL last.

    Of rows that share that id the one with the smallest text hash stays, and of repeated rows one.
    """
    classes = grouped(docs)
    rank = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash")
    keys = stored(classes.groupBy("root", "doc_id", "text_hash").agg(F.count("*").alias("n")), "keys")
    firsts = stored(keys.groupBy("root").agg(F.min(rank).alias("first"), F.count("*").alias("keys")).where("keys > 1")
                    .select("root", "first"), "firsts")
    stays = F.col("first").isNull() | rank.eqNullSafe(F.col("first"))
    # Most rows stay and no other has their id and text; only the rest is looked up, so that most often no text is moved.
    special = stored(keys.join(firsts, "root", "left").select("doc_id", "text_hash", "n", stays.alias("stays"))
                     .where("not stays or n > 1"), "special")
    own_hash = F.xxhash64(F.coalesce(docs.text, F.lit("")))

    def rows_of(keys: DataFrame, how: str) -> DataFrame:
        if keys.count() <= BROADCAST_TEXTS:
            keys = F.broadcast(keys)
        return docs.join(keys, docs.doc_id.eqNullSafe(keys.doc_id) & (own_hash == keys.text_hash), how)

    single = rows_of(special, "left_anti")
    repeated = special.where("stays")
    if repeated.isEmpty():
        return single
    return single.unionByName(rows_of(repeated, "left_semi").dropDuplicates(["doc_id", "text"]))
