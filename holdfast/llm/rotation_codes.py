"""Embedding near-duplicates by randomised-rotation binary codes.

A unit vector o is rotated at random; the signs of its coordinates are its code ō, a corner of the unit cube, and
<ō, o> is stored beside it as a correction factor. For a rotated vector q, kept as four bits a coordinate, <ō, q> / <ō, o>
estimates <o, q> without bias, and how far it may be off follows from the factor. Only pairs whose bound reaches the wanted
cosine, seen from both sides, are recomputed from the vectors.

Pairs to estimate meet in buckets: a table's bucket is the largest coordinate (and its sign) of a few more rotations. The
number of rotations follows from the number of vectors, the number of tables from the odds that a pair at the wanted
cosine meets in none: ``MISSED``. What travels to the buckets are codes, not vectors.

Copies of a vector are one row. Vectors of a crowded bucket whose angle to one of them is at most half the wanted one are
all linked with each other by the triangle inequality: such a ball is counted, its pairs are never formed.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.llm.components import components
from holdfast.llm.scratch import once, stored
from holdfast.scale import lookup

LEAST_COSINE = 0.95
# Chance that a pair at the wanted cosine meets in no table, and that a coordinate's error passes its bound (standard
# deviations of the estimate: fewer than one in a million).
MISSED, DEVIATIONS = 1e-5, 5.0
# Vectors that share a bucket by chance, about.
BY_CHANCE = 8
QUERY_BITS = 4
# Members from which a bucket looks for balls, and vectors compared with each other at once.
CROWD, BLOCK = 128, 1024
SEED = 42


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hadamard(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of the rows, whose length is a power of two."""
    n, half = x.shape[1], 1
    while half < n:
        pairs = x.reshape(len(x), -1, 2, half)
        x = np.concatenate([pairs[:, :, :1] + pairs[:, :, 1:], pairs[:, :, :1] - pairs[:, :, 1:]], axis=2).reshape(len(x), n)
        half *= 2
    return x / math.sqrt(n)


class Rotations:
    """The rotations for vectors of one length: a uniform one for codes, fast ones (three rounds of signs and Hadamard)
    for buckets."""

    def __init__(self, length: int, vectors: int, cosine: float):
        dice = np.random.default_rng([SEED, length])
        self.length, self.padded = length, 1 << (length - 1).bit_length()
        q, r = np.linalg.qr(dice.normal(size=(length, length)))
        self.uniform = q * np.sign(np.diag(r))
        self.digits = max(1, math.ceil(math.log(max(vectors / BY_CHANCE, 1)) / math.log(max(2 * self.padded, 2))))
        odds = self._odds(dice, cosine) ** self.digits
        self.tables = max(1, math.ceil(math.log(MISSED) / math.log(max(1 - odds, 1e-300))))
        self.signs = np.random.default_rng([SEED, length, 1]).choice([-1.0, 1.0], size=(self.tables * self.digits, 3, self.padded))

    def _digit(self, x: np.ndarray, signs: np.ndarray) -> np.ndarray:
        """The largest coordinate after a rotation, with its sign."""
        for flips in signs:
            x = _hadamard(x * flips)
        largest = np.abs(x).argmax(axis=1)
        return 2 * largest + (np.take_along_axis(x, largest[:, None], 1)[:, 0] > 0)

    def _wide(self, x: np.ndarray) -> np.ndarray:
        return np.pad(x, ((0, 0), (0, self.padded - self.length)))

    def _odds(self, dice: np.random.Generator, cosine: float) -> float:
        """How often two vectors at a cosine have the same digit: the lower end of what trials show."""
        trials = 4000
        u, w = dice.normal(size=(2, trials, self.length))
        u /= np.linalg.norm(u, axis=1)[:, None]
        w -= (w * u).sum(1)[:, None] * u
        w /= np.maximum(np.linalg.norm(w, axis=1), 1e-12)[:, None]
        v = cosine * u + math.sqrt(max(0.0, 1 - cosine * cosine)) * w
        equal = 0
        for _ in range(4):
            signs = dice.choice([-1.0, 1.0], size=(3, self.padded))
            equal += (self._digit(self._wide(u), signs) == self._digit(self._wide(v), signs)).sum()
        share = equal / (4 * trials)
        return min(0.999, max(0.01, share - 3 * math.sqrt(share * (1 - share) / (4 * trials))))

    def buckets(self, x: np.ndarray) -> np.ndarray:
        """A bucket per table for each unit vector."""
        wide, out = self._wide(x), np.empty((len(x), self.tables), dtype=np.int64)
        for t in range(self.tables):
            key = np.full(len(x), (self.length << 32) + t, dtype=np.uint64)
            for signs in self.signs[t * self.digits:(t + 1) * self.digits]:
                key = _mixed(key * np.uint64(0x9E3779B97F4A7C15) + self._digit(wide, signs).astype(np.uint64))
            out[:, t] = key.view(np.int64)
        return out

    def codes(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of unit vectors: code words, correction factors, and as queries bit planes, least value and step."""
        rotated = x @ self.uniform
        factor = np.abs(rotated).sum(axis=1) / math.sqrt(self.length)
        least = rotated.min(axis=1)
        step = np.maximum((rotated.max(axis=1) - least) / (2 ** QUERY_BITS - 1), 1e-30)
        levels = np.rint((rotated - least[:, None]) / step[:, None]).astype(np.uint8)
        planes = [_words(levels >> bit & 1) for bit in range(QUERY_BITS)]
        return _words(rotated > 0), factor, np.concatenate(planes, axis=1), least, step


def _words(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as 64-bit words."""
    raw = np.packbits(np.pad(bits.astype(bool), ((0, 0), (0, -bits.shape[1] % 64))), axis=1)
    return raw.view(np.uint64)


class Codes:
    """Codes of vectors of one length, to estimate cosines of pairs of them."""

    def __init__(self, frame: pd.DataFrame, length: int):
        self.length, words = length, -(-length // 64)
        packed = np.frombuffer(b"".join(frame.code), np.uint64).reshape(len(frame), -1)
        self.code, self.planes = packed[:, :words], packed[:, words:].reshape(len(frame), QUERY_BITS, words)
        self.factor, self.least, self.step = (frame[c].to_numpy() for c in ("factor", "least", "step"))
        self.ones = np.bitwise_count(self.code).sum(axis=1, dtype=np.int64)
        levels = np.bitwise_count(self.planes).sum(axis=2, dtype=np.int64)
        self.level_sum = (levels << np.arange(QUERY_BITS)).sum(axis=1)

    def _bounds(self, i: np.ndarray, j: np.ndarray, cosine: float) -> np.ndarray:
        """Whether the cosine of vectors i (by code) and j (as query) may reach ``cosine``; i and j broadcast."""
        met = np.zeros(np.broadcast(i, j).shape, dtype=np.int64)
        for word in range(self.code.shape[1]):
            for bit in range(QUERY_BITS):
                met += np.bitwise_count(self.code[i, word] & self.planes[j, bit, word]).astype(np.int64) << bit
        root = math.sqrt(self.length)
        inner = (2 * self.step[j] * met + 2 * self.least[j] * self.ones[i] - self.step[j] * self.level_sum[j]) / root - root * self.least[j]
        factor = self.factor[i]
        spread = math.sqrt(1 - cosine * cosine) * np.sqrt(np.maximum(1 - factor * factor, 0) / max(self.length - 1, 1)) / factor
        rounding = self.step[j] / (math.sqrt(12) * factor)
        return inner / factor + DEVIATIONS * np.sqrt(spread ** 2 + rounding ** 2) >= cosine

    def may_link(self, i: np.ndarray, j: np.ndarray, cosine: float) -> np.ndarray:
        return self._bounds(i, j, cosine) & self._bounds(j, i, cosine)


def _unit(values: object) -> np.ndarray | None:
    """A vector as doubles of length 1; None if it is missing, empty, zero or holds anything but finite numbers."""
    if values is None or len(values) == 0:
        return None
    x = np.array([np.nan if v is None else v for v in values] if getattr(values, "dtype", object) == object else values, dtype=np.float64)
    largest = np.abs(x).max()
    if not 0 < largest < np.inf:  # NaN included
        return None
    x = x / largest
    return x / math.sqrt(x @ x) + 0.0


def unit_vectors(embeddings: DataFrame) -> DataFrame:
    """``row, vec_id, digest, unit``: every row; NULL digest and unit for vectors that link with nothing."""
    def units(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            # Copies are equal vectors; what differs in scale meets later.
            found = [_unit(v) for v in frame.embedding]
            raw = [None if u is None else u.tobytes() for u in found]
            yield pd.DataFrame({"vec_id": frame.vec_id, "unit": raw,
                                "digest": [None if r is None else hashlib.blake2b(r, digest_size=16).hexdigest() for r in raw]})

    rows = embeddings.select(F.col("vec_id").cast("string").alias("vec_id"), "embedding").mapInPandas(
        units, "vec_id string, unit binary, digest string")
    return stored(rows.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"),
                              "digest", "unit"), "units")


def coded(vectors: DataFrame, count: int, cosine: float) -> DataFrame:
    """Distinct vectors ``key, unit`` with ``length``, code, factors and ``buckets``."""
    def codes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            length = frame.unit.str.len() // 8
            for n, some in frame.groupby(length, sort=False):
                x = np.frombuffer(b"".join(some.unit), np.float64).reshape(len(some), n)
                turned = once(("rotations", n, count, cosine), lambda n=n: Rotations(int(n), count, cosine))
                code, factor, planes, least, step = turned.codes(x)
                packed = np.concatenate([code, planes], axis=1)
                yield pd.DataFrame({"key": some.key.to_numpy(), "length": n, "code": [p.tobytes() for p in packed], "factor": factor,
                                    "least": least, "step": step, "buckets": list(turned.buckets(x))})

    return stored(vectors.select("key", "unit").mapInPandas(
        codes, "key long, length int, code binary, factor double, least double, step double, buckets array<long>"), "codes")


def _cosines(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """Pairs ``a, b`` with the exact ``cosine`` of their vectors."""
    def exact(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            same = frame.left.str.len() == frame.right.str.len()
            frame = frame[same]
            cosine = [np.frombuffer(x) @ np.frombuffer(y) for x, y in zip(frame.left, frame.right)]
            yield pd.DataFrame({"a": frame.a, "b": frame.b, "cosine": np.array(cosine, dtype=np.float64)})

    both = pairs.join(vectors.select(F.col("key").alias("a"), F.col("unit").alias("left")), "a").join(
        vectors.select(F.col("key").alias("b"), F.col("unit").alias("right")), "b")
    return both.mapInPandas(exact, "a long, b long, cosine double")


def balls(codes: DataFrame, vectors: DataFrame, cosine: float) -> DataFrame:
    """``key, ball``: vectors of crowded buckets within half the wanted angle of a bucket's least vector.

    A vector takes the least such ball. Any two of a ball are linked: their angle is at most the sum of theirs.
    """
    rows = codes.select("key", F.explode("buckets").alias("bucket"))
    crowds = rows.groupBy("bucket").agg(F.count("*").alias("n"), F.min("key").alias("ball")).where(F.col("n") >= CROWD)
    crowds = stored(crowds, "crowds")
    placed = lookup(rows, crowds, ["bucket"], ["ball"], size="n", row_id="key", known_groups=crowds.count())
    tried = stored(placed.where("ball IS NOT NULL").select("key", "ball").distinct(), "tried")
    sizes = tried.groupBy("ball").agg(F.count("*").alias("n"))
    centres = vectors.select(F.col("key").alias("ball"), F.col("unit").alias("centre")).join(sizes, "ball")
    both = lookup(tried.join(vectors.select("key", "unit"), "key"), centres, ["ball"], ["centre"], size="n", row_id="key")
    least = math.cos(math.acos(cosine) / 2) + 1e-9

    def near(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            inside = [len(x) == len(y) and float(np.frombuffer(x) @ np.frombuffer(y)) >= least for x, y in zip(frame.unit, frame.centre)]
            yield frame.loc[np.array(inside, dtype=bool), ["key", "ball"]]

    inside = both.select("key", "ball", "unit", "centre").mapInPandas(near, "key long, ball long")
    return stored(inside.groupBy("key").agg(F.min("ball").alias("ball")), "balls")


def _block_rows(codes: DataFrame, members: DataFrame) -> DataFrame:
    """Rows of each block to compare: ``bucket, block, side`` and the codes.

    A bucket's largest ball and the rest are dealt into parts of about ``BLOCK``. Parts of the rest meet each other and
    every part of the ball; parts of the ball do not meet. Side 0 meets side 1; side 2 meets itself.
    """
    rows = codes.join(members, "key", "left").withColumn("bucket", F.explode("buckets")).drop("buckets")
    counts = rows.groupBy("bucket", "ball").agg(F.count("*").alias("n"))
    sizes = counts.groupBy("bucket").agg(F.sum("n").alias("n"), F.max(F.when(F.col("ball").isNotNull(), F.struct("n", "ball"))).alias("most"))
    crowded = stored(sizes.where(F.col("n") > CROWD).select(
        "bucket", "n", F.col("most.ball").alias("main"), F.ceil(F.coalesce("most.n", F.lit(0)) / BLOCK).cast("int").alias("ball_parts"),
        F.ceil((F.col("n") - F.coalesce("most.n", F.lit(0))) / BLOCK).cast("int").alias("rest_parts")), "crowded")
    placed = lookup(rows, crowded, ["bucket"], ["main", "ball_parts", "rest_parts"], size="n", row_id="key", known_groups=crowded.count())
    part = F.pmod(F.xxhash64("key"), F.when(F.coalesce(F.col("ball") == F.col("main"), F.lit(False)), F.col("ball_parts")).otherwise(
        F.greatest(F.coalesce("rest_parts", F.lit(1)), F.lit(1)))).cast("int")
    placed = placed.withColumn("part", part).withColumn("in_main", F.coalesce(F.col("ball") == F.col("main"), F.lit(False)))
    # Blocks are (first part, second part); parts of the ball count down from -1.
    blocks = F.expr("""
        CASE WHEN main IS NULL AND coalesce(rest_parts, 1) <= 1 THEN array(struct(0 AS x, 0 AS y, 2 AS side))
             WHEN in_main THEN transform(sequence(1, rest_parts), o -> struct(-1 - part AS x, o - 1 AS y, 0 AS side))
             ELSE concat(
                 transform(sequence(1, rest_parts), o -> struct(least(part, o - 1) AS x, greatest(part, o - 1) AS y,
                     CASE WHEN part = o - 1 THEN 2 WHEN part < o - 1 THEN 0 ELSE 1 END AS side)),
                 filter(transform(sequence(0, ball_parts), p -> struct(-p AS x, part AS y, 1 AS side)), b -> b.x < 0)) END""")
    blocks = F.when(F.col("in_main") & (F.col("rest_parts") == 0), F.expr("array()").cast("array<struct<x:int,y:int,side:int>>")).otherwise(blocks)
    return placed.withColumn("block", F.explode(blocks)).select(
        "bucket", "block.x", "block.y", "block.side", "key", F.coalesce("ball", F.lit(-1)).alias("ball"), "length", "code", "factor", "least",
        "step")


def candidates(codes: DataFrame, members: DataFrame, cosine: float) -> DataFrame:
    """Distinct pairs ``a < b`` of vectors in a common bucket, not of one ball, whose bounds reach the wanted cosine."""
    def compared(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for frame in frames:
            if rest is not None and len(rest):
                frame = pd.concat([rest, frame], ignore_index=True)
            if not len(frame):
                continue
            # The last block may go on in the next batch; a block has at most a few times BLOCK rows.
            last = frame.iloc[-1]
            open_rows = ((frame.bucket == last.bucket) & (frame.x == last.x) & (frame.y == last.y)).to_numpy()
            rest = frame[open_rows]
            yield from _linked(frame[~open_rows], cosine)
        if rest is not None:
            yield from _linked(rest, cosine)

    rows = _block_rows(codes, members)
    ordered = rows.repartition("bucket", "x", "y").sortWithinPartitions("bucket", "x", "y")
    return ordered.mapInPandas(compared, "a long, b long").distinct()


def _linked(frame: pd.DataFrame, cosine: float) -> Iterator[pd.DataFrame]:
    """Pairs of whole blocks that may be linked."""
    for length, some in frame.groupby("length", sort=False):
        some = some.reset_index(drop=True)
        codes, key, ball, side = Codes(some, int(length)), some.key.to_numpy(), some.ball.to_numpy(), some.side.to_numpy()
        bucket, x, y = (some[c].to_numpy() for c in ("bucket", "x", "y"))
        new = np.concatenate([[True], (bucket[1:] != bucket[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])])
        block = np.cumsum(new) - 1
        sizes = np.bincount(block)
        small = sizes[block] <= CROWD
        # Small blocks side by side: each row with the one that many places on, as long as that is in its block.
        gap, at = 1, np.flatnonzero(small)
        while len(at):
            at = at[at + gap < len(some)]
            at = at[block[at + gap] == block[at]]
            yield _passed(codes, key, ball, side, at, at + gap, cosine)
            gap += 1
        for one in np.flatnonzero(sizes > CROWD):
            rows = np.flatnonzero(block == one)
            left, right = (rows, rows) if side[rows[0]] == 2 else (rows[side[rows] == 0], rows[side[rows] == 1])
            for start in range(0, len(left), 256):
                i, j = np.meshgrid(left[start:start + 256], right, indexing="ij")
                wanted = ball[i] != ball[j]
                wanted |= ball[i] < 0
                if side[rows[0]] == 2:
                    wanted &= i < j
                yield _passed(codes, key, ball, side, i[wanted], j[wanted], cosine)


def _passed(codes: Codes, key: np.ndarray, ball: np.ndarray, side: np.ndarray, i: np.ndarray, j: np.ndarray, cosine: float) -> pd.DataFrame:
    wanted = ((ball[i] != ball[j]) | (ball[i] < 0)) & ((side[i] == 2) | (side[i] != side[j])) & (key[i] != key[j])
    i, j = i[wanted], j[wanted]
    passed = codes.may_link(i, j, cosine)
    a, b = key[i[passed]], key[j[passed]]
    return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})


def linked_vectors(embeddings: DataFrame, cosine: float = LEAST_COSINE) -> DataFrame:
    """``vec_id, n_links, component_id, kept``: each row with the number of other rows linked with it.

    Rows at ``cosine`` (> 0) or more are linked; vectors of different length never are. Vectors that are NULL, empty or
    zero or hold NULL or numbers that are not finite link with nothing and are kept. Repeated rows are linked copies. A
    component's id is its least vec_id (NULL if none has one); kept are the rows with that id. Every pair recomputed is
    exact, and every link but one in 1 / ``MISSED`` of those right at ``cosine`` is found, more above it. An empty table
    gives no rows; other columns are ignored.
    """
    rows = unit_vectors(embeddings)
    groups = rows.where("digest IS NOT NULL").groupBy("digest", "unit").agg(F.min("vec_id").alias("least_id"), F.count("*").alias("n"))
    vectors = stored(groups.withColumn("key", F.monotonically_increasing_id()), "vectors")
    codes = coded(vectors, vectors.count(), cosine)
    members = balls(codes, vectors, cosine)
    pairs = stored(candidates(codes, members, cosine), "candidates")
    links = stored(_cosines(pairs, vectors).where(F.col("cosine") >= cosine).select("a", "b"), "links")

    sizes = vectors.select("key", "n").join(members, "key", "left")
    whole = sizes.where("ball IS NOT NULL").groupBy("ball").agg(F.sum("n").alias("in_ball"), F.min("key").alias("first"), F.count("*").alias("members"))
    placed = stored(lookup(sizes, whole, ["ball"], ["in_ball", "first"], size="members", row_id="key"), "placed")
    ends = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    outside = ends.join(placed.select(F.col("key").alias("b"), "n"), "b").groupBy(F.col("a").alias("key")).agg(F.sum("n").alias("outside"))
    # A ball holds together by edges to its first member.
    edges = links.unionByName(placed.where("first IS NOT NULL").select(F.col("key").alias("a"), F.col("first").alias("b")))
    roots = components(edges)
    counted = placed.join(outside, "key", "left").join(roots.withColumnRenamed("node", "key"), "key", "left").select(
        "key", F.coalesce("root", "key").alias("root"),
        (F.coalesce("in_ball", "n") - 1 + F.coalesce("outside", F.lit(0))).alias("n_links"))
    facts = stored(vectors.select("key", "digest", "least_id", "n").join(counted, "key"), "facts")
    ids = facts.groupBy("root").agg(F.min("least_id").alias("component_id"), F.count("*").alias("texts"))
    named = lookup(facts.select("root", "digest", "n", "n_links", "key"), ids, ["root"], ["component_id"], size="texts", row_id="key")
    linked = lookup(rows.where("digest IS NOT NULL").select("row", "vec_id", "digest"), named.select("digest", "n", "n_links", "component_id"),
                    ["digest"], ["n_links", "component_id"], size="n", row_id="row").select("vec_id", "n_links", "component_id")
    alone = rows.where("digest IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
