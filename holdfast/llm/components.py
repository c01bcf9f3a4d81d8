"""Connected components by alternating star contraction; every round is a written table.

``similar_components`` finds the links too, among sets that meet in buckets.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from holdfast.llm.scratch import dropped, stored
from holdfast.scale import lookup

# By how much the sets of a bucket that are compared with all others grow from one round to the next, where sets meet by
# their rarest elements. It does not change the result.
MORE_FIRSTS = 16
# Ends of its buckets that a set is compared with, whatever the number of its buckets; the rest meet by their rarest
# elements. It does not change which sets that meet are joined.
NEAREST_ENDS = 4
# A bucket of so many sets, which may well have met by chance, is settled by all its pairs: at most seven for each two sets.
# It does not change which sets that meet are joined.
SMALL_BUCKET = 8

# Sets (``node, elements``), or how to get those of the nodes (``node``) that are to be compared.
Sets = DataFrame | Callable[[DataFrame], DataFrame]


def _with_least(edges: DataFrame) -> DataFrame:
    """Edges ``(u, v)`` with ``m``, the least of ``u`` and its neighbours.

    The least is found by a partial aggregate; the edges of a hub meet it in a join that adaptive execution may split.
    """
    return edges.join(edges.groupBy("u").agg(F.min("v").alias("least")), "u").select("u", "v", F.least("u", "least").alias("m"))


def _is_done(edges: DataFrame) -> bool:
    """Whether every node is either a root or has one edge, to a root."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up + down > 1").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node that an edge ``(a, b)`` of longs touches but the roots; a root is its
    component's least node.

    Loops and repeated edges do no harm; NULL ends are dropped. No edges give no rows.
    """
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
                 "edges")
    while not _is_done(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both).where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = _with_least(stored(large, "edges"))
        following = stored(
            small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "edges")
        dropped(now)
        now = following
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def similar_links(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Those of ``pairs`` (``a, b``) whose ``sets`` (``node, elements``) have a Jaccard similarity of ``least`` or more."""
    of = {side: sets.select(F.col("node").alias(side), F.col("elements").alias(f"of_{side}")) for side in "ab"}
    both = pairs.join(of["a"], "a").join(of["b"], "b")
    shared = F.size(F.array_intersect("of_a", "of_b"))
    # In whole numbers, so that a similarity of exactly the least one counts.
    enough = shared * 100 >= (F.size("of_a") + F.size("of_b") - shared) * round(least * 100)
    return both.where(enough).select("a", "b")


def _met_ends(members: DataFrame, least: float) -> DataFrame:
    """``node, other``: sets (``members`` as in ``similar_components``) with the first or the last set of one of their
    buckets, in an order by hash, where the two are near enough in size; once for each bucket and end.

    The order is the same in all buckets: sets that meet often meet the same ones. The ends of a bucket come from a
    partial aggregate, so its size does not matter.
    """
    end = F.struct(F.xxhash64(F.lit("end"), "node").alias("place"), F.col("node").alias("other"), F.col("n").alias("other_n"))
    ends = stored(members.groupBy("bucket").agg(F.count("*").alias("size"), F.min(end).alias("first"), F.max(end).alias("last"))
                  .where("size > 1").select("bucket", "size", F.array("first", "last").alias("ends")), "ends")
    met = lookup(members.withColumn("row", F.xxhash64("node", "bucket")), ends, ["bucket"], ["ends"], size="size", row_id="row")
    # At most the smaller set is shared.
    alike = F.least("n", "other_n") * 100 >= F.greatest("n", "other_n") * round(least * 100)
    return met.where("ends is not null").select("node", "n", F.inline("ends")).where("node <> other").where(alike).select("node", "other")


def _either_way(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()


def end_links(members: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """``a, b``: sets (``members`` as in ``similar_components``) with the first or the last set of one of their buckets
    (``_met_ends``), each compared only once, where the two are similar enough."""
    pairs = stored(_either_way(_met_ends(members, least)), "pairs")
    links = stored(similar_links(pairs, sets, least), "links")
    dropped(pairs)
    return links


def _links_of(pairs: DataFrame, sets: Sets, least: float, likely: Callable[[DataFrame], DataFrame] | None) -> DataFrame:
    """Those of ``pairs`` that are similar enough. Only sets of pairs that are ``likely`` are read."""
    if likely is not None:
        met_by_chance, pairs = pairs, stored(likely(pairs), "pairs")
        dropped(met_by_chance)
    if pairs.isEmpty():
        return pairs
    if isinstance(sets, DataFrame):
        links = stored(similar_links(pairs, sets, least), "links")
    else:
        ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        compared = sets(stored(ends, "compared"))
        links = stored(similar_links(pairs, compared, least), "links")
        dropped(compared)
    dropped(pairs)
    return links


def nearest_end_links(members: DataFrame, sets: Sets, least: float,
                      likely: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``a, b``: sets with those ``NEAREST_ENDS`` that they meet in most buckets, of the ends of their buckets
    (``_met_ends``), where the two are similar enough.

    The pairs grow with the number of sets, however many ends the buckets of a large group of near copies have. ``likely``
    keeps the pairs (``a, b``) that are worth reading their sets for.
    """
    often = Window.partitionBy("node").orderBy(F.desc("times"), F.xxhash64(F.lit("end"), "other"), "other")
    met = _met_ends(members, least).groupBy("node", "other").agg(F.count("*").alias("times"))
    pairs = stored(_either_way(met.withColumn("nth", F.row_number().over(often)).where(F.col("nth") <= NEAREST_ENDS)), "pairs")
    return _links_of(pairs, sets, least, likely)


def small_bucket_links(members: DataFrame, sets: Sets, least: float,
                       likely: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``a, b``: sets of one bucket (``members`` with ``root``) that are in different components, each with each, where the
    two are similar enough. For buckets of few sets; ``likely`` as in ``nearest_end_links``."""
    one = F.struct("node", "root", "n")
    both = (members.groupBy("bucket").agg(F.array_sort(F.collect_list(one)).alias("sets"))
            .select("sets", F.posexplode("sets").alias("at", "one"))
            .select("one", F.explode(F.slice("sets", F.lit(1), F.col("at"))).alias("two")))
    alike = F.least("one.n", "two.n") * 100 >= F.greatest("one.n", "two.n") * round(least * 100)
    pairs = (both.where(F.col("one.root") != F.col("two.root")).where(alike)
             .select(F.col("two.node").alias("a"), F.col("one.node").alias("b")).distinct())
    return _links_of(stored(pairs, "pairs"), sets, least, likely)


def _linked(members: DataFrame, sets: DataFrame, least: float, found: DataFrame) -> DataFrame:
    """``found`` (``a, b``) with the links of ``members`` (``node, root, bucket, n, at``).

    The first sets of a bucket are compared with all others, more of them in every round, until all were compared or the
    bucket is one component. The order is the same in all buckets. Sets in one component are not compared, nor
    those that cannot share enough: ``at`` elements of a set of ``n`` are known not to be shared.
    """
    met = Window.partitionBy("bucket")
    members = stored(members.withColumn("size", F.count("*").over(met)).where("size > 1")
                     .withColumn("place", F.row_number().over(met.orderBy(F.xxhash64("node"), "node"))), "members")
    first = 1
    while not members.isEmpty():
        others = members.where(F.col("place").between(first, first * MORE_FIRSTS - 1)).select(
            "bucket", F.col("place").alias("at_place"), F.col("node").alias("other"), F.col("root").alias("other_root"),
            (F.col("n") - F.col("at")).alias("other_rest"), F.col("n").alias("other_n"))
        most = F.least(F.col("n") - F.col("at"), "other_rest")
        alike = most * 100 >= (F.col("n") + F.col("other_n") - most) * round(least * 100)
        pairs = (members.join(others, "bucket").where("place > at_place and root <> other_root").where(alike)
                 .select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct())
        links = stored(similar_links(stored(pairs, "pairs"), sets, least), "links")
        found = found.unionByName(links)
        first *= MORE_FIRSTS
        # Buckets go on that have sets left to be first and are not one component yet.
        rest = members.where(F.col("size") > first)
        if rest.isEmpty():
            break
        rooted = rest if links.isEmpty() else rooted_in(rest.drop("root"), components(found))
        following = stored(rooted.withColumns({"low": F.min("root").over(met), "high": F.max("root").over(met)})
                           .where("low <> high").drop("low", "high"), "members")
        dropped(members)
        members = following
    return found


def rooted_in(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """``nodes`` with the ``root`` of their component; that of a node without links is itself."""
    return nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def _mixed_buckets(members: DataFrame, roots: DataFrame) -> DataFrame:
    """``bucket, size`` of the buckets that are not one component."""
    return stored(rooted_in(members, roots).groupBy("bucket")
                  .agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("size"))
                  .where("low <> high").select("bucket", "size"), "mixed")


def _rarest(sets: DataFrame, least: float) -> DataFrame:
    """``node, bucket, n, at``: the rarest elements of each set, as many as two sets that share ``least`` of theirs need to
    have one in common, in an order that is the same for all sets. Elements of one set alone come first and are left out."""
    each = sets.select("node", F.size("elements").alias("n"), F.explode("elements").alias("bucket"))
    common = stored(each.groupBy("bucket").agg(F.count("*").alias("sets")).where("sets > 1"), "common")
    known = lookup(each.withColumn("row", F.xxhash64("node", "bucket")), common, ["bucket"], ["sets"], size="sets", row_id="row")
    ordered = (known.where("sets is not null").groupBy("node", "n")
               .agg(F.array_sort(F.collect_list(F.struct("sets", "bucket"))).alias("shared")))
    return (ordered.select("node", "n", (F.col("n") - F.size("shared")).alias("own"), F.posexplode("shared").alias("place", "element"))
            .select("node", F.col("element.bucket").alias("bucket"), "n", (F.col("own") + F.col("place")).alias("at"))
            .where((F.col("n") - F.col("at")) * 100 >= F.col("n") * round(least * 100)))


def similar_components(members: DataFrame, sets: Sets, least: float,
                       likely: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``node, root`` as ``components`` has them, of the sets that are linked: they meet in a bucket of ``members``
    (``node, bucket, n``, the size of the set) and share ``least`` of their elements by Jaccard similarity.

    Each set is compared whole with a few ends of its buckets at first (``likely`` as in ``nearest_end_links``). Every
    bucket that these do not join (copies with too many edits, texts round a common passage) is left. A small one, where
    most often sets met by chance, is settled by its pairs. The sets of others meet anew where they share one of their
    rarest elements: sets that are similar enough always do, and how rare these are bounds what the two can share. No
    link within a bucket is lost that way.
    """
    found = nearest_end_links(members, sets, least, likely)
    roots = components(found)
    mixed = _mixed_buckets(members, roots)
    small = members.join(mixed.where(F.col("size") <= SMALL_BUCKET), "bucket", "left_semi")
    more = small_bucket_links(rooted_in(small, roots), sets, least, likely)
    if not more.isEmpty():
        found = found.unionByName(more)
        roots = components(found)
    # Those that the links of the small ones have joined are no longer mixed.
    large = stored(members.join(mixed.where(F.col("size") > SMALL_BUCKET), "bucket", "left_semi"), "large")
    left = stored(large.join(_mixed_buckets(large, roots), "bucket", "left_semi").select("node").distinct(), "left")
    if left.isEmpty():
        return roots
    crowded = stored(sets.join(left, "node", "left_semi"), "crowded") if isinstance(sets, DataFrame) else sets(left)
    found = _linked(rooted_in(_rarest(crowded, least), roots), crowded, least, found)
    dropped(crowded)
    return components(found)
