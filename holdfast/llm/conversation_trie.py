"""Prefix trie of conversations by ROLLUP over positional turn columns.

Every distinct turn (role and text) gets a number. The first turns of a conversation are the columns ``t1 .. t8``, and
``GROUP BY node, ROLLUP (t1, .., t8)`` yields the nodes of all depths at once; ``grouping_id`` tells the depth. Longer
conversations go on in blocks of further columns, keyed by the node in which the block before ended. A node is known by
its depth and its least member, so ``node`` is one number. A second ROLLUP, over the nodes and from the last block to the
first, sums what lies below each of them.

No conversation, prefix or list of members is held as one value: turns are numbered by ranges of their order, blocks
have a fixed width, and the digest of a node's conversation ids streams over pieces of them. There are three jobs per
block, so their number follows the longest conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.llm.scratch import new_folder, stored
from holdfast.scale import lookup, running_total

# Turn columns of the first block and of each later one. Most conversations end in the first.
FIRST_BLOCK, NEXT_BLOCKS = 8, 32
# A conversation begins with up to this many turns less one of the first of its family.
MOST_COPIED, FAMILY = 9, 5
# Conversation ids joined into one piece of text before it is hashed.
IDS_IN_PIECE = 4096


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, digest, bytes, id``: one row per row with a conv_id; equal role and text share ``id`` (1 ..).

    Turns are told apart by the SHA-256 of role and text. A very common one is no heavier than others.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = stored(conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"),
        F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256).alias("digest"),
        F.octet_length(text).cast("long").alias("bytes")), "turns")
    ids = stored(turns.groupBy("digest").agg(F.count("*").alias("n")).withColumn("id", F.monotonically_increasing_id() + 1), "ids")
    rows = turns.withColumn("row", F.monotonically_increasing_id())
    return lookup(rows, ids, ["digest"], ["id"], size="n", row_id="row").drop("row")


def positions(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The turns with their place ``pos`` (1 ..) in their conversation, and ``conv_id, n_turns, before``.

    Order: turn (NULL first), then role and digest. Ranges of the whole order are counted side by side, so one very long
    conversation is spread over tasks.
    """
    order = [F.col("conv_id").asc(), F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("digest").asc()]
    ranked = stored(running_total(turns.withColumn("one", F.lit(1)), "one", order, "rank")
                    .select("conv_id", "rank", "id", "bytes"), "ranked")
    sizes = stored(ranked.groupBy("conv_id").agg(F.count("*").alias("n_turns"), (F.min("rank") - 1).alias("before")), "sizes")
    placed = lookup(ranked, sizes, ["conv_id"], ["before"], size="n_turns", row_id="rank")
    return placed.select("conv_id", (F.col("rank") - F.col("before")).alias("pos"), "id", "bytes"), sizes


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns ``conv_id, pos, id, bytes`` of every conversation rebuilt, and ``conv_id, length`` of all of them.

    Conversation c takes the first h turns of c - c % 5 and goes on with its own after its first h; h = crc32(c) % 9.
    """
    turns, sizes = positions(numbered_turns(conversations))
    turns = stored(turns, "placed")
    families = sizes.select("conv_id", "n_turns", (F.crc32(F.col("conv_id").cast("string")) % MOST_COPIED).alias("h"),
                            (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("first"))
    heads = sizes.select(F.col("conv_id").alias("first"), F.col("n_turns").alias("in_first"))
    convs = stored(families.join(heads, "first", "left").select(
        "conv_id", "first", "h", "n_turns", F.least("h", F.coalesce("in_first", F.lit(0))).alias("copied")), "convs")
    own = lookup(turns, convs, ["conv_id"], ["h", "copied"], size="n_turns", row_id="pos").where("pos > h").select(
        "conv_id", (F.col("pos") - F.col("h") + F.col("copied")).alias("pos"), "id", "bytes")
    # At most MOST_COPIED - 1 turns of a conversation meet the few of its family.
    copied = turns.where(F.col("pos") < MOST_COPIED).withColumnRenamed("conv_id", "first").join(
        convs.select("conv_id", "first", "h"), "first").where("pos <= h").select("conv_id", "pos", "id", "bytes")
    lengths = convs.select("conv_id", (F.col("copied") + F.greatest(F.col("n_turns") - F.col("h"), F.lit(0))).alias("length"))
    return own.unionByName(copied), lengths


def _start(block: int) -> int:
    """Turns before a block."""
    return 0 if block == 0 else FIRST_BLOCK + (block - 1) * NEXT_BLOCKS


def _width(block: int) -> int:
    return FIRST_BLOCK if block == 0 else NEXT_BLOCKS


def in_blocks(turns: DataFrame, lengths: DataFrame) -> tuple[DataFrame, int]:
    """A table of ``block, conv_id, length, turns`` (id and bytes in order), and the number of blocks.

    Every conversation has a row in block 0, those without turns too.
    """
    block = F.when(F.col("pos") <= FIRST_BLOCK, 0).otherwise(1 + F.floor((F.col("pos") - FIRST_BLOCK - 1) / NEXT_BLOCKS))
    parts = turns.withColumn("block", block.cast("int")).groupBy("conv_id", "block").agg(
        F.array_sort(F.collect_list(F.struct("pos", "id", "bytes"))).alias("turns"))
    whole = lengths.withColumn("block", F.explode(F.sequence(
        F.lit(0), F.greatest(F.lit(0), F.ceil((F.col("length") - FIRST_BLOCK) / NEXT_BLOCKS)).cast("int"))))
    path = new_folder(turns.sparkSession, "blocks")
    placed = whole.join(parts, ["conv_id", "block"], "left")
    placed.write.partitionBy("block").parquet(path)
    longest = lengths.agg(F.max("length").alias("n")).first().n or 0
    return turns.sparkSession.read.schema(placed.schema).parquet(path), 1 + max(0, -(-(longest - FIRST_BLOCK) // NEXT_BLOCKS))


def _turn_columns(width: int) -> list[str]:
    return [f"t{i + 1}" for i in range(width)]


def _rolled(rows: DataFrame, width: int, measures: str, root: bool) -> DataFrame:
    """``node``, the turn columns (0: none), ``depth`` in the block and measures of each node of a block.

    A turn column is 0 where the conversation has ended; a set of rows that ends in one is no node of its own. The
    node above the block is returned too, with depth 0, if ``root``.
    """
    turns = _turn_columns(width)
    last = f"get(array({', '.join(turns)}), depth - 1)"
    grouped = rows.sparkSession.sql(
        f"SELECT node, {', '.join(turns)}, CAST({width} - bit_count(grouping_id()) AS INT) AS depth, {measures} FROM {{rows}} "
        f"GROUP BY node, ROLLUP ({', '.join(turns)})", rows=rows)
    kept = F.expr(f"CASE WHEN depth = 0 THEN {str(root).lower()} ELSE {last} <> 0 END")
    return grouped.where(kept).withColumns({t: F.coalesce(t, F.lit(0)) for t in turns})


def _block_nodes(rows: DataFrame, block: int) -> DataFrame:
    """Nodes of a block with least member, members, longest member and the bytes of the last text."""
    width = _width(block)
    measures = "min(conv_id) AS conv_id, count(*) AS n_convs, max(length) AS longest, " + ", ".join(
        f"max(b{i + 1}) AS b{i + 1}" for i in range(width))
    rolled = _rolled(rows, width, measures, root=block == 0)
    texts = ", ".join(f"b{i + 1}" for i in range(width))
    last = F.coalesce(F.expr(f"get(array({texts}), depth - 1)"), F.lit(0))
    return rolled.select("node", *_turn_columns(width), "depth", "conv_id", "n_convs",
                         (F.col("longest") == F.col("depth") + _start(block)).cast("long").alias("leaves"),
                         ((F.col("n_convs") - 1) * last).alias("saved"))


def _as_columns(parts: DataFrame, width: int) -> DataFrame:
    """A block's turns side by side; 0 where there is none."""
    def at(i: int, field: str) -> Column:
        return F.coalesce(F.get("turns", F.lit(i))[field], F.lit(0)).cast("long")
    return parts.select("node", "conv_id", "length", *[at(i, "id").alias(f"t{i + 1}") for i in range(width)],
                        *[at(i, "bytes").alias(f"b{i + 1}") for i in range(width)])


def blocks(table: DataFrame, n_blocks: int) -> tuple[list[DataFrame], DataFrame]:
    """Nodes of each block, and ``conv_id, depth, node``: where each conversation ends."""
    found, ends, nodes_of = [], [], None
    for block in range(n_blocks):
        width, end = _width(block), _start(block) + _width(block)
        parts = table.where(F.col("block") == block).drop("block")
        parts = parts.withColumn("node", F.lit(0).cast("long")) if nodes_of is None else parts.join(nodes_of, "conv_id")
        rows = _as_columns(parts, width)
        nodes = stored(_block_nodes(rows, block), "nodes")
        # Each conversation lies in one node of its depth in the block: the one with the same columns.
        members = nodes.select("node", *_turn_columns(width), F.col("conv_id").alias("at"), "n_convs")
        placed = stored(lookup(rows.select("conv_id", "length", "node", *_turn_columns(width)), members,
                               ["node", *_turn_columns(width)], ["at"], size="n_convs", row_id="conv_id")
                        .select("conv_id", "length", "at"), "members")
        ends.append(placed.where(F.col("length") <= end).select("conv_id", F.col("length").alias("depth"), F.col("at").alias("node")))
        nodes_of = placed.where(F.col("length") > end).select("conv_id", F.col("at").alias("node"))
        found.append(nodes)
    every = ends[0]
    for more in ends[1:]:
        every = every.unionByName(more)
    return found, every


def with_subtrees(found: list[DataFrame]) -> DataFrame:
    """All nodes with sums over their subtrees: ``block, node, path, above, depth, conv_id, n_convs, n_leaves, saved_tokens``.

    ``path`` names a node within its block, ``above`` the one over it.
    """
    below, every = None, None
    for block in reversed(range(len(found))):
        width, nodes = _width(block), found[block]
        if below is not None:
            hanging = below.select(F.col("node").alias("conv_id"), F.lit(width).alias("depth"),
                                   F.col("n_leaves").alias("more_leaves"), F.col("saved_tokens").alias("more_saved"))
            nodes = nodes.join(hanging, ["conv_id", "depth"], "left").withColumns({
                "leaves": F.col("leaves") + F.coalesce("more_leaves", F.lit(0)),
                "saved": F.col("saved") + F.coalesce("more_saved", F.lit(0))})
        measures = ("min(conv_id) AS conv_id, max(n_convs) AS n_convs, sum(leaves) AS n_leaves, sum(saved) AS saved_tokens")
        # The least member and the number of members of a node are those of its whole subtree.
        sums = stored(_rolled(nodes.drop("depth"), width, measures, root=True), "subtrees")
        below = sums.where("depth = 0").select("node", "n_leaves", "saved_tokens")
        turns = F.array(*_turn_columns(width))
        own = (sums if block == 0 else sums.where("depth > 0")).select(
            F.lit(block).alias("block"), "node", F.array_join(F.slice(turns, F.lit(1), F.col("depth")), ",").alias("path"),
            F.when(F.col("depth") > 0, F.array_join(F.slice(turns, F.lit(1), F.col("depth") - 1), ",")).alias("above"),
            (F.col("depth") + _start(block)).cast("long").alias("depth"), "conv_id", "n_convs", "n_leaves", "saved_tokens")
        every = own if every is None else every.unionByName(own)
    return every


def _pieces(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Ids of the same node that follow each other, joined: ``depth, node, least, ids``."""
    for frame in frames:
        if len(frame):
            depth, node = frame.depth.to_numpy(), frame.node.to_numpy()
            begins = np.flatnonzero(np.concatenate([[True], (depth[1:] != depth[:-1]) | (node[1:] != node[:-1])]))
            ids = list(map(str, frame.conv_id))
            starts = [i for a, b in zip(begins, [*begins[1:], len(ids)]) for i in range(a, b, IDS_IN_PIECE)]
            yield pd.DataFrame({"depth": depth[starts], "node": node[starts], "least": frame.conv_id.to_numpy()[starts],
                                "ids": [",".join(ids[a:b]) for a, b in zip(starts, [*starts[1:], len(ids)])]})


def _digests(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """SHA-256 of the pieces of each node, which come one after the other: one running digest, whatever their number."""
    now, digest, done = None, None, []
    for frame in frames:
        for depth, node, ids in zip(frame.depth, frame.node, frame.ids):
            if (depth, node) != now:
                if now is not None:
                    done.append((*now, digest.hexdigest()))
                now, digest = (depth, node), hashlib.sha256(ids.encode())
            else:
                digest.update(b"," + ids.encode())
        yield pd.DataFrame(done, columns=["depth", "node", "ends_sha256"])
        done = []
    if now is not None:
        yield pd.DataFrame([(*now, digest.hexdigest())], columns=["depth", "node", "ends_sha256"])


def ends_digests(ends: DataFrame) -> DataFrame:
    """``depth, conv_id, ends_sha256`` of the nodes in which conversations end."""
    ordered = ends.select("depth", "node", "conv_id").repartitionByRange("depth", "node", "conv_id").sortWithinPartitions(
        "depth", "node", "conv_id")
    pieces = ordered.mapInPandas(_pieces, "depth long, node long, least long, ids string")
    hashed = pieces.repartition("depth", "node").sortWithinPartitions("depth", "node", "least").mapInPandas(
        _digests, "depth long, node long, ends_sha256 string")
    return hashed.withColumnRenamed("node", "conv_id")


def prefix_nodes(conversations: DataFrame) -> DataFrame:
    """One row per distinct beginning of the rebuilt conversations: ``conv_id, depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256``.

    Rows without a conv_id are left out; a NULL role or text is empty; repeated rows are turns of their own. Turns of
    equal number follow each other by role, then by digest of role and text. A conversation of which nothing is left
    ends in the root. An empty table has no node, not even a root. Other columns are ignored.
    """
    turns, lengths = rebuilt(conversations)
    found, ends = blocks(*in_blocks(turns, stored(lengths, "lengths")))
    nodes = stored(with_subtrees(found), "trie")
    # The first nodes of a later block hang from the node that keys them; all others look up the node above.
    children = nodes.where("above IS NOT NULL").groupBy("block", "node", "above").agg(F.count("*").alias("n_below"))
    parents = nodes.select("block", "node", F.col("path").alias("above"), F.col("conv_id").alias("found")).join(
        children, ["block", "node", "above"])
    placed = lookup(nodes, parents, ["block", "node", "above"], ["found"], size="n_below", row_id="conv_id").withColumn(
        "parent_conv_id", F.when((F.col("block") > 0) & (F.col("above") == ""), F.col("node")).otherwise(F.col("found")))
    placed = stored(placed.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_leaves", "saved_tokens"), "nodes")
    counts = placed.where("depth > 0").groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(
        F.count("*").alias("n_children"))
    return (placed.join(counts, ["depth", "conv_id"], "left").join(ends_digests(ends), ["depth", "conv_id"], "left")
            .select("conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
                    "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256")))
