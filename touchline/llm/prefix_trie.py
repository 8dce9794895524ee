"""Prefix trie of conversations, built level by level.

A node is a distinct sequence of first turns. It is named by its depth and the smallest conv_id among the conversations that begin
with it (its members).

How it scales
1. Turns are numbered by a range sort, not by a window, so a conversation with a third of all rows spreads over tasks. From there on turns are
   a digest and a number of bytes; texts don't move.
2. Per depth, live conversations are grouped by (node, digest of the next turn); the group's smallest conv_id names the node below. Sums are
   partial before rows move, and the join back has one row a group, so a first turn shared by a third of all can be split.
   A conversation that is alone in its node leaves the loop: the rest of it is a chain, taken from its turns in one join. So there are
   as many rounds as turns that two conversations have in common, however long some are.
3. Reverse joins, level by level, roll up leaves and savings.
4. A list of ends is never held: ids are range-sorted, formatted in pieces, and pieces run through SHA-256 in order.

Rows with a null conv_id belong to no conversation; null role or text is an empty one; turns with one number are ordered by role and text,
repeated rows are turns of their own; an empty table has no node; columns other than conv_id, turn, role and text are never read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import stage

#: levels whose digests a conversation brings along at once
BLOCK = 8
#: ids of a formatted piece of a list of ends
PIECE = 50_000


class Trie(NamedTuple):
    """``nodes``: depth, conv_id, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens; ``ends``: depth, node, conv_id of each
    conversation that ends in a node with more members than one (others: the member itself, at its last turn)."""

    nodes: DataFrame
    ends: DataFrame


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """conv_id, digest, bytes, role, text in order -> with the place of each turn among those of its conversation in this task."""
    part, last, n = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        if not len(batch):
            continue
        conv = batch.column(0).to_numpy()
        begins = np.flatnonzero(np.concatenate([[True], conv[1:] != conv[:-1]]))
        place = np.arange(len(conv)) - np.repeat(begins, np.diff([*begins, len(conv)])) + 1
        if conv[0] == last:
            place[: begins[1] if len(begins) > 1 else None] += n
        last, n = conv[-1], int(place[-1])
        yield pa.record_batch([*batch.columns, pa.array(place, pa.int64()), pa.array(np.full(len(conv), part), pa.int64())], names=[*batch.schema.names, "place", "part"])


def numbered(turns: DataFrame) -> DataFrame:
    """conv_id, pos (from 1 by turn, null first, then role and text), key (digest of role and text), bytes (of the text), role, text."""
    rows = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")])
    order = ["conv_id", F.asc_nulls_first("turn"), "role", "text"]
    digest = F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256))
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", digest.alias("key"), F.octet_length("text").cast("long").alias("bytes"), "role", "text")
    placed = stage(ranged.mapInArrow(_numbered, "conv_id long, key binary, bytes long, role string, text string, place long, part long"), "trie-turns")
    # a row for each task: where its last conversation goes on in the next ones, they start with what came before
    last = placed.groupBy("part").agg(F.min("conv_id").alias("first"), F.max("conv_id").alias("conv_id"), F.max_by("place", F.struct("conv_id", "place")).alias("n"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    both = last.select("part", "conv_id", "n").unionByName(last.where("first <> conv_id").select("part", F.col("first").alias("conv_id"), F.lit(0).cast("long").alias("n")))
    offsets = both.withColumn("before", F.sum("n").over(before)).where("before > 0").select("part", "conv_id", "before")
    return placed.join(F.broadcast(offsets), ["part", "conv_id"], "left").select("conv_id", (F.col("place") + F.coalesce("before", F.lit(0))).alias("pos"), "key", "bytes", "role", "text")


def branched(turns: DataFrame, family: int = 5, heads: int = 9) -> tuple[DataFrame, DataFrame]:
    """Numbered turns -> (turns, conversations) with every conversation c rebuilt: the first h turns of c - c % family (all if it has fewer, none
    if there is no such conversation), then its own after its first h; h = crc32(c in decimal) % heads. ``turns``: conv_id, depth, key,
    bytes, and from_conv_id, from_pos where the turn's text is found; ``conversations``: conv_id, length."""
    own = turns.groupBy("conv_id").agg(F.max("pos").alias("n"))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads
    own = own.withColumns({"h": h, "base": F.col("conv_id") - F.col("conv_id") % family})
    convs = own.join(own.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base")), "base", "left")
    convs = convs.select("conv_id", "base", "h", F.least("h", F.coalesce("n_base", F.lit(0))).alias("head"), "n")
    convs = stage(convs.withColumn("length", F.col("head") + F.greatest(F.col("n") - F.col("h"), F.lit(0))), "trie-conversations")
    tails = turns.select("conv_id", "pos", "key", "bytes").join(convs.select("conv_id", "h", "head"), "conv_id").where("pos > h")
    tails = tails.select("conv_id", (F.col("head") + F.col("pos") - F.col("h")).alias("depth"), "key", "bytes", F.col("conv_id").alias("from_conv_id"), F.col("pos").alias("from_pos"))
    first = turns.where(F.col("pos") < heads).select(F.col("conv_id").alias("base"), "pos", "key", "bytes")
    first = first.join(convs.where("head > 0").select("conv_id", "base", "head"), "base").where("pos <= head")
    first = first.select("conv_id", F.col("pos").alias("depth"), "key", "bytes", F.col("base").alias("from_conv_id"), F.col("pos").alias("from_pos"))
    return stage(tails.unionByName(first), "trie-rebuilt"), convs.select("conv_id", "length")


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def build(turns: DataFrame, convs: DataFrame) -> Trie:
    """The trie of ``convs`` (conv_id, length) with ``turns`` (conv_id, depth from 1, key, bytes); each is read a few times and should be staged."""
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).first()
    nothing = F.lit(None).cast("long")
    many = convs.where(F.lit(root.n_convs > 1)).withColumn("node", F.lit(root.conv_id).cast("long"))
    levels = [convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0").select(F.lit(0).alias("depth"), "conv_id", nothing.alias("parent"), "n_convs", F.lit(0).cast("long").alias("bytes"))]
    ends = [many.where("length = 0").select(F.lit(0).alias("depth"), "node", "conv_id")]
    depth, live = 0, many
    while root.n_convs > 1:
        depth += 1
        name = f"k{depth}"
        if depth % BLOCK == 1:
            near = turns.where(F.col("depth").between(depth, depth + BLOCK - 1)).groupBy("conv_id")
            live = live.join(near.agg(*[F.max(F.when(F.col("depth") == d, F.struct("key", "bytes"))).alias(f"k{d}") for d in range(depth, depth + BLOCK)]), "conv_id")
            live = stage(live, "trie-live")
        on = live.where(F.col("length") >= depth).withColumn("key", F.col(f"{name}.key"))
        group = on.groupBy(F.col("node").alias("parent"), "key").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max(f"{name}.bytes").alias("bytes"))
        group = stage(group.withColumn("depth", F.lit(depth)), "trie-level")
        levels.append(group.select("depth", "conv_id", "parent", "n_convs", "bytes"))
        shared = group.where("n_convs > 1")
        if shared.isEmpty():
            break
        rest = [c for c in live.columns if c not in ("node", name)]
        live = on.withColumnRenamed("node", "parent").join(shared.select("parent", "key", F.col("conv_id").alias("node")), ["parent", "key"]).select("node", *rest)
        live = stage(live, "trie-live")
        ends.append(live.where(F.col("length") == depth).select(F.lit(depth).alias("depth"), "node", "conv_id"))
    return Trie(_rolled_up(levels).unionByName(_chains(levels, turns, convs)), _union(ends))


def _rolled_up(levels: list[DataFrame]) -> DataFrame:
    """Nodes with more members than one, from the deepest level up: what its children sum to joins each node."""
    out, below = [], None
    for depth in range(len(levels) - 1, -1, -1):
        level = levels[depth]
        many = level.where("n_convs > 1").withColumn("own", (F.col("n_convs") - 1) * F.col("bytes"))
        if below is None:
            many = many.select("*", *[F.lit(None).cast("long").alias(c) for c in ("children", "leaves", "saved")])
        else:
            sums = below.groupBy(F.col("parent").alias("conv_id")).agg(F.count("*").alias("children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
            many = many.join(sums, "conv_id", "left")
        zero = F.lit(0).cast("long")
        many = many.select("depth", "conv_id", "parent", "n_convs", F.coalesce("children", zero).alias("n_children"), F.coalesce("leaves", zero + 1).alias("n_leaves"), (F.col("own") + F.coalesce("saved", zero)).alias("saved_tokens"))
        many = stage(many, "trie-rolled")
        out.append(many)
        below = many.select("parent", "n_leaves", "saved_tokens").unionByName(level.where("n_convs = 1").select("parent", (zero + 1).alias("n_leaves"), zero.alias("saved_tokens")))
    return _union(out).withColumnRenamed("parent", "parent_conv_id")


def _chains(levels: list[DataFrame], turns: DataFrame, convs: DataFrame) -> DataFrame:
    """Nodes with one member: from where a conversation is alone to its last turn."""
    alone = _union([x.where("n_convs = 1").select("depth", "conv_id", "parent") for x in levels]).join(convs, "conv_id")
    zero = F.lit(0).cast("long")
    node = lambda depth, parent: [depth.cast("int").alias("depth"), "conv_id", parent.alias("parent_conv_id"), (zero + 1).alias("n_convs"), (depth < F.col("length")).cast("long").alias("n_children"), (zero + 1).alias("n_leaves"), zero.alias("saved_tokens")]
    root = alone.where("depth = 0").select(*node(F.col("depth"), F.col("parent")))
    rows = turns.select("conv_id", F.col("depth").alias("at")).join(alone.withColumn("depth", F.col("depth").cast("long")), "conv_id").where("at >= depth and at > 0")
    return root.unionByName(rows.select(*node(F.col("at"), F.when(F.col("at") == F.greatest("depth", F.lit(1)), F.coalesce("parent", "conv_id")).otherwise(F.col("conv_id")))))


def _pieces(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """depth, node, conv_id in order -> the ids of each node in decimal, joined by commas, in pieces: depth, node, first id, ids."""
        for batch in batches:
            depth, node, conv = (batch.column(i).to_numpy() for i in range(3))
            if not len(conv):
                continue
            cuts = np.flatnonzero(np.concatenate([[True], (depth[1:] != depth[:-1]) | (node[1:] != node[:-1])]))
            cuts = np.unique(np.concatenate([cuts, np.arange(0, len(conv), size)]))
            text = [",".join(map(str, x.tolist())) for x in np.split(conv, cuts[1:])]
            yield pa.record_batch({"depth": depth[cuts], "node": node[cuts], "first": conv[cuts], "ids": pa.array(text, pa.string())})

    return run


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces in order -> depth, node, SHA-256 of the node's pieces joined by commas."""
    now, digest = None, None
    for batch in batches:
        done = []
        for depth, node, ids in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3)), strict=True):
            if (depth, node) != now:
                if now:
                    done.append((*now, digest.hexdigest()))
                now, digest = (depth, node), hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(ids.encode())
        if done:
            yield pa.record_batch(list(map(pa.array, zip(*done, strict=True))), names=["depth", "conv_id", "ends_sha256"])
    if now:
        yield pa.record_batch({"depth": [now[0]], "conv_id": [now[1]], "ends_sha256": [digest.hexdigest()]})


def with_ends(trie: Trie, piece: int = PIECE) -> DataFrame:
    """The nodes with ends_sha256: of the decimal ids of conversations that end there, ascending, joined by commas (none: of nothing)."""
    order = ["depth", "node", "conv_id"]
    pieces = trie.ends.select(F.col("depth").cast("long").alias("depth"), "node", "conv_id").repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_pieces(piece), "depth long, node long, first long, ids string")
    digests = pieces.repartition("depth", "node").sortWithinPartitions("depth", "node", "first").mapInArrow(_digests, "depth long, conv_id long, ends_sha256 string")
    alone = F.when((F.col("n_convs") == 1) & (F.col("n_children") == 0), F.sha2(F.col("conv_id").cast("string").cast("binary"), 256))
    none = F.lit(hashlib.sha256(b"").hexdigest())
    joined = trie.nodes.where("n_convs > 1").withColumn("depth", F.col("depth").cast("long")).join(digests, ["depth", "conv_id"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", none))
    return joined.unionByName(trie.nodes.where("n_convs = 1").withColumns({"depth": F.col("depth").cast("long"), "ends_sha256": F.coalesce(alone, none)}))


def with_text(nodes: DataFrame, rebuilt: DataFrame, turns: DataFrame) -> DataFrame:
    """The nodes with role and text of their last turn (null at the root): ``rebuilt`` tells where it is, ``turns`` has it."""
    places = nodes.join(rebuilt.select("conv_id", "depth", "from_conv_id", "from_pos"), ["conv_id", "depth"], "left")
    text = turns.select(F.col("conv_id").alias("from_conv_id"), F.col("pos").alias("from_pos"), "role", "text")
    return places.join(text, ["from_conv_id", "from_pos"], "left").drop("from_conv_id", "from_pos")


def tree(conversations: DataFrame) -> DataFrame:
    """All of it for a table of conversations (conv_id, turn, role, text): branched, built, with the digests of ends."""
    turns = numbered(conversations)
    rebuilt, convs = branched(turns)
    return with_ends(build(rebuilt, convs))
