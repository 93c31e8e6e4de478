"""Prefix trie of conversations from sorted shards and the skeleton of their splitters.

A turn is known by the md5 of its role and text (16 bytes) and its text's length; a conversation is the row of its
turns, so texts are not shuffled.  Joining the keys of a conversation's turns gives its path, and byte order of
paths is the order of a depth-first walk of the trie.

1. Paths are range-partitioned and sorted by (path, ``conv_id``) into shards, which are written once.  Equal paths
   and paths with a common prefix may fill many shards.
2. The splitters between neighbouring shards (first path of one, last path of the one before) name every node that
   lies in more than one shard: those on their common prefixes.  These make the skeleton, a trie that is broadcast;
   it has at most as many paths as there are shards.
3. Each shard is read in order with a stack of the open path.  A node outside the skeleton is complete within its
   shard.  A skeleton node gets a partial aggregate from every shard that holds some of it, and these are summed.
   Its parent lies in the skeleton too, so totals of subtrees add up along the skeleton alone.
4. The ids that end at a skeleton node leave each shard as pieces of text; one stream a node hashes them in order.

A task's memory follows its longest path and, for parents waiting to be complete, the nodes of its shard.

Edge cases: null roles and texts are empty; a null turn number comes first; equal turn numbers are ordered by the
turn's key, repeated rows are repeated turns; rows without ``conv_id`` belong to no conversation; a rebuilt
conversation may have no turns and is then a member of the root; an empty table has no nodes, the root included;
extra columns are not touched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragspark.llm.shared import cut, opened, partitions, sent, written

KEY = 16
PIECE = 1 << 16  # ids of one piece of text
BATCH = 1 << 13

TURN = "struct<key:binary,size:bigint>"
NODE = "depth int, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def original_turns(turns: DataFrame) -> DataFrame:
    """``conv_id, turns``: keys and text lengths of every conversation's turns in order."""
    role = F.coalesce(turns["role"].cast("string"), F.lit(""))
    text = F.coalesce(turns["text"].cast("string"), F.lit(""))
    key = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)))
    one = F.struct(turns["turn"].alias("turn"), key.alias("key"), F.octet_length(text).cast("long").alias("size"))
    return turns.where(turns["conv_id"].isNotNull()).groupBy(turns["conv_id"].cast("long").alias("conv_id")).agg(
        F.transform(F.sort_array(F.collect_list(one)), lambda x: F.struct(x["key"], x["size"])).alias("turns"))


def rebuilt(conversations: DataFrame, source: Column, taken: Column, most: int) -> DataFrame:
    """Every conversation's first ``taken`` turns (at most ``most``) replaced by those of conversation ``source``.

    ``conversations`` has ``conv_id, turns``; the two columns are expressions of ``conv_id``.  A conversation without
    a source loses the turns and gets none.
    """
    own = conversations.select("conv_id", "turns", source.alias("source"), taken.cast("int").alias("taken"))
    heads = conversations.select(F.col("conv_id").alias("head"), F.slice("turns", 1, most).alias("first"))
    heads = heads.join(own.select(F.col("source").alias("head")).distinct(), "head", "left_semi")
    both = own.join(heads, own["source"] == heads["head"], "left")
    empty = F.array().cast(f"array<{TURN}>")
    return both.select("conv_id", F.concat(
        F.slice(F.coalesce("first", empty), F.lit(1), F.col("taken")),
        F.slice("turns", F.col("taken") + 1, F.greatest(F.size("turns") - F.col("taken"), F.lit(0)))).alias("turns"))


def sorted_shards(conversations: DataFrame) -> DataFrame:
    """``shard, path, sizes, conv_id``, sorted by path and id over all shards; written once."""
    hexed = F.array_join(F.transform("turns", lambda t: F.hex(t["key"])), "")
    paths = conversations.select(F.unhex(hexed).alias("path"), F.transform("turns", lambda t: t["size"]).alias("sizes"), "conv_id")
    # written first: drawing the bounds of the ranges reads the paths an extra time
    shards = written(paths, "paths").repartitionByRange(partitions(conversations.sparkSession), "path", "conv_id")
    return cut(shards.sortWithinPartitions("path", "conv_id").withColumn("shard", F.spark_partition_id()))


def common(a: bytes, b: bytes) -> int:
    """Turns that both paths begin with."""
    n = min(len(a), len(b)) // KEY * KEY
    if a[:n] == b[:n]:
        return n // KEY
    x, y = (np.frombuffer(p, np.uint8, n) for p in (a, b))
    return int((x != y).argmax()) // KEY


class Skeleton:
    """The trie of the prefixes that neighbouring shards share; node 0 is the root."""

    def __init__(self, bounds: list[tuple[bytes, bytes]]):
        """``bounds``: first and last path of every shard, in order."""
        self.child: dict[tuple[int, bytes], int] = {}
        self.parent = [-1]
        for (_, last), (first, _) in zip(bounds, bounds[1:]):
            node = 0
            for i in range(common(last, first)):
                step = (node, first[i * KEY : (i + 1) * KEY])
                if step not in self.child:
                    self.child[step] = len(self.parent)
                    self.parent.append(node)
                node = self.child[step]


def skeleton(shards: DataFrame) -> Skeleton:
    ends = shards.groupBy("shard").agg(F.min("path").alias("first"), F.max("path").alias("last")).orderBy("shard")
    return Skeleton([(bytes(r["first"]), bytes(r["last"])) for r in ends.toLocalIterator()])


class Open:
    """A node of the current path, still growing."""

    __slots__ = ("depth", "bone", "size", "least", "members", "children", "leaves", "saved", "ends", "waiting")

    def __init__(self, depth: int, bone: int, size: int):
        self.depth, self.bone, self.size = depth, bone, size
        self.least, self.members, self.children, self.leaves, self.saved = None, 0, 0, 0, 0
        self.ends = hashlib.sha256() if bone < 0 else []
        self.waiting: list[tuple] = []  # closed children, which lack only this node's smallest member

    def end(self, conv: int, first: bool) -> None:
        if self.bone < 0:
            self.ends.update(b"%d" % conv if first else b",%d" % conv)
        else:
            self.ends.append(conv)


def walk_shard(shared):
    """Rows of kind 0: complete nodes (``bone``: the skeleton parent, else the parent's member is in place); 1: partial
    aggregates of skeleton nodes; 2: pieces of the ids that end there."""
    names = ["kind", "bone", "shard", "piece", "text", "size", "depth", "conv_id", "parent_conv_id", "n_convs", "n_children",
             "n_leaves", "saved_tokens", "ends_sha256"]
    types = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int32(), *[pa.int64()] * 6, pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree: Skeleton = opened(shared)
        stack: list[Open] = []
        out: list[tuple] = []
        shard, before, pieces = None, b"", 0

        def piece(node: Open) -> None:
            nonlocal pieces
            out.append((2, node.bone, shard, pieces, ",".join(map(str, node.ends)), *[None] * 9))
            pieces += 1
            node.ends = []

        def close() -> None:
            node = stack.pop()
            for row in node.waiting:
                out.append((*row[:8], node.least, *row[9:]))
            if node.bone >= 0:
                if node.ends:
                    piece(node)
                out.append((1, node.bone, shard, None, None, node.size, node.depth, node.least, None, node.members, node.children,
                            node.leaves, node.saved, None))
            else:
                node.leaves += not node.children
                node.saved += (node.members - 1) * node.size
                row = (0, -1, None, None, None, None, node.depth, node.least, None, node.members, node.children, node.leaves,
                       node.saved, node.ends.hexdigest())
                top = stack[-1]
                top.children += 1
                top.leaves += node.leaves
                top.saved += node.saved
                if top.bone >= 0:
                    out.append((0, top.bone, *row[2:]))
                else:
                    top.waiting.append(row)
            if stack:
                top = stack[-1]
                top.members += node.members
                top.least = node.least if top.least is None else min(top.least, node.least)

        def flushed(least: int) -> Iterator[pa.RecordBatch]:
            while len(out) > least:
                part = out[:BATCH]
                del out[:BATCH]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part), types)], names=names)

        for batch in batches:
            for path, sizes, conv, number in zip(*(c.to_pylist() for c in batch.columns)):
                same = common(path, before) if stack else 0
                while len(stack) > same + 1:
                    close()
                if not stack:
                    shard, before = number, path
                    stack.append(Open(0, 0, 0))
                for d in range(len(stack) - 1, len(path) // KEY):
                    bone = stack[-1].bone
                    if bone >= 0:
                        bone = tree.child.get((bone, path[d * KEY : (d + 1) * KEY]), -1)
                    stack.append(Open(d + 1, bone, sizes[d]))
                node = stack[-1]
                node.end(conv, not node.members)
                if node.bone >= 0 and len(node.ends) >= PIECE:
                    piece(node)
                node.members += 1
                node.least = conv if node.least is None else min(node.least, conv)
                before = path
                yield from flushed(BATCH)
        while stack:
            close()
            yield from flushed(BATCH)
        yield from flushed(0)

    return run


def hash_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``bone, ends_sha256`` from pieces sorted by (bone, shard, piece)."""
    now, digest = None, None
    done: list[tuple[int, str]] = []
    for batch in batches:
        for bone, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if bone != now:
                if now is not None:
                    done.append((now, digest.hexdigest()))
                now, digest = bone, hashlib.sha256(text.encode())
            else:
                digest.update(b"," + text.encode())
    if now is not None:
        done.append((now, digest.hexdigest()))
    yield pa.RecordBatch.from_arrays(
        [pa.array([x for x, _ in done], pa.int64()), pa.array([x for _, x in done], pa.string())], names=["bone", "ends_sha256"])


def skeleton_nodes(parts: DataFrame, tree: Skeleton) -> DataFrame:
    """Complete skeleton nodes: partial aggregates summed by node, then added up along the skeleton."""
    spark = parts.sparkSession
    n = len(tree.parent)
    links = spark.createDataFrame(pa.table({"bone": pa.array(range(n), pa.int64()), "parent": pa.array(tree.parent, pa.int64())}))
    own = parts.where("kind = 1").groupBy("bone").agg(
        F.first("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.first("size").alias("size"), F.sum("n_convs").alias("own_convs"),
        F.sum("n_children").alias("own_children"), F.sum("n_leaves").alias("own_leaves"), F.sum("saved_tokens").alias("own_saved"))
    ends = parts.where("kind = 2").select("bone", "text", "shard", "piece").repartition(partitions(spark), "bone").sortWithinPartitions(
        "bone", "shard", "piece").select("bone", "text").mapInArrow(hash_ends, "bone long, ends_sha256 string")
    known = links.join(own, "bone").join(ends, "bone", "left").coalesce(1).sortWithinPartitions(F.desc("bone"))

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row a skeleton node, children before parents."""
        rows = [r for batch in batches for r in batch.to_pylist()]
        at = {r["bone"]: r for r in rows}
        for r in rows:
            r |= {"n_convs": r["own_convs"], "n_children": r["own_children"], "n_leaves": r["own_leaves"], "saved_tokens": r["own_saved"]}
        for r in rows:
            r["n_leaves"] += not r["n_children"]
            r["saved_tokens"] += (r["n_convs"] - 1) * r["size"]
            top = at.get(r["parent"])
            r["parent_conv_id"] = None
            if top is not None:
                top["n_children"] += 1
                top["n_leaves"] += r["n_leaves"]
                top["saved_tokens"] += r["saved_tokens"]
        for r in rows:
            if r["parent"] in at:
                r["parent_conv_id"] = at[r["parent"]]["conv_id"]
            r["ends_sha256"] = r["ends_sha256"] or hashlib.sha256().hexdigest()
        names = ["bone", "depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
        types = [pa.int64(), pa.int32(), *[pa.int64()] * 6, pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in zip(names, types)], names=names)

    return known.mapInArrow(add_up, f"bone long, {NODE}")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row a node from ``conv_id, turns`` (see ``original_turns``, ``rebuilt``).

    ``conv_id`` is the smallest member; ``depth``; ``parent_conv_id``; ``n_convs``, ``n_children``, ``n_leaves``;
    ``saved_tokens``: bytes of the subtree's texts that need not be repeated; ``ends_sha256``: of the ids that end here.
    """
    spark = conversations.sparkSession
    shards = sorted_shards(conversations)
    tree = skeleton(shards)
    parts = written(shards.select("path", "sizes", "conv_id", "shard").mapInArrow(
        walk_shard(sent(spark.sparkContext, tree)),
        f"kind int, bone long, shard int, piece int, text string, size long, {NODE}"), "trie")
    bones = cut(skeleton_nodes(parts, tree))
    columns = ["n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    flesh = parts.where("kind = 0").join(
        bones.select(F.col("bone").alias("above"), F.col("conv_id").alias("above_conv")), F.col("bone") == F.col("above"), "left")
    flesh = flesh.select("conv_id", F.col("depth").cast("long").alias("depth"), F.coalesce("parent_conv_id", "above_conv").alias("parent_conv_id"), *columns)
    return flesh.unionByName(bones.select("conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", *columns))
