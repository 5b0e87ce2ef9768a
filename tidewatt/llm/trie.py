"""The prefix trie of conversations, from sorted shards under a skeleton of splitter paths.

A conversation is a path: one fixed-width key a turn, so byte order puts every node's members side by side. A sample of
the paths gives splitters, which cut the order (path, conversation) into shards of bounded size. A node that lies in
several shards is a prefix of the splitter between them: those nodes form the skeleton, a small trie that is broadcast.
Each shard is sorted and finishes every other node alone. For skeleton nodes it gives partial aggregates; they are added
up by node, and then along the skeleton from the leaves to the root.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatt.llm.common import materialize, partitions, slices

#: Bytes of a turn's key.
KEY = 16
#: Conversations in a shard, about, and sampled paths for each splitter.
SHARD_ROWS, OVERSAMPLE = 50_000, 16
#: Heads are taken from every fifth conversation, and have fewer turns than this.
EVERY, HEADS = 5, 9


def turn_rows(conversations: DataFrame) -> DataFrame:
    """(conv_id, t) of every turn: t holds its turn number, a 128-bit key of role and text in hex, and UTF-8 bytes.

    Null roles and texts are empty. Turns are ordered by t: by turn number, null first, and equal ones by their keys.
    """
    said = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    key = F.substring(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256), 1, 2 * KEY)
    return said.select("conv_id", F.struct("turn", key.alias("key"), F.octet_length("text").cast("long").alias("size")).alias("t"))


def rebuilt(conversations: DataFrame) -> DataFrame:
    """(conv_id, path, sizes): each conversation's turns after its head is replaced, as keys joined and sizes.

    The head is the first h turns of conversation c - c % 5 (all if fewer, none if it is absent); the turns after the
    conversation's own first h follow. A conversation is one row here: 24 bytes a turn.
    """
    own = materialize(turn_rows(conversations).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts")), "turns")
    heads = own.where(F.pmod("conv_id", F.lit(EVERY)) == 0).select(F.col("conv_id").alias("base"), F.slice("ts", 1, HEADS - 1).alias("head"))
    h = F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(HEADS)).cast("int")
    none = F.expr("cast(array() as array<struct<turn: bigint, key: string, size: bigint>>)")
    met = own.withColumn("base", F.col("conv_id") - F.pmod("conv_id", F.lit(EVERY))).withColumn("h", h).join(heads, "base", "left")
    head = F.when(F.col("h") > 0, F.slice(F.coalesce("head", none), 1, F.greatest("h", F.lit(1)))).otherwise(none)
    rest = F.slice("ts", F.col("h") + 1, F.greatest(F.size("ts") - F.col("h"), F.lit(0)))
    whole = met.select("conv_id", F.concat(head, rest).alias("ts"))
    path = F.unhex(F.array_join(F.transform("ts", lambda t: t["key"]), ""))
    return whole.select("conv_id", path.alias("path"), F.transform("ts", lambda t: t["size"]).alias("sizes"))


def splitters(paths: DataFrame, shard_rows: int) -> list[tuple[bytes, int]]:
    """Cut points (path, conv_id) in ascending order: the rows at or after one belong to the shards behind it.

    Ranks in a sample of OVERSAMPLE paths a shard; what reaches the driver is one path a shard.
    """
    n = paths.count()
    shards = max(partitions(paths.sparkSession), -(-n // shard_rows))
    if n < 2 or shards < 2:
        return []
    share = min(1.0, OVERSAMPLE * shards / n)
    sample = paths.where(F.pmod(F.xxhash64("conv_id"), F.lit(1_000_000)) < int(share * 1_000_000) + 1).select("path", "conv_id")
    # The sample has OVERSAMPLE rows a shard, so one task can order it.
    placed = sample.select("*", F.row_number().over(Window.orderBy("path", "conv_id")).alias("nth"), F.count(F.lit(1)).over(Window.partitionBy()).alias("of"))
    cut = placed.withColumn("place", F.floor(F.col("nth") * shards / F.col("of"))).withColumn("before", F.floor((F.col("nth") - 1) * shards / F.col("of")))
    found = cut.where("nth > 1 and place > before").select("path", "conv_id").collect()
    return sorted({(bytes(r[0]), r[1]) for r in found})


def shared_turns(a: bytes, b: bytes) -> int:
    """Turns that two paths share from their start."""
    n, most = 0, min(len(a), len(b))
    while n < most and a[n : n + KEY] == b[n : n + KEY]:
        n += KEY
    return n // KEY


class Skeleton:
    """The trie of the splitter paths: nodes numbered as a walk in path order meets them, the root 0.

    `numbers[i][d]` is the node at depth d of splitter i; a node's subtree is its own number to `last`.
    """

    def __init__(self, cuts: list[tuple[bytes, int]]):
        self.cuts, self.numbers, self.parent = cuts, [], [-1]
        before, known = b"", [0]
        for path, _ in cuts:
            same = shared_turns(before, path)
            known = known[: same + 1]
            for _ in range(same, len(path) // KEY):
                self.parent.append(known[-1])
                known.append(len(self.parent) - 1)
            self.numbers.append(np.array(known, "i4"))
            before = path

    def rows(self) -> list[tuple[int, int, int]]:
        """(node, parent, last) of each node."""
        last = list(range(len(self.parent)))
        for node in range(len(last) - 1, 0, -1):
            last[self.parent[node]] = max(last[self.parent[node]], last[node])
        return list(zip(range(len(last)), self.parent, last))


class Node:
    """A node under construction: its members and what its finished children add."""

    __slots__ = ("depth", "size", "skeleton", "first", "members", "children", "leaves", "saved", "ends", "held")

    def __init__(self, depth: int, size: int, skeleton: int | None):
        self.depth, self.size, self.skeleton = depth, size, skeleton
        self.first, self.members, self.children, self.leaves, self.saved = None, 0, 0, 0, 0
        self.ends: list[int] = []
        self.held: list[tuple] = []  # finished children, which wait for this node's smallest member


ROW = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
FOUND_SQL = ROW + ", skeleton int, above int, shard long, size long, ends string"
FOUND = pa.schema(
    [(c, pa.int64()) for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")]
    + [("ends_sha256", pa.string()), ("skeleton", pa.int32()), ("above", pa.int32()), ("shard", pa.int64()), ("size", pa.int64()), ("ends", pa.string())]
)


def shard_nodes(rows: Iterable[tuple[bytes, int, list[int]]], skeleton: tuple, shard: int) -> Iterator[tuple]:
    """All nodes of one shard, whose rows (path, conv_id, sizes) come sorted: one node a row as in FOUND.

    Nodes of the skeleton come as partial aggregates, with their number; children of skeleton nodes come without
    parent_conv_id, with the number of the node above. What is held is the open path and its finished children.
    A node of this shard that any splitter path holds is held by the splitter at one of its two ends.
    """
    cuts, numbers = skeleton
    sides = [(cuts[i][0], numbers[i]) for i in (shard - 1, shard) if 0 <= i < len(cuts)]

    def close(node: Node, above: Node | None) -> Iterator[tuple]:
        if node.skeleton is not None:
            yield (node.first, node.depth, None, node.members, node.children, node.leaves, node.saved, None, node.skeleton, None, shard, node.size, ",".join(map(str, node.ends)))
            return
        for child in node.held:
            yield (*child[:2], node.first, *child[3:], None, None, None, None, None)
        leaves = node.leaves if node.children else 1
        saved = node.saved + (node.members - 1) * node.size
        above.children += 1
        above.leaves += leaves
        above.saved += saved
        done = (node.first, node.depth, None, node.members, node.children, leaves, saved, hashlib.sha256(",".join(map(str, node.ends)).encode()).hexdigest())
        if above.skeleton is None:
            above.held.append(done)
        else:
            yield (*done, None, above.skeleton, None, None, None)

    open_, before = [Node(0, 0, 0)], b""
    for path, conv_id, sizes in rows:
        same = shared_turns(before, path)
        while len(open_) > same + 1:
            node = open_.pop()
            yield from close(node, open_[-1])
        marks = [(shared_turns(path, p), n) for p, n in sides] if same < len(sizes) else []
        for depth in range(same + 1, len(sizes) + 1):
            mine = next((int(n[depth]) for shared, n in marks if depth <= shared), None)
            open_.append(Node(depth, sizes[depth - 1], mine))
        for node in open_:
            node.members += 1
            node.first = conv_id if node.first is None else min(node.first, conv_id)
        open_[-1].ends.append(conv_id)
        before = path
    while open_:
        node = open_.pop()
        yield from close(node, open_[-1] if open_ else None)


def chained_digests(ends: DataFrame) -> DataFrame:
    """(skeleton, ends_sha256) from (skeleton, shard, ends): the ends of a node in the order of the shards, hashed.

    The hash runs over the text as it streams by, a row a shard that holds ends of the node; nothing is collected.
    """

    def hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in slices(batches, 16):
                yield from zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())

        for node, texts in groupby(rows(), key=lambda r: r[0]):
            state, begun = hashlib.sha256(), False
            for _, text in texts:
                if text:
                    state.update(("," * begun + text).encode())
                    begun = True
            yield pa.record_batch({"skeleton": pa.array([node], pa.int32()), "ends_sha256": pa.array([state.hexdigest()])})

    sorted_ = ends.repartition("skeleton").sortWithinPartitions("skeleton", "shard").select("skeleton", "ends")
    return sorted_.mapInArrow(hashed, "skeleton int, ends_sha256 string")


def prefix_trie(conversations: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row a node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Rows without conv_id belong to no conversation and are left out. A null role or text is the empty one, which is a
    turn like any other; rows that repeat are turns each; equal turn numbers go by role, then text. Extra columns are
    not read. Without a conversation there is no node, not even a root.
    """
    spark = conversations.sparkSession
    paths = materialize(rebuilt(conversations), "paths")
    skeleton = Skeleton(splitters(paths, shard_rows))
    shipped = spark.sparkContext.broadcast((skeleton.cuts, skeleton.numbers))  # one path a shard

    def placed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts = shipped.value[0]
        for batch in slices(batches, 4096):
            found = [bisect_right(cuts, (p, c)) for c, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.record_batch([pa.array(found, pa.int64()), *batch.columns], names=["shard", "conv_id", "path", "sizes"])

    def finished(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in slices(batches, 4096):
                yield from zip(*(c.to_pylist() for c in batch.columns))

        def as_batch(nodes: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*nodes), FOUND)], schema=FOUND)

        ready: list[tuple] = []
        for shard, members in groupby(rows(), key=lambda r: r[0]):
            for node in shard_nodes((r[1:] for r in members), shipped.value, shard):
                ready.append(node)
                if len(ready) >= 8192:
                    yield as_batch(ready)
                    ready = []
        if ready:
            yield as_batch(ready)

    shards = paths.mapInArrow(placed, "shard long, conv_id long, path binary, sizes array<long>")
    shards = shards.repartition(max(partitions(spark), len(skeleton.cuts) + 1), "shard").sortWithinPartitions("shard", "path", "conv_id")
    found = materialize(shards.select("shard", "path", "conv_id", "sizes").mapInArrow(finished, FOUND_SQL), "nodes")

    # The skeleton's partial aggregates: added up by node, then over the nodes below each, which are numbered behind it.
    partial = found.where("skeleton is not null")
    total = lambda c: F.sum(c).alias(c)
    reduced = partial.groupBy("skeleton").agg(F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), total("n_convs"), total("n_children"), total("n_leaves"), total("saved_tokens"), F.max("size").alias("size"))
    tree = spark.createDataFrame(skeleton.rows(), "skeleton int, parent int, last int")
    inner = tree.where("parent >= 0").groupBy(F.col("parent").alias("skeleton")).agg(F.count(F.lit(1)).alias("inner"))
    own = reduced.join(tree, "skeleton").join(inner, "skeleton", "left")
    own = own.withColumn("n_children", F.col("n_children") + F.coalesce("inner", F.lit(0)))
    own = own.withColumn("n_leaves", F.col("n_leaves") + F.when(F.col("n_children") == 0, 1).otherwise(0))
    own = own.withColumn("saved_tokens", F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("size"))
    walk = Window.orderBy("skeleton")  # as many rows as the broadcast skeleton has
    own = materialize(own.withColumns({c: F.sum(v).over(walk) for c, v in (("run_leaves", "n_leaves"), ("run_saved", "saved_tokens"))}), "skeleton")
    ends = own.select(F.col("skeleton").alias("last"), F.col("run_leaves").alias("last_leaves"), F.col("run_saved").alias("last_saved"))
    digests = chained_digests(partial.where("ends <> ''").select("skeleton", "shard", "ends"))
    firsts = own.select(F.col("skeleton").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    spine = own.join(ends, "last").join(digests, "skeleton", "left").join(firsts, "parent", "left")
    spine = spine.withColumns({
        "n_leaves": F.col("last_leaves") - F.col("run_leaves") + F.col("n_leaves"),
        "saved_tokens": F.col("last_saved") - F.col("run_saved") + F.col("saved_tokens"),
        "ends_sha256": F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)),
    }).select(columns)
    local = found.where("skeleton is null").withColumnRenamed("parent_conv_id", "known")
    local = local.join(F.broadcast(firsts), F.col("above") == F.col("parent"), "left").withColumn("parent_conv_id", F.coalesce("known", "parent_conv_id"))
    return local.select(columns).union(spine)
