"""SimHash near-duplicates by a hierarchical index in Gray order.

Fingerprints that differ in at most 3 of 64 bits agree on one of four 16-bit blocks. For each block the distinct
fingerprints, turned so that the block leads, are sorted by Gray rank (neighbours in that order differ in few bits) and
dealt out in ranges. In a range, runs of 8 form nodes, runs of 8 nodes form upper nodes: a node keeps the bits that its
members share. Two nodes are compared at once: more than 3 differences in bits that both share, or a difference in the
leading block, prune the two whole groups; at most 3 bits unshared over both links the two whole groups. Ranges end
anywhere, so a block value that several ranges hold is compared across them in runs with the same pruning.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatt.llm.common import materialize, partitions, slices, whole_text
from tidewatt.llm.components import connected_components, local_components

BITS, MOST = 64, 3
FAN, FRONTIER, RUN = 8, 200_000, 1024
LEAD = 0xFFFF << 48
SHINGLE, SEED = 3, 42


def fingerprint(text: str, words_each: int = SHINGLE) -> int:
    """64-bit SimHash: bit b is 1 if it is set in over half of the shingles' XXH64. No word: 0."""
    import xxhash

    words = text.encode().lower().split()  # bytes: A-Z only, and the six ASCII white-space characters
    if not words:
        return 0
    if len(words) < words_each:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    grams = map(b" ".join, zip(*(words[i:] for i in range(words_each))))
    hashes = np.fromiter((xxhash.xxh64_intdigest(g, SEED) for g in grams), "<u8", len(words) - words_each + 1)
    counts = np.zeros(BITS, "i8")
    for start in range(0, len(hashes), 65_536):
        counts += np.unpackbits(hashes[start : start + 65_536].view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype="i8")
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp (the fingerprint's 64 bits as a signed long) of every whole text; null is the empty text."""

    def hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            values = np.array([fingerprint(t) for t in batch.column(1).to_pylist()], "u8").view("i8")
            yield pa.record_batch({"doc_id": batch.column(0), "fp": pa.array(values, pa.int64())})

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text")).mapInArrow(hashed, "doc_id long, fp long")


def turned(fp: Column, table: int) -> Column:
    """The fingerprint turned left so that its block number `table` leads."""
    if not table:
        return fp
    return F.shiftleft(fp, 16 * table).bitwiseOR(F.shiftrightunsigned(fp, BITS - 16 * table))


def gray_rank(value: Column) -> Column:
    """Place of a 64-bit word in Gray order, as a signed long that sorts like the unsigned place."""
    for shift in (1, 2, 4, 8, 16, 32):
        value = value.bitwiseXOR(F.shiftrightunsigned(value, shift))
    return value.bitwiseXOR(F.lit(-(1 << 63)))


class GrayIndex:
    """Nodes over fingerprints in Gray order: what each shares (`low` AND `high` of its members), level by level."""

    def __init__(self, table: np.ndarray, word: np.ndarray, most: int = MOST):
        self.n, self.most = len(word), most
        self.levels = [(word, word, table, table)]  # AND, OR, first table, last table
        while len(self.levels[-1][0]) > 1:
            low, high, first, last = self.levels[-1]
            at = np.arange(0, len(low), FAN)
            self.levels.append((np.bitwise_and.reduceat(low, at), np.bitwise_or.reduceat(high, at), first[at], last[np.minimum(at + FAN, len(low)) - 1]))

    def span(self, level: int, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = FAN**level
        return node * size, np.minimum((node + 1) * size, self.n)

    def links(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Links as arrays of places; whole groups as chains, everything else pair by pair."""
        if not self.n:
            return
        top = len(self.levels) - 1
        stack = [(top, np.zeros(1, "i8"), np.zeros(1, "i8"))]
        while stack:
            level, a, b = stack.pop()
            if len(a) > FRONTIER:
                stack.append((level, a[FRONTIER:], b[FRONTIER:]))
                a, b = a[:FRONTIER], b[:FRONTIER]
            low, high, first, last = self.levels[level]
            low_a, high_a, low_b, high_b = low[a], high[a], low[b], high[b]
            differ = (low_a ^ low_b) & ~((low_a ^ high_a) | (low_b ^ high_b))
            keep = (np.bitwise_count(differ) <= self.most) & (differ & np.uint64(LEAD) == 0) & (first[b] <= last[a])
            loose = np.bitwise_count((high_a | high_b) ^ (low_a & low_b))
            whole = keep & (loose <= self.most) & (first[a] == last[b])
            if whole.any():
                for node in (a[whole], b[whole]):
                    begin, end = self.span(level, node)
                    yield np.repeat(self.span(level, a[whole])[0], end - begin), np.concatenate([np.arange(x, y) for x, y in zip(begin, end)])
            a, b = a[keep & ~whole], b[keep & ~whole]
            if level == 0 or not len(a):
                continue
            kids = np.arange(FAN)
            x = (a[:, None, None] * FAN + kids[None, :, None]).repeat(FAN, axis=2).reshape(-1)
            y = (b[:, None, None] * FAN + kids[None, None, :]).repeat(FAN, axis=1).reshape(-1)
            below = len(self.levels[level - 1][0])
            real = (x <= y) & (y < below)
            if level == 1:
                real &= x < y
            stack.append((level - 1, x[real], y[real]))


def forest(n: int, links: Iterable[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """A star for each component of the links: fewer than n rows, however many links there were."""
    a, b, held = [], [], 0
    for x, y in links:
        a.append(x)
        b.append(y)
        held += len(x)
        if held > 4_000_000:
            label = local_components(n, np.concatenate(a), np.concatenate(b))
            a, b, held = [np.arange(n)], [label], n
    if not a:
        return np.zeros(0, "i8"), np.zeros(0, "i8")
    label = local_components(n, np.concatenate(a), np.concatenate(b))
    member = np.flatnonzero(label != np.arange(n))
    return member, label[member]


def unturned(word: np.ndarray, table: np.ndarray) -> np.ndarray:
    shift = (16 * (table % 4)).astype("u8")
    return np.where(shift == 0, word, (word >> shift) | (word << ((np.uint64(BITS) - shift) % np.uint64(BITS))))


OUT = "seed int, a long, b long, lead long, part int, low long, high long, members binary"


def link_stars(fps: DataFrame, most: int = MOST) -> DataFrame:
    """(seed, a, b): links that connect exactly what chains of fingerprints of one seed connect that agree on a 16-bit
    block and differ in at most `most` bits. For 3 bits that is every such chain, as 3 bits leave one of four blocks.

    `fps` holds distinct fingerprints (fp: long, and seed: int if there are several seeds).
    """
    spark = fps.sparkSession
    if "seed" not in fps.columns:
        fps = fps.withColumn("seed", F.lit(0))

    def signed(x: np.ndarray) -> pa.Array:
        return pa.array(x.astype("u8").view("i8"), pa.int64())

    def ranged(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = TaskContext.get().partitionId(), list(batches)
        if not held:
            return
        table = np.concatenate([b.column(0).to_numpy() for b in held]).astype("i8")
        rank = np.concatenate([b.column(1).to_numpy() for b in held]).view("u8") ^ np.uint64(1 << 63)
        if not len(rank):
            return
        word = rank ^ (rank >> np.uint64(1))
        fp = unturned(word, table)
        member, root = forest(len(word), GrayIndex(table, word, most).links())
        none = pa.nulls(len(member))
        yield pa.record_batch({"seed": pa.array((table[member] // 4).astype("i4")), "a": signed(fp[member]), "b": signed(fp[root]), "lead": none.cast(pa.int64()), "part": none.cast(pa.int32()), "low": none.cast(pa.int64()), "high": none.cast(pa.int64()), "members": none.cast(pa.binary())})
        # The block values at either end may go on in the next range: their members, in runs.
        lead = table << 16 | (word >> np.uint64(48)).astype("i8")
        for value in {int(lead[0]), int(lead[-1])}:
            own = np.sort(np.flatnonzero(lead == value))
            for start in range(0, len(own), RUN):
                run = word[own[start : start + RUN]]
                row = {"seed": value >> 18, "a": None, "b": None, "lead": value, "part": part, "low": int(np.bitwise_and.reduce(run).view("i8")), "high": int(np.bitwise_or.reduce(run).view("i8")), "members": fp[own[start : start + RUN]].tobytes()}
                yield pa.RecordBatch.from_pylist([row], pa.schema([("seed", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("lead", pa.int64()), ("part", pa.int32()), ("low", pa.int64()), ("high", pa.int64()), ("members", pa.binary())]))

    def across(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 16):
            for seed, x, y in zip(*(c.to_pylist() for c in batch.columns)):
                fp = np.frombuffer(x + y, "<u8")
                m = len(x) // 8
                i, j = np.nonzero(np.bitwise_count(fp[:m, None] ^ fp[None, m:]) <= most)
                member, root = forest(len(fp), [(i, j + m)])
                yield pa.record_batch({"seed": pa.array(np.full(len(member), seed, "i4")), "a": signed(fp[member]), "b": signed(fp[root])})

    tables = [fps.select((F.col("seed") * 4 + t).alias("table"), gray_rank(turned(F.col("fp"), t)).alias("rank")) for t in range(4)]
    every = tables[0].union(tables[1]).union(tables[2]).union(tables[3])
    found = materialize(every.repartitionByRange(partitions(spark), "table", "rank").sortWithinPartitions("table", "rank").mapInArrow(ranged, OUT), "ranges")
    runs = found.where("members is not null").select("seed", "lead", "part", "low", "high", "members")
    split = runs.groupBy("lead").agg(F.min("part").alias("p"), F.max("part").alias("q")).where("p < q").select("lead")
    ends = runs.join(split, "lead", "left_semi")
    left, right = ends.alias("l"), ends.alias("r")
    shared_differ = F.expr("(l.low ^ r.low) & ~((l.low ^ l.high) | (r.low ^ r.high))")
    pairs = left.join(right, F.expr("l.lead = r.lead and l.part < r.part")).where(F.bit_count(shared_differ) <= most).select("l.seed", "l.members", F.col("r.members").alias("others"))
    return found.where("a is not null").select("seed", "a", "b").union(pairs.mapInArrow(across, "seed int, a long, b long"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (smallest doc_id reachable by links) of every row.

    Equal fingerprints are one point of the graph, so copies never meet in pairs. Rows without an id get the smallest
    id of their component, null if it has none; texts without a word share fingerprint zero; rows that repeat stay,
    each with the same component; an empty table gives no row. Only the two named columns are read.
    """
    rows = materialize(fingerprints(docs, id_col, text_col), "fingerprints")
    points = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "points")
    roots = connected_components(link_stars(points.select("fp")))
    rooted = points.join(roots, points.fp == roots.node, "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = rooted.join(smallest, "root").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
