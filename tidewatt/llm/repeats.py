"""Repeated passages by a run-length index.

A byte goes if a string of `length` bytes that covers it starts in some other place of the corpus too. Only places
that can repeat are indexed: every window of `length` bytes has an anchor, the 64-byte gram in it with the smallest
hash, so equal windows have equal anchors at equal offsets. Neighbouring windows with one anchor are a segment; most
anchors occur once, and their segments end there. Equal segments are counted, not compared. The distinct segments
around repeated anchors go through the index: suffixes in order of their first `length` bytes, the Burrows-Wheeler
transform of that order in runs, match lengths measured at the run ends only and streamed from there along the text
(inside a run each is one less than the one before), long ones marked.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatt.llm.common import materialize, partitions, slices, whole_text

LENGTH, GRAM = 200, 64
PIECE = 1 << 20  # windows of one text that are looked at together
LOT = 1 << 18  # bytes in one index, but for the rest of its last anchor
#: An anchor with more distinct segments than this is compared by its windows, not in one index.
CROWD = 1000
FACTOR = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(FACTOR, -1, 1 << 64)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest of each `width` neighbours: two running minima over blocks of that width."""
    n = len(values) - width + 1
    padded = np.concatenate([values, np.full(-len(values) % width, np.iinfo("u8").max, "u8")]).reshape(-1, width)
    ahead = np.minimum.accumulate(padded, axis=1).reshape(-1)
    back = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


class Anchors:
    """Anchors of every window of byte strings. `powers`: of the hash's factor and of its inverse, up to the longest piece."""

    def __init__(self, length: int):
        self.length, self.width = length, length - GRAM + 1
        n = PIECE + length
        step = np.full(n, FACTOR, "u8")
        step[0] = 1
        self.up = np.multiply.accumulate(step)
        step[1:] = INVERSE
        self.down = np.multiply.accumulate(step)

    def of(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(anchor hash, first window, last window) of each segment of one piece of bytes."""
        n = len(data)
        sums = np.zeros(n + 1, "u8")
        np.cumsum((data.astype("u8") + np.uint64(1)) * self.up[:n], out=sums[1:])
        grams = n - GRAM + 1
        h = (sums[GRAM:] - sums[:grams]) * self.down[:grams]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        place = np.uint64((1 << 21) - 1)
        lowest = sliding_min((h & ~place) | np.arange(grams, dtype="u8"), self.width)
        first = np.flatnonzero(np.concatenate([[True], lowest[1:] != lowest[:-1]]))
        last = np.concatenate([first[1:], [len(lowest)]]) - 1
        return h[(lowest[first] & place).astype("i8")].view("i8"), first, last


def text_key() -> list[Column]:
    """Two 64-bit hashes that stand for a text."""
    return [F.xxhash64("text").alias("k1"), F.xxhash64(F.lit("again"), "text").alias("k2")]


SEGMENT = "k1 long, k2 long, anchor long, seg long, first long, n int"


def segments(texts: DataFrame, length: int) -> DataFrame:
    """(k1, k2, anchor, seg, first, n): the segment's content hash, its first window and its number of windows."""

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        anchors = Anchors(length)
        for batch in slices(batches, 256):
            parts: list[tuple] = []
            for row, text in enumerate(batch.column(2).to_pylist()):
                raw = text.encode()
                windows = len(raw) - length + 1
                for start in range(0, max(windows, 0), PIECE):
                    piece = raw[start : start + PIECE + length - 1]
                    anchor, first, last = anchors.of(np.frombuffer(piece, "u1"))
                    seg = [xxhash.xxh3_64_intdigest(piece[a : b + length]) for a, b in zip(first.tolist(), last.tolist())]
                    parts.append((np.full(len(first), row), anchor, np.array(seg, "u8").view("i8"), first + start, last - first + 1))
            if parts:
                row, anchor, seg, first, n = map(np.concatenate, zip(*parts))
                yield pa.record_batch({"k1": batch.column(0).take(pa.array(row)), "k2": batch.column(1).take(pa.array(row)), "anchor": pa.array(anchor), "seg": pa.array(seg), "first": pa.array(first.astype("i8")), "n": pa.array(n.astype("i4"))})

    return texts.select(*text_key(), "text").mapInArrow(cut, SEGMENT)


class RunLengthIndex:
    """Run-compressed Burrows-Wheeler transform of the window starts of joined segments, with samples at run ends."""

    def __init__(self, parts: list[bytes], length: int):
        sizes = np.array([len(p) for p in parts])
        self.ends = np.cumsum(sizes)
        self.begins = self.ends - sizes
        self.text = np.frombuffer(b"".join(parts), "u1")
        self.length, self.longest = length, int(sizes.max())
        #: Places where a whole window of one segment begins, and the bytes from a place to its segment's end.
        self.starts = np.concatenate([np.arange(b, e - length + 1) for b, e in zip(self.begins, self.ends)])
        self.room = np.repeat(self.ends, sizes) - np.arange(len(self.text))
        order = self._sorted(self.text, self.starts, length)
        self.before = np.full(len(self.text), -1, "i8")
        self.before[order[1:]] = order[:-1]
        # The byte in front of each suffix in that order; a segment's first window has none, which ends a run.
        first = np.zeros(len(self.text), bool)
        first[self.begins] = True
        transform = np.where(first[order], -1, self.text[order - 1])
        heads = np.concatenate([[True], (transform[1:] != transform[:-1]) | (transform[1:] < 0)])
        self.samples = order[heads]

    @staticmethod
    def _sorted(text: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
        """Window starts in order of their windows, equal ones by place: ranks of 8 bytes, doubled up to the length."""
        n = len(text)
        padded = np.concatenate([text, np.zeros(length + 8, "u1")])
        rank = np.zeros(n, "u8")
        for i in range(8):
            rank = rank << np.uint64(8) | padded[i : i + n]
        known = 8
        while known < length:
            step = min(known, length - known)
            dense = np.unique(rank, return_inverse=True)[1].astype("u8")
            later = np.zeros(n, "u8")
            later[: n - step] = dense[step:] + np.uint64(1)
            rank = dense * np.uint64(n + 2) + later
            known += step
        return starts[np.argsort(rank[starts], kind="stable")]

    def match(self, at: np.ndarray) -> np.ndarray:
        """Bytes that the suffix at each place shares with the one in front of it, up to either segment's end."""
        out = np.zeros(len(at), "i8")
        text = np.concatenate([self.text, np.zeros(self.longest, "u1")])
        reach = np.arange(self.longest)
        for lot in range(0, len(at), 8192):
            x = at[lot : lot + 8192]
            y = self.before[x]
            real = np.flatnonzero(y >= 0)
            x, y = x[real], y[real]
            differ = text[x[:, None] + reach] != text[y[:, None] + reach]
            shared = np.where(differ.any(axis=1), differ.argmax(axis=1), self.longest)
            out[lot + real] = np.minimum(shared, np.minimum(self.room[x], self.room[y]))
        return out

    def long_matches(self) -> np.ndarray:
        """For every place of the text whether a window begins there that begins in another place too."""
        starts, before = self.starts, self.before
        # Inside a run the neighbour in front moves along with the text. It does not at a run's head, nor where the
        # neighbour's segment ends: there the match is measured, elsewhere it is one less than at the place before.
        moves = np.zeros(len(starts), bool)
        moves[1:] = (starts[1:] == starts[:-1] + 1) & (before[starts[1:]] == before[starts[:-1]] + 1) & (before[starts[:-1]] >= 0)
        moves &= ~np.isin(starts, self.samples)
        measured = np.flatnonzero(~moves)
        length = np.zeros(len(starts), "i8")
        length[measured] = self.match(starts[measured])
        place = np.arange(len(starts))
        head = np.maximum.accumulate(np.where(moves, 0, place))
        hit = starts[length[head] - (place - head) >= self.length]
        marked = np.zeros(len(self.text), bool)
        marked[hit] = True
        marked[before[hit]] = True
        return marked


def _spans(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last place of every run of set flags."""
    edge = np.diff(np.concatenate([[0], flags.astype("i1"), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1


MARK = "anchor long, seg long, lo int, hi int"


def marked_windows(one: DataFrame, texts: DataFrame, length: int) -> DataFrame:
    """(anchor, seg, lo, hi): windows of distinct segments, counted from each segment's first, that also begin elsewhere.

    `one`: an occurrence of each distinct segment whose anchor has several. Their bytes are read from the texts; anchors
    with up to CROWD segments are indexed in lots, the windows of larger crowds are counted by hash.
    """
    wanted = one.groupBy("k1", "k2").agg(F.collect_list(F.struct("anchor", "seg", "first", "n", "crowd")).alias("parts"))
    met = texts.select(*text_key(), "text").join(wanted, ["k1", "k2"])

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            rows = [(p["anchor"], p["seg"], raw[p["first"] : p["first"] + p["n"] + length - 1], p["crowd"]) for raw, parts in ((t.encode(), ps) for t, ps in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())) for p in parts]
            for at in range(0, len(rows), 20_000):
                a, s, b, c = zip(*rows[at : at + 20_000])
                yield pa.record_batch({"anchor": pa.array(a, pa.int64()), "seg": pa.array(s, pa.int64()), "bytes": pa.array(b, pa.binary()), "crowd": pa.array(c, pa.int64())})

    # Copies of a text meet the same list; each distinct segment is needed once.
    bytes_of = met.select("text", "parts").mapInArrow(read, "anchor long, seg long, bytes binary, crowd long")
    bytes_of = materialize(bytes_of.dropDuplicates(["anchor", "seg"]), "bytes")

    def indexed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = [], 0, None

        def flush() -> pa.RecordBatch:
            index = RunLengthIndex([r[2] for r in held], length)
            lo, hi = _spans(index.long_matches())  # no run reaches into the next segment: its last windows end there
            row = np.searchsorted(index.ends, lo, "right")
            return pa.record_batch({"anchor": pa.array([held[r][0] for r in row], pa.int64()), "seg": pa.array([held[r][1] for r in row], pa.int64()), "lo": pa.array((lo - index.begins[row]).astype("i4")), "hi": pa.array((hi - index.begins[row]).astype("i4"))})

        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if row[0] != last and size >= LOT:
                    yield flush()
                    held, size = [], 0
                last = row[0]
                held.append(row)
                size += len(row[2])
        if held:
            yield flush()

    small = bytes_of.where(F.col("crowd") <= CROWD).select("anchor", "seg", "bytes").repartition(partitions(one.sparkSession), "anchor").sortWithinPartitions("anchor", "seg")
    by_index = small.mapInArrow(indexed, MARK)

    windows = bytes_of.where(F.col("crowd") > CROWD).select("anchor", "seg", "bytes", F.posexplode(F.expr(f"sequence(1, length(bytes) - {length} + 1)")).alias("off", "at"))
    window = F.substring("bytes", F.col("at"), F.lit(length))
    hashed = windows.select("anchor", "seg", "off", F.xxhash64(window).alias("w1"), F.xxhash64(F.lit("again"), window).alias("w2")).distinct()
    often = hashed.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("w1", "w2")
    by_window = hashed.join(often, ["w1", "w2"]).select("anchor", "seg", F.col("off").alias("lo"), F.col("off").alias("hi"))
    return by_index.union(by_window)


def repeated_spans(docs: DataFrame, length: int = LENGTH, text_col: str = "text") -> DataFrame:
    """(k1, k2, spans): for each text that repeats something, its byte spans [from, to) to remove, apart and in order."""
    spark = docs.sparkSession
    # Each step's shuffle files go when its table is written: they would add up to several times the input.
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    texts = docs.select(whole_text(text_col).alias("text"))
    places = materialize(segments(texts, length), "places")
    twice = places.groupBy("anchor").agg(F.count(F.lit(1)).alias("all"), F.min("seg").alias("s1"), F.max("seg").alias("s2")).where("all > 1")
    # Written first, so that both sides of the join are plain shuffles and a hot anchor's places can be split.
    twice = materialize(twice.select("anchor", F.expr("s1 <> s2").alias("several")), "twice")
    found = materialize(places.join(twice, "anchor"), "repeated")

    # Anchors whose segments are all equal: every window of theirs repeats. The others: see which windows do.
    whole = found.where("not several").select("k1", "k2", F.col("first").alias("from"), (F.col("first") + F.col("n") - 1 + length).alias("to"))
    mixed = found.where("several")
    one = mixed.groupBy("anchor", "seg").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("k1", "k2", "first", "n")).alias("o"))
    one = materialize(one.select("anchor", "seg", "copies", "o.*"), "distinct")
    crowds = one.groupBy("anchor").agg(F.count(F.lit(1)).alias("crowd"))
    marks = marked_windows(one.join(crowds, "anchor"), texts, length)
    marks = materialize(marks.union(one.where("copies > 1").select("anchor", "seg", F.lit(0), F.col("n") - 1)), "marks")
    part = mixed.join(marks, ["anchor", "seg"]).select("k1", "k2", (F.col("first") + F.col("lo")).alias("from"), (F.col("first") + F.col("hi") + length).alias("to"))
    spans = whole.union(part).distinct()
    return materialize(spans.groupBy("k1", "k2").agg(F.array_sort(F.collect_list(F.struct("from", "to"))).alias("spans")), "spans")


def merged(spans: list[dict]) -> list[tuple[int, int]]:
    """Sorted spans as maximal ones."""
    out: list[list[int]] = []
    for s in spans:
        if out and s["from"] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], s["to"])
        else:
            out.append([s["from"], s["to"]])
    return [(a, b) for a, b in out]


def kept_bytes(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    edges = [0, *(x for span in spans for x in span), len(raw)]
    return b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2]))


def without_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row.

    A null text is the empty text, nothing is removed from it; rows that repeat lose everything of 200 bytes or more in
    all copies; null ids stay; an empty table gives no row. Only the two named columns are read.
    """
    import hashlib

    spans = repeated_spans(docs, length, text_col)

    def digest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for doc_id, text, found in zip(*(batch.column(i).to_pylist() for i in range(3))):
                raw, gone = text.encode(), merged(found or [])
                rows.append((doc_id, len(raw), sum(b - a for a, b in gone), len(gone), hashlib.sha256(kept_bytes(raw, gone)).hexdigest()))
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            kinds = [pa.int64()] * 4 + [pa.string()]
            yield pa.record_batch({n: pa.array([r[i] for r in rows], k) for i, (n, k) in enumerate(zip(names, kinds))})

    keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text")).select("doc_id", "text", *text_key())
    return keyed.join(spans, ["k1", "k2"], "left").select("doc_id", "text", "spans").mapInArrow(digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def texts_without_repeats(docs: DataFrame, length: int = LENGTH, text_col: str = "text") -> DataFrame:
    """`docs` with its repeated passages cut out of the text column; a cut keeps characters that it would halve."""
    spans = repeated_spans(docs, length, text_col)
    keyed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), whole_text(text_col).alias("text")).select("_row", "text", *text_key())

    @F.pandas_udf("string")
    def kept(texts, spans):
        import pandas as pd

        out = []
        for text, found in zip(texts, spans):
            raw, gone = text.encode(), []
            for a, b in merged(list(found) if found is not None else []):
                while a < b and raw[a] & 0xC0 == 0x80:
                    a += 1
                while b > a and b < len(raw) and raw[b] & 0xC0 == 0x80:
                    b -= 1
                gone.append((a, b))
            out.append(kept_bytes(raw, gone).decode())
        return pd.Series(out)

    cut = keyed.join(spans, ["k1", "k2"], "left").withColumn("_kept", F.when(F.col("spans").isNull(), F.col("_row")[text_col]).otherwise(kept("text", "spans")))
    return cut.select(*[F.col("_kept").alias(c) if c == text_col else F.col("_row")[c].alias(c) for c in docs.columns])
