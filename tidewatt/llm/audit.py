"""How text filters interact, read off a sparse document-term matrix.

Texts are split into words once, in shards of bounded size, each with a vocabulary of its own. The vocabularies are
joined into one dictionary with dense numbers, and each shard's matrix (rows in compressed sparse form) is renumbered
by it. Row sums are word counts, stored entries a row are distinct words: those two decide the filters on length and on
repetition. The flags that need the letters, and equality across the table, are attached; a document is then five bits,
and every order of the filters is worked out on the counts of the 32 patterns a part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatt.llm.common import give_back, materialize, slices, whole_text

FILTERS = "ABCDE"
#: Bytes of text in a shard; a longer text is a shard of its own.
SHARD_BYTES = 1 << 25
#: Bytes of text that a task splits into words at once; a longer text is split whole.
PIECE_BYTES = 1 << 21
#: Ranges of word hashes within which the dictionary numbers words: a few hundred thousand each at 10^9 words.
BUCKETS = 4096
CAPITALS, SPECIALS = bytes(range(65, 91)), b"#$%&*|"
NO_ID = (1 << 63) - 1


def packed(values: np.ndarray) -> bytes:
    """Integers of up to 32 bits as compressed bytes: small ones take about a byte or less."""
    planes = np.ascontiguousarray(values, "<u4").view("u1").reshape(-1, 4).T
    return len(values).to_bytes(8, "little") + pa.compress(planes.tobytes(), "zstd", asbytes=True)


def unpacked(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    return np.frombuffer(pa.decompress(data[8:], 4 * n, "zstd", asbytes=True), "u1").reshape(4, n).T.copy().view("<u4").reshape(-1).astype("i8")


class Shard:
    """Rows of the matrix under the shard's own vocabulary, and what else the filters need of each text."""

    def __init__(self):
        self.ids, self.parts, self.flags, self.hashes, self.pieces = [], [], [], [], []
        self.size = 0

    def add(self, rows: pa.RecordBatch, size: int) -> None:
        """A few MB of texts: split in Arrow, each word a number among the words of these texts."""
        ids, parts, texts = rows.columns
        split = pc.ascii_split_whitespace(texts)  # the six ASCII white-space characters; a run at either end leaves an empty word
        words, owner = split.flatten(), pc.list_parent_indices(split)
        real = pc.not_equal(pc.binary_length(words), 0)
        own = words.filter(real).cast(pa.binary()).dictionary_encode()
        self.pieces.append((own.dictionary, own.indices.to_numpy(), np.bincount(owner.filter(real).to_numpy(), minlength=len(ids))))
        for data, length in zip(texts.cast(pa.binary()).to_pylist(), pc.utf8_length(texts).to_pylist()):
            shouts = 100 * (len(data) - len(data.translate(None, CAPITALS))) > 10 * length
            marked = len(data.translate(None, SPECIALS)) < len(data)
            self.flags.append(4 * shouts + 8 * marked)
            self.hashes.append(hashlib.sha256(data).digest())
        self.ids += ids.fill_null(NO_ID).to_pylist()
        self.parts += parts.to_pylist()
        self.size += size

    def matrix(self) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
        """(words, stored entries a row, codes, counts): codes ascend within a row and are stored as steps, which are small."""
        named = pa.concat_arrays([words for words, _, _ in self.pieces]).dictionary_encode()
        codes, sizes, steps, counts = named.indices.to_numpy(), [], [], []
        for words, numbers, lengths in self.pieces:
            cells = np.repeat(np.arange(len(lengths), dtype="i8") << 32, lengths)
            cells |= codes[: len(words)][numbers]
            codes = codes[len(words) :]
            cells.sort()
            ends = np.flatnonzero(np.diff(cells, append=-1))
            counts.append(np.diff(ends, prepend=-1).astype("u4"))
            cells = cells[ends]
            row, code = cells >> 32, cells.astype("u4")
            steps.append(np.where(np.diff(row, prepend=-1) > 0, code, np.diff(code, prepend=code[:1])))
            sizes.append(np.bincount(row, minlength=len(lengths)))
        return named.dictionary, *map(np.concatenate, (sizes, steps, counts))

    def row(self, name: int) -> pa.RecordBatch:
        first = {}
        for h, i in zip(self.hashes, self.ids):
            first[h] = min(i, first.get(h, i))
        words, sizes, steps, counts = self.matrix()
        return pa.record_batch(
            {
                "shard": pa.array([name], pa.int64()),
                "words": pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words),
                "ids": pa.array([self.ids], pa.list_(pa.int64())),
                "parts": pa.array([self.parts], pa.list_(pa.string())),
                "flags": pa.array([self.flags], pa.list_(pa.int32())),
                "hashes": pa.array([self.hashes], pa.list_(pa.binary())),
                "firsts": pa.array([list(first)], pa.list_(pa.binary())),
                "first_ids": pa.array([list(first.values())], pa.list_(pa.int64())),
                "ends": pa.array([packed(sizes)], pa.binary()),
                "codes": pa.array([packed(steps)], pa.binary()),
                "counts": pa.array([packed(counts)], pa.binary()),
            }
        )


SHARD = (
    "shard long, words array<binary>, ids array<long>, parts array<string>, flags array<int>, hashes array<binary>, "
    "firsts array<binary>, first_ids array<long>, ends binary, codes binary, counts binary"
)


def split_shards(docs: DataFrame, id_col: str, text_col: str, part_col: str, shard_bytes: int) -> DataFrame:
    """One row a shard: its vocabulary, its matrix and the flags of its texts."""

    def sharded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, made, task = Shard(), 0, TaskContext.get().partitionId()
        for batch in slices(batches):
            ends = np.cumsum(pc.binary_length(batch.column(2)).to_numpy() + 64, dtype="i8")
            at = done = 0
            while at < batch.num_rows:
                room = min(shard_bytes - shard.size, PIECE_BYTES)
                to = min(int(ends.searchsorted(done + room)) + 1, batch.num_rows)
                shard.add(batch.slice(at, to - at), int(ends[to - 1]) - done)
                at, done = to, int(ends[to - 1])
                if shard.size >= shard_bytes:
                    yield shard.row(task << 32 | made)
                    shard, made = Shard(), made + 1
        if shard.ids:
            yield shard.row(task << 32 | made)
        del shard
        give_back()

    rows = docs.select(F.col(id_col).cast("long"), F.coalesce(F.col(part_col).cast("string"), F.lit("")), whole_text(text_col))
    return materialize(rows.toDF("id", "part", "text").mapInArrow(sharded, SHARD), "shards")


def dictionary(shards: DataFrame) -> DataFrame:
    """(word, code): every distinct word of the table under a dense number from 0 on.

    A word comes once a shard, however often the texts have it. Numbers run within ranges of the word's hash; the
    table of range sizes that offsets them has BUCKETS rows, so it is broadcast.
    """
    words = shards.select(F.explode("words").alias("word")).distinct()
    words = materialize(words.select("word", F.pmod(F.xxhash64("word"), F.lit(BUCKETS)).cast("int").alias("bucket")), "words")
    sizes = words.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("bucket", (F.sum("n").over(Window.orderBy("bucket")) - F.col("n")).alias("before"))
    nth = F.row_number().over(Window.partitionBy("bucket").orderBy("word"))
    return words.withColumn("nth", nth).join(F.broadcast(before), "bucket").select("word", (F.col("before") + F.col("nth") - 1).alias("code"))


def term_matrix(shards: DataFrame, terms: DataFrame) -> DataFrame:
    """The shards with `terms`: (at, code), the dictionary's number of each word of their own vocabulary.

    A frequent word meets the dictionary once a shard.
    """
    own = shards.select("shard", F.posexplode("words").alias("at", "word"))
    named = own.join(terms, "word").groupBy("shard").agg(F.collect_list(F.struct("at", "code")).alias("terms"))
    return shards.drop("words").join(named, "shard", "left")


def renumbered(batch: pa.RecordBatch, at: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The matrix of row `at` in the dictionary's numbers: (row starts, columns, values)."""
    sizes, steps, values = (unpacked(batch.column(c)[at].as_py()) for c in ("ends", "codes", "counts"))
    starts = np.concatenate([[0], np.cumsum(sizes)])
    if not len(steps):
        return starts, steps, values
    own = batch.column("terms")[at].values
    terms = np.empty(len(own), "i8")
    terms[own.field("at").to_numpy()] = own.field("code").to_numpy()
    run = np.cumsum(steps)
    return starts, terms[run - np.repeat(np.concatenate([[0], run])[starts[:-1]], sizes)], values


def csr_shards(matrix: DataFrame) -> DataFrame:
    """shard, ids, row_starts, columns, counts: the document-term matrix itself, columns ascending within each row."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                starts, columns, values = renumbered(batch, at)
                order = np.lexsort((columns, np.repeat(np.arange(len(starts) - 1), np.diff(starts))))
                ids = [None if i == NO_ID else i for i in batch.column("ids")[at].as_py()]
                cells = [[x] for x in (batch.column("shard")[at].as_py(), ids, starts, columns[order], values[order])]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(cells, [pa.int64()] + [pa.list_(pa.int64())] * 4)], names=["shard", "ids", "row_starts", "columns", "counts"])

    return matrix.select("shard", "ids", "ends", "codes", "counts", "terms").mapInArrow(rows, "shard long, ids array<long>, row_starts array<long>, columns array<long>, counts array<long>")


def repeated_texts(shards: DataFrame) -> DataFrame:
    """(shard, late): the text hashes of a shard that a smaller id of another shard has.

    A shard sends one row a distinct text, so a text that a third of the documents hold is one row a shard.
    """
    firsts = shards.select("shard", F.explode(F.arrays_zip("firsts", "first_ids")).alias("f")).select("shard", F.col("f.firsts").alias("hash"), F.col("f.first_ids").alias("id"))
    smallest = firsts.groupBy("hash").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("hash", "first")
    later = firsts.join(smallest, "hash").where("id > first")
    return later.groupBy("shard").agg(F.collect_list("hash").alias("late"))


def failures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """doc_id, part and `mask` of every row: bit i is set if the text fails filter i of ABCDE."""
    shards = split_shards(docs, id_col, text_col, part_col, shard_bytes)
    matrix = term_matrix(shards, dictionary(shards)).join(repeated_texts(shards), "shard", "left")

    def masked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                starts, columns, values = renumbered(batch, at)
                ids, parts, flags, hashes, firsts, first_ids, late = (batch.column(c)[at].as_py() for c in ("ids", "parts", "flags", "hashes", "firsts", "first_ids", "late"))
                sums = np.concatenate([[0], np.cumsum(values)])
                words, distinct = sums[starts[1:]] - sums[starts[:-1]], np.diff(starts)
                first, gone = dict(zip(firsts, first_ids)), set(late or [])
                again = np.array([h in gone or i > first[h] for h, i in zip(hashes, ids)], bool)
                mask = (words < 100) + 2 * (100 * distinct < 80 * words) + np.array(flags) + 16 * again
                ids = pa.array([None if i == NO_ID else i for i in ids], pa.int64())
                yield pa.record_batch({"doc_id": ids, "part": pa.array(parts, pa.string()), "mask": pa.array(mask, pa.int32())})

    return materialize(matrix.mapInArrow(masked, "doc_id long, part string, mask int"), "masks")


def with_labels(masks: DataFrame, labels: DataFrame, id_col: str) -> DataFrame:
    """`masks` with good and toxic (0 or 1); of several label rows of one id the largest values count."""
    known = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("doc_id"))
    known = known.agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    flag = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    named = masks.where("doc_id is not null").join(known, "doc_id", "left").select("part", "mask", flag("good"), flag("toxic"))
    return named.union(masks.where("doc_id is null").select("part", "mask", F.lit(0), F.lit(0)))


def order_steps() -> Column:
    """Every step of every order: (filter_order, step, bit, earlier), `earlier` the bits of the filters before it."""
    steps = []
    for order in map("".join, permutations(FILTERS)):
        bits = [1 << FILTERS.index(f) for f in order]
        steps += [f"({order},{i + 1},{b},{sum(bits[:i])})" for i, b in enumerate(bits)]
    cells = F.split(F.lit(";".join(s.strip("()") for s in steps)), ";")
    cell = lambda s, i: F.split(s, ",")[i]
    return F.transform(cells, lambda s: F.struct(cell(s, 0).alias("filter_order"), *[cell(s, i + 1).cast("int").alias(n) for i, n in enumerate(("step", "bit", "earlier"))]))


def filter_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row per part, filter_order and step, with kept, removed, redundant, unique_fails, good_lost, toxic_lost and
    shapley (see the filters A to E in `Shard.add` and `failures`).

    A null text is empty; a null part is the empty string's part. A row without an id counts as larger than any id: it
    fails E if a row with an id has its text, never because of another row without one, and has no labels. Rows that
    repeat an id don't fail E because of each other. Only the named columns are read. An empty table gives no row.
    """
    marked = with_labels(failures(docs, id_col, text_col, part_col, shard_bytes), labels, id_col)
    seen = materialize(marked.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic")), "patterns")
    steps = seen.select("*", F.explode(order_steps()).alias("s")).select("part", "mask", "n", "good", "toxic", "s.*")
    fails, passed = F.expr("mask & bit <> 0"), F.expr("mask & earlier = 0")
    total = lambda where, what: F.sum(F.when(where, F.col(what)).otherwise(F.lit(0))).alias
    out = steps.groupBy("part", "filter_order", "step", "bit").agg(
        total(F.expr("mask & (earlier | bit) = 0"), "n")("kept"),
        total(fails & passed, "n")("removed"),
        total(fails & ~passed, "n")("redundant"),
        total(F.col("mask") == F.col("bit"), "n")("unique_fails"),
        total(fails & passed, "good")("good_lost"),
        total(fails & passed, "toxic")("toxic_lost"),
    )
    return out.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "bit"))).drop("bit")
