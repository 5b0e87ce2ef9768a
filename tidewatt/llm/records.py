"""Token ids as length-delimited binary records, with a separate offset index for shuffled reads.

File format, little-endian, one file a shard (`shard=N/part-*`), records in ascending order of their ids:

    u64  length of the payload
    u32  masked checksum of those 8 bytes
    payload: i64 doc_id, u8 flags (1: doc_id is null, 2: ids are 4 bytes wide, else 2), 3 zero bytes, u32 n, n ids
    u32  masked checksum of the payload
    u8   10, which closes the record

A checksum c (CRC-32) is masked as ((c >> 15 | c << 17) + 0xa282ead8) mod 2^32, so that checksums of data that hold
checksums stay useful. The index is a table (shard, record_no, offset, length, doc_id, n_tokens, first_token,
ids_crc32): a reader that shuffles records opens a shard at `offset` and takes `length` bytes.

The shards are written by Spark's own file writer, so a lost executor or a repeated task leaves no half-written or
doubled file, and any file system that Spark can write to will do.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatt.llm.common import LETTERS_ONLY, ODD_SPACES, SPACED_CHUNK, AgedTable, byte_level, kept_by_worker, partitions, slices, whole_text
from tidewatt.session import shared_dir

MASK_DELTA = 0xA282EAD8
HEAD, BODY, FOOT = "<QI", "<qB3xI", "<I"
ID_NULL, WIDE = 1, 2
CLOSE = b"\n"


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return ((c >> 15 | c << 17) + MASK_DELTA) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: np.ndarray) -> bytes:
    """One record without its closing byte. `ids`: unsigned, two bytes wide if all are below 65,536."""
    wide = ids.dtype.itemsize == 4
    payload = struct.pack(BODY, doc_id or 0, (doc_id is None) * ID_NULL + wide * WIDE, len(ids)) + ids.tobytes()
    length = struct.pack("<Q", len(payload))
    return length + struct.pack(FOOT, masked(length)) + payload + struct.pack(FOOT, masked(payload))


def frames(data: bytes) -> Iterator[tuple[int, int, int | None, np.ndarray]]:
    """(offset, length, doc_id, ids as unsigned 32-bit) of every record; a damaged record is an error."""
    at = 0
    while at < len(data):
        size, check = struct.unpack_from(HEAD, data, at)
        if masked(data[at : at + 8]) != check:
            raise ValueError(f"damaged length at {at}")
        begin, end = at + 12, at + 12 + size
        payload = data[begin:end]
        if struct.unpack_from(FOOT, data, end)[0] != masked(payload) or data[end + 4 : end + 5] != CLOSE:
            raise ValueError(f"damaged record at {at}")
        doc_id, flags, n = struct.unpack_from(BODY, payload)
        ids = np.frombuffer(payload, "<u4" if flags & WIDE else "<u2", n, 16).astype("<u4")
        yield at, end + 5 - at, None if flags & ID_NULL else doc_id, ids
        at = end + 5


class Encoder:
    """Whole-text ids by a byte-level tokenizer of the tokenizers library.

    A text is cut where no token can cross (see SPACED_CHUNK), the library encodes each distinct chunk once, and the
    ids of the chunks are joined: the same ids as for the whole text. Texts with special strings or odd white space
    go to the library whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        #: A text that holds any of these goes to the library whole.
        self.whole = [*ODD_SPACES, *(t.content for t in self.tokenizer.get_added_tokens_decoder().values())]
        self.dtype, self.code = ("<u2", "H") if self.tokenizer.get_vocab_size(True) <= 1 << 16 else ("<u4", "I")
        self.model, self.known = self.tokenizer.model, AgedTable(self._chunk)

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _chunk(self, chunk: str) -> bytes:
        if LETTERS_ONLY.fullmatch(chunk):  # nothing for the library to split: its model takes it as it is
            return array(self.code, [t.id for t in self.model.tokenize(byte_level(chunk))]).tobytes()
        return self._library([chunk])[0]

    def __call__(self, text: str) -> np.ndarray:
        if any(s in text for s in self.whole):
            return np.frombuffer(self._library([text])[0], self.dtype)
        self.known.room()
        return np.frombuffer(b"".join(map(self.known.__getitem__, SPACED_CHUNK.findall(text))), self.dtype)


@dataclass(frozen=True)
class RecordSet:
    """Where the shards and their index lie."""

    shards: str
    index: str


def write_records(docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None) -> RecordSet:
    """Encodes every whole text, appends `end_id`, writes the ids in ascending order of `id_col` and indexes them.

    Null ids come first; rows of equal id go by their text; a null text is the empty text, so its record holds
    `end_id` alone. Repeated rows are repeated records. Only the two named columns are read. An empty table gives no
    record. `shards` defaults to the session's number of shuffle partitions; a shard is read back as one value, so
    keep it well under 2 GB.
    """
    spark = docs.sparkSession
    folder = folder or f"{shared_dir(spark)}/records-{uuid.uuid4().hex}"

    def encoded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = kept_by_worker("encoder_" + tokenizer, lambda: Encoder(tokenizer))
        end, shard = np.array([end_id]), TaskContext.get().partitionId()
        kind = encode.dtype if end_id < 1 << 8 * np.dtype(encode.dtype).itemsize else "<u4"
        for batch in slices(batches):
            out = [frame(i, np.concatenate([encode(t), end]).astype(kind)) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.record_batch({"frame": pa.array(out, pa.binary()), "shard": pa.array([shard] * len(out), pa.int32())})

    rows = docs.select(F.col(id_col).cast("long").alias("id"), whole_text(text_col).alias("text"))
    ordered = rows.repartitionByRange(shards or partitions(spark), "id", F.xxhash64("text")).sortWithinPartitions("id", "text")
    # The writer ends each row with its line separator: the byte that closes a record.
    framed = ordered.mapInArrow(encoded, "frame binary, shard int").select(F.col("frame").cast("string"), "shard")
    framed.write.partitionBy("shard").option("lineSep", "\n").text(f"{folder}/shards")

    index = read_frames(spark, f"{folder}/shards").select("shard", "record_no", "offset", "length", "doc_id", "n_tokens", "first_token", "ids_crc32")
    index.write.parquet(f"{folder}/index")
    return RecordSet(f"{folder}/shards", f"{folder}/index")


FRAME_SCHEMA = "shard int, record_no long, offset long, length long, doc_id long, n_tokens long, first_token long, ids_crc32 long"


def read_frames(spark, folder: str) -> DataFrame:
    """One row a record of the shards, every checksum verified: where it lies, its id, and what its ids are.

    `first_token` counts the ids of the records before it in its shard; `ids_crc32` is the CRC-32 of all ids as
    little-endian unsigned 32-bit integers.
    """

    def scanned(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            shard, before, rows = batch.column(0)[0].as_py(), 0, []
            for no, (offset, length, doc_id, ids) in enumerate(frames(batch.column(1)[0].as_py())):
                rows.append((shard, no, offset, length, doc_id, len(ids), before, zlib.crc32(ids.tobytes())))
                before += len(ids)
            names = [part.split()[0] for part in FRAME_SCHEMA.split(", ")]
            kinds = [pa.int32()] + [pa.int64()] * 7
            yield pa.record_batch({n: pa.array([r[i] for r in rows], k) for i, (n, k) in enumerate(zip(names, kinds))})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").schema("path string, modificationTime timestamp, length long, content binary").load(folder)
    numbered = files.select(F.regexp_extract("path", "/shard=(\\d+)/", 1).cast("int").alias("shard"), "content")
    return numbered.mapInArrow(scanned, FRAME_SCHEMA)


def records_digest(spark, records: RecordSet) -> DataFrame:
    """doc_id, start (ids of all records before it), n_tokens, ids_crc32 of every record.

    The running total over the shards is a window over one row a shard; within a shard the index has it.
    """
    index = spark.read.schema(FRAME_SCHEMA).parquet(records.index)
    totals = index.groupBy("shard").agg(F.sum("n_tokens").alias("in_shard"))
    bases = totals.select("shard", (F.sum("in_shard").over(Window.orderBy("shard")) - F.col("in_shard")).alias("base"))
    return index.join(bases, "shard").select("doc_id", (F.col("base") + F.col("first_token")).alias("start"), "n_tokens", "ids_crc32")


def read_sequences(spark, records: RecordSet, picked: DataFrame) -> DataFrame:
    """doc_id and ids (array of long) of the records that `picked` names by (shard, record_no): a shuffled read by the index.

    `picked` may name any part of the index in any order; each shard is opened once, where its records are named.
    """

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            data, places = batch.column(0)[0].as_py(), batch.column(1)[0].as_py()
            found = [next(frames(data[p["offset"] : p["offset"] + p["length"]])) for p in places]
            yield pa.record_batch({"doc_id": pa.array([f[2] for f in found], pa.int64()), "ids": pa.array([f[3].astype("i8") for f in found], pa.list_(pa.int64()))})

    index = spark.read.schema(FRAME_SCHEMA).parquet(records.index)
    places = index.join(picked.select("shard", "record_no"), ["shard", "record_no"]).groupBy("shard").agg(F.collect_list(F.struct("offset", "length")).alias("places"))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(records.shards)
    numbered = files.select(F.regexp_extract("path", "/shard=(\\d+)/", 1).cast("int").alias("shard"), "content")
    return numbered.join(places, "shard").select("content", "places").mapInArrow(cut, "doc_id long, ids array<long>")
