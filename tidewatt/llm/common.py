"""What several operators share: whole-table reads, worker-side caches, whole-text tokenizing by distinct chunks."""

from __future__ import annotations

import codecs
import re
import sys
import types
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatt.session import materialize  # noqa: F401  (re-exported for the operators)

WORD = "[^\\x20\\x09-\\x0D]+"
#: What a worker's table of chunks may hold: entries (each costs some 150 bytes besides), and bytes of chunks and values.
#: An aged table holds as much again.
CACHE_ENTRIES, CACHE_BYTES = 400_000, 16 << 20
#: Rows that Spark sends to a Python worker at once: whole texts, so fewer than its usual 10,000.
BATCH_ROWS = 1_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def whole_text(name: str = "text"):
    """A text column in which null is the empty text."""
    return F.coalesce(F.col(name), F.lit(""))


def kept_by_worker(name: str, build: Callable[[], object]):
    """A value that a Python worker builds once and keeps for its later tasks."""
    store = sys.modules.setdefault("_tidewatt_worker", types.ModuleType("_tidewatt_worker"))
    if not hasattr(store, name):
        setattr(store, name, build())
    return getattr(store, name)


def small_batches(spark: SparkSession) -> None:
    """Lower the session's rows a batch to BATCH_ROWS, so that neither side holds thousands of whole texts."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def give_back() -> None:
    """Return the memory that a finished task has freed to the system: the worker lives on beside others."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass  # only glibc has it


def slices(batches: Iterable[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Small pieces of each batch, so that what a task holds at once stays small."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
    give_back()


class ChunkTable(dict):
    """Chunk of text -> bytes that stand for it; bounded, emptied when full. `learn` gives the value of a new chunk."""

    def __init__(self, learn: Callable[[str], bytes] | None = None):
        super().__init__()
        self.learn, self.held = learn, 0

    def __missing__(self, chunk: str) -> bytes:
        value = self.learn(chunk)
        self.keep(chunk, value)
        return value

    def keep(self, chunk: str, value: bytes) -> None:
        self[chunk] = value
        self.held += len(chunk) + len(value)

    def room(self) -> None:
        if len(self) > CACHE_ENTRIES or self.held > CACHE_BYTES:
            self.clear()
            self.held = 0


class AgedTable(ChunkTable):
    """A table whose entries stay at hand until it is full again: those used by then are kept, not learnt anew."""

    def __init__(self, learn: Callable[[str], bytes]):
        super().__init__(learn)
        self.before = {}

    def __missing__(self, chunk: str) -> bytes:
        value = self.before.get(chunk)
        if value is None:
            value = self.learn(chunk)
        self.keep(chunk, value)
        return value

    def room(self) -> None:
        if len(self) > CACHE_ENTRIES or self.held > CACHE_BYTES:
            self.before = dict(self)
        super().room()


#: Letters that stay one letter when a text is lower-cased or composed; U+0130 becomes two characters.
LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f"
#: Tokens of a byte-level tokenizer never cross these cuts: its splitting rule gives a word the one space before it,
#: keeps the rest of a run of white space apart, and ends a run of letters before any mark but an apostrophe.
MARKS = "!-&(-/:-@\\[-`{-~"
SPACED_CHUNK = re.compile(rf" ?[{LETTERS}]++(?![^{MARKS}\s])| ?\S+|\s+(?!\S)|\s+")
#: Nor do those of a word-end tokenizer, which drops white space.
WORD_CHUNK = re.compile(rf"\s*[{LETTERS}]+(?=[{MARKS}\s]|\Z)|\s*\S+|\s+")
LETTERS_ONLY = re.compile(rf" ?[{LETTERS}]+")


#: The printable characters in which byte-level models hold bytes: a printable Latin-1 byte is itself, the others are
#: numbered from 256 on.
BYTES_AS = {b: 256 + i for i, b in enumerate(b for b in range(256) if not (33 <= b < 127 or 161 <= b < 173 or 174 <= b))}
BYTE_CHARS = "".join(chr(BYTES_AS.get(b, b)) for b in range(256))


def byte_level(text: str) -> str:
    return codecs.charmap_decode(text.encode(), "strict", BYTE_CHARS)[0]


#: Characters that Python counts as white space and the tokenizers do not.
ODD_SPACES = "\x1c\x1d\x1e\x1f"
ODD_SPACE = re.compile(f"[{ODD_SPACES}]")
