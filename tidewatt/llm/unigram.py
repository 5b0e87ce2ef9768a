"""SentencePiece-style encoding and decoding: unigram Viterbi over a double-array trie of pieces with log scores.

A text is marked first: a white-space marker in front, every space a marker. The encoding is the sequence of pieces
with the highest sum of log scores; a character that no piece covers becomes the pieces of its UTF-8 bytes, together
at a score below every piece. Decoding joins the pieces, collects byte pieces into UTF-8, and turns markers back into
spaces. Equal sums: the path whose last piece is longest wins, then so on towards the front.

The scores of a unigram model file are its own. Files of other models carry merge ranks instead of probabilities and get
Zipf scores: the piece of rank r scores -ln(r + 1).
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatt.llm.common import ChunkTable, slices, whole_text

MARKER = "▁"
#: A character in bytes scores this much below the worst piece.
FALLBACK_PENALTY = 10.0
#: Words at once through the Viterbi recursion.
LOT = 20_000


@dataclass(frozen=True)
class Pieces:
    """The vocabulary: piece texts by id, log scores, and the ids of the 256 byte pieces."""

    texts: list[str]
    scores: list[float]
    byte_ids: list[int]


def load_pieces(model: str) -> Pieces:
    """Pieces of a sentencepiece model file. Control and unknown pieces never match and decode to nothing."""
    from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

    sp = SentencePieceProcessor(model_file=model)
    n = sp.get_piece_size()
    usable = [not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i)) for i in range(n)]
    texts = [sp.id_to_piece(i) if usable[i] else "" for i in range(n)]
    byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
    told = sentencepiece_model_pb2.ModelProto.FromString(sp.serialized_model_proto()).trainer_spec
    if told.model_type == told.UNIGRAM:
        return Pieces(texts, [sp.get_score(i) if usable[i] else 0.0 for i in range(n)], byte_ids)
    ranks = {i: r for r, i in enumerate(sorted((i for i in range(n) if usable[i]), key=lambda i: (-sp.get_score(i), i)))}
    return Pieces(texts, [-math.log(ranks[i] + 1) if usable[i] else 0.0 for i in range(n)], byte_ids)


@dataclass(frozen=True)
class Trie:
    """Double array over UTF-8 bytes: the child of node s by byte b is t = base[s] + b + 1 if check[t] == s."""

    base: np.ndarray
    check: np.ndarray
    piece: np.ndarray  # id of the piece that ends at a node, or -1
    longest: int


def build_trie(pieces: Pieces) -> Trie:
    children: list[dict[int, int]] = [{}]
    ends = [-1]
    longest = 1
    for i, text in enumerate(pieces.texts):
        node, raw = 0, text.encode()
        for b in raw:
            if b not in children[node]:
                children[node][b] = len(children)
                children.append({})
                ends.append(-1)
            node = children[node][b]
        if raw:
            ends[node] = i
            longest = max(longest, len(raw))
    size = len(children) * 3 + 4096
    base, check, piece, used = np.zeros(size, "i4"), np.full(size, -1, "i4"), np.full(size, -1, "i4"), np.zeros(size, bool)
    used[0], slot, first_free = True, {0: 0}, 1
    forks = [k for k in range(len(children)) if len(children[k]) > 1]
    for node in sorted(forks, key=lambda k: -len(children[k])):  # the widest first: they fit worst
        kids = children[node]
        keys = np.array(sorted(kids)) + 1
        look = first_free
        while True:
            spots = look + np.flatnonzero(~used[look : look + 2048])
            spots = spots[spots >= keys[0]] - keys[0]
            fit = np.flatnonzero(~used[np.minimum(spots[:, None] + keys, size - 1)].any(axis=1))
            if len(fit):
                break
            look += 2048
        at = int(spots[fit[0]])
        base[node] = at  # by node for now
        used[at + keys] = True
        for key in keys:
            slot[kids[int(key) - 1]] = at + int(key)
        while used[first_free]:
            first_free += 1
    free = iter((256 + np.flatnonzero(~used[256:])).tolist())
    for node, kids in enumerate(children):  # an only child fits any slot
        if len(kids) == 1:
            ((key, kid),) = kids.items()
            slot[kid] = next(free)
            base[node] = slot[kid] - key - 1
    by_node, base = base[: len(children)].copy(), np.zeros(size, "i4")
    for node, kids in enumerate(children):
        base[slot[node]] = by_node[node]
        for kid in kids.values():
            check[slot[kid]] = slot[node]
    for node, where in slot.items():
        piece[where] = ends[node]
    return Trie(base, check, piece, longest)


class Viterbi:
    """Best segmentations of marked words, many words in step."""

    def __init__(self, pieces: Pieces, trie: Trie):
        self.pieces, self.trie = pieces, trie
        self.scores = np.array(pieces.scores)
        self.lengths = np.array([len(t.encode()) for t in pieces.texts])
        self.fallback = float(self.scores.min() - FALLBACK_PENALTY)

    def words(self, words: list[str]) -> list[list[int]]:
        """Ids of each word, in batches of similar length so that the padding stays small."""
        raw = [w.encode() for w in words]
        order = sorted(range(len(raw)), key=lambda k: len(raw[k]))
        out: list[list[int]] = [[] for _ in raw]
        start = 0
        while start < len(order):
            stop = start + 1
            while stop < len(order) and stop - start < LOT and len(raw[order[stop]]) <= 4 + 1.2 * len(raw[order[start]]):
                stop += 1
            for k, ids in zip(order[start:stop], self._lot([raw[k] for k in order[start:stop]])):
                out[k] = ids
            start = stop
        return out

    def _lot(self, raw: list[bytes]) -> list[list[int]]:
        n, width = len(raw), max(map(len, raw), default=0)
        sizes = np.array([len(r) for r in raw])
        text = np.frombuffer(b"".join(r.ljust(width, b"\0") for r in raw), "u1").reshape(n, width).astype("i4")
        best = np.full((n, width + 1), -np.inf)
        last = np.full((n, width + 1), -1, "i4")  # the piece that ends here; -2: a byte piece
        best[:, 0] = 0
        for i in range(width):
            here = np.flatnonzero((i < sizes) & (best[:, i] > -np.inf) & ((text[:, i] & 0xC0) != 0x80))
            lead = text[here, i]
            char = np.where(lead < 0x80, 1, np.where(lead < 0xE0, 2, np.where(lead < 0xF0, 3, 4)))
            node, rows, covered = np.zeros(len(here), "i4"), here, np.zeros(n, bool)
            for depth in range(min(self.trie.longest, width - i)):
                step = self.trie.base[node] + text[rows, i + depth] + 1
                step = np.minimum(step, len(self.trie.check) - 1)
                ok = (self.trie.check[step] == node) & (i + depth < sizes[rows])
                rows, node = rows[ok], step[ok]
                if not len(rows):
                    break
                found = self.trie.piece[node]
                hit = found >= 0
                r, p, j = rows[hit], found[hit], i + depth + 1
                covered[r[char[np.searchsorted(here, r)] == depth + 1]] = True
                score = best[r, i] + self.scores[p]
                better = score > best[r, j]
                best[r[better], j], last[r[better], j] = score[better], p[better]
            # A character without a piece of its own: its bytes, at one fallback score.
            for c in range(1, 5):
                r = here[(char == c) & ~covered[here]]
                if not len(r):
                    continue
                score = best[r, i] + self.fallback
                better = score > best[r, i + c]
                best[r[better], i + c] = score[better]
                last[r[better], i + c] = -1 - c
        out = []
        for k, word in enumerate(raw):
            ids, at, row = [], int(sizes[k]), last[k]
            while at > 0:
                p = int(row[at])
                if p >= 0:
                    ids.append(p)
                    at -= int(self.lengths[p])
                else:
                    ids.extend(self.pieces.byte_ids[b] for b in reversed(word[at + p + 1 : at]))
                    at += p + 1
            out.append(ids[::-1])
        return out


#: Cuts before a marker that follows another character: no piece holds a marker after another character.
MARKED_WORD = re.compile(f"{MARKER}+[^{MARKER}]*|[^{MARKER}]+")


class Codec:
    """Whole texts to ids and back."""

    def __init__(self, pieces: Pieces, trie: Trie):
        self.viterbi, self.pieces, self.known = Viterbi(pieces, trie), pieces, ChunkTable()
        if any(MARKER in t.lstrip(MARKER) for t in pieces.texts):
            raise ValueError("a piece holds a marker after another character: words can't be encoded apart")
        byte_of = {i: b for b, i in enumerate(pieces.byte_ids)}
        self.raw = [bytes([byte_of[i]]) if i in byte_of else t.encode() for i, t in enumerate(pieces.texts)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        words = [MARKED_WORD.findall(MARKER + t.replace(" ", MARKER)) if t else [] for t in texts]
        self.known.room()
        new = [w for w in {w for ws in words for w in ws} if w not in self.known]
        for w, ids in zip(new, self.viterbi.words(new)):
            self.known.keep(w, np.array(ids, "<i4").tobytes())
        return [np.frombuffer(b"".join(map(self.known.__getitem__, ws)), "<i4") for ws in words]

    def decode(self, ids: Iterable[int]) -> str:
        text = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace").replace(MARKER, " ")
        return text[1:] if text.startswith(" ") else text


def encode(docs: DataFrame, pieces: Pieces, id_col: str = "doc_id", text_col: str = "text", keep: Iterable[str] = (), keep_ids: bool = True) -> DataFrame:
    """doc_id, ids (array of int; unless `keep_ids` is off), n_pieces, n_fallback, n_chars, ids_crc32, round_trip of every whole text; no shuffle.

    A null text is the empty text, which has no piece. `round_trip` says whether the decoded ids give the text again;
    they do but for texts that hold the marker itself, which decodes to a space. Null ids and repeated rows stay;
    an empty table gives no row. `keep` names further columns to carry along. The trie is broadcast: its size follows
    the vocabulary, not the data.
    """
    shared = docs.sparkSession.sparkContext.broadcast((pieces, build_trie(pieces)))
    keep = list(keep)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("_text"), *keep)

    def encoded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(*shared.value)  # its table of words goes with the task: later stages need the memory
        first = np.array(codec.pieces.byte_ids)
        for batch in slices(batches):
            texts = batch.column(1).to_pylist()
            ids = codec.encode(texts)
            offsets = np.cumsum([0, *map(len, ids)]).astype("i4")
            yield pa.record_batch(
                {
                    "doc_id": batch.column(0),
                    **{k: batch.column(2 + i) for i, k in enumerate(keep)},
                    **({"ids": pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*ids, np.zeros(0, "<i4")]).astype("i4")))} if keep_ids else {}),
                    "n_pieces": pa.array([len(x) for x in ids], pa.int64()),
                    "n_fallback": pa.array([int(np.isin(x, first).sum()) for x in ids], pa.int64()),
                    "n_chars": pa.array([len(t) for t in texts], pa.int64()),
                    "ids_crc32": pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64()),
                    "round_trip": pa.array([codec.decode(x.tolist()) == t for x, t in zip(ids, texts)], pa.bool_()),
                }
            )

    kinds = dict(docs.dtypes)
    schema = ", ".join(["doc_id long", *(f"`{k}` {kinds[k]}" for k in keep), *["ids array<int>"] * keep_ids, "n_pieces long", "n_fallback long", "n_chars long", "ids_crc32 long", "round_trip boolean"])
    return rows.mapInArrow(encoded, schema)


def decode(encoded: DataFrame, pieces: Pieces) -> DataFrame:
    """doc_id and text of rows of (doc_id, ids)."""
    spark: SparkSession = encoded.sparkSession
    shared = spark.sparkContext.broadcast(pieces)

    def decoded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(shared.value, Trie(np.zeros(1, "i4"), np.full(1, -1, "i4"), np.full(1, -1, "i4"), 1))
        for batch in slices(batches):
            yield pa.record_batch({"doc_id": batch.column(0), "text": pa.array([codec.decode(x or []) for x in batch.column(1).to_pylist()], pa.string())})

    return encoded.select("doc_id", "ids").mapInArrow(decoded, "doc_id long, text string")
