"""Token counts at every prefix of a text, kept so that budget and truncation questions need no new encoding.

State of the dynamic programme: the count at the last cut that no token crosses. The prefixes of the chunk after it
add to it: count(text[:i]) = count at the start of the chunk + count(chunk[:j]).
The counts of a chunk's prefixes come from the library, once for each distinct one. A long run without white space is
cut where the library itself splits it before it looks for tokens, and the count carried on from each cut. What is stored
is the step from each prefix to the next, one signed byte a character (two or eight where a step needs them):
`at_prefix` sums it.
"""

from __future__ import annotations

import json
import unicodedata
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatt.llm.common import LETTERS_ONLY, ODD_SPACE, WORD_CHUNK, ChunkTable, byte_level, kept_by_worker, slices, whole_text

#: A word longer than this is cut at the library's own splits first.
LONGEST_WORD = 512
#: Prefixes that the library counts at once, and repeated pieces that are kept for one word.
AT_ONCE, PIECES_KEPT = 64, 20_000


def joins_back(char: str) -> bool:
    """Whether the character may join the one before it, or become several, when a text is normalised."""
    return unicodedata.category(char)[0] == "M" or "\u1160" <= char <= "\u11ff" or len(unicodedata.normalize("NFC", char).lower()) != 1


class PieceCounter:
    """Token counts at all prefixes of one piece that is a single word to the model, in time that grows with its length.

    Merging by rank gives a part of a word the same tokens on its own as inside, as long as no token crosses its ends;
    and tokens are an encoding if each two neighbours are one. So the last token of a prefix is the one vocabulary entry
    that ends there and stands beside the last token of what is before it.
    """

    def __init__(self, path: str, model):
        from tokenizers.models import BPE

        with open(path, encoding="utf-8") as f:
            told = json.load(f)["model"]
        self.able = told["type"] == "BPE" and not any(told.get(k) for k in ("dropout", "continuing_subword_prefix", "byte_fallback", "ignore_merges", "unk_token"))
        if not self.able:
            return
        self.suffix, self.vocab, self.ends = told.get("end_of_word_suffix") or "", told["vocab"], model
        self.inside = BPE(vocab=told["vocab"], merges=[tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in told["merges"]])
        self.longest, self.known = max(map(len, told["vocab"])), {}

    def beside(self, before: str, token: str, last: bool) -> bool:
        """Whether `token` stays whole after `before`; `last`: at the end of the word."""
        key = (before, token, last)
        if key not in self.known:
            if len(self.known) > 300_000:
                self.known = {}
            model, end = (self.ends, self.suffix) if last else (self.inside, "")
            self.known[key] = [t.value for t in model.tokenize(before + token)] == [*[before] * bool(before), token + end]
        return self.known[key]

    def __call__(self, piece: str) -> list[int] | None:
        """None where the rule does not hold."""
        low = [c.lower() for c in piece]
        if not self.able or not unicodedata.is_normalized("NFC", piece) or any(len(c) != 1 for c in low):
            return None
        counts, units, last, inner = [], "", [""], [0]
        for char in low:
            for unit in byte_level(char):
                units += unit
                end = len(units)
                for start in range(end - 1, max(-1, end - 1 - self.longest), -1):
                    token = units[start:end]
                    if token in self.vocab and last[start] is not None and self.beside(last[start], token, False):
                        last.append(token)
                        inner.append(inner[start] + 1)
                        break
                else:
                    last.append(None)
                    inner.append(0)
            end = len(units)
            for start in range(end - 1, max(-1, end - 1 - self.longest), -1):
                token = units[start:end]
                if token + self.suffix in self.vocab and last[start] is not None and self.beside(last[start], token, True):
                    counts.append(inner[start] + 1)
                    break
            else:
                return None
        return counts


class PrefixCounter:
    """Steps of the token count over all prefixes of whole texts."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.steps, self.prefixes, self.single = ChunkTable(self._learn), {}, PieceCounter(path, self.model)

    def library(self, texts: list[str]) -> list[int]:
        return [len(e) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _counts(self, word: str) -> list[int]:
        """Counts of the word's prefixes of 1, 2, ... characters."""
        low, known = word.lower(), self.prefixes
        if len(word) > LONGEST_WORD:
            return self._long_counts(word)
        if not (LETTERS_ONLY.fullmatch(word) and LETTERS_ONLY.fullmatch(low)):
            return self.library([word[:i] for i in range(1, len(word) + 1)])
        # Letters only: nothing for the library to split or change, so its model counts the lower-case prefixes.
        raw, counts = low.isascii(), []
        for i in range(1, len(low) + 1):
            p = low[:i]
            c = known.get(p)
            if c is None:
                c = known[p] = len(self.model.tokenize(p if raw else byte_level(p)))
            counts.append(c)
        return counts

    def _cuts(self, word: str) -> list[int]:
        """Places in a word before which every longer prefix is split alike: the starts of the library's pre-tokens."""
        encoding = self.tokenizer.encode(word, add_special_tokens=False)
        starts, before, cuts, ended = {}, None, [0], False
        for (begin, _), nth in zip(encoding.offsets, encoding.word_ids):
            if nth is None or nth != before:
                starts[begin] = None
            before = nth
        for at in sorted(starts):
            special = next((s for s in self.specials if word.startswith(s, at)), None)
            # A special string is plain text until it is whole, so marks before it may go with its beginning.
            plain = special is None or ended == at or (unicodedata.category(word[at - 1])[0] in "LN" and not joins_back(word[at - 1]))
            if at and plain and not joins_back(word[at]):
                cuts.append(at)
            ended = at + len(special) if special else -1
        return [*cuts, len(word)]

    def _piece_counts(self, piece: str) -> list[int]:
        if len(piece) > LONGEST_WORD and not any(s in piece for s in self.specials):
            counts = self.single(piece)
            if counts and all(self.library([piece[:i]])[0] == counts[i - 1] for i in (len(piece) // 3, len(piece))):
                return counts
        counts = []
        for start in range(1, len(piece) + 1, AT_ONCE):
            counts += self.library([piece[:i] for i in range(start, min(start + AT_ONCE, len(piece) + 1))])
        return counts

    def _long_counts(self, word: str) -> list[int]:
        cuts, counts, known = self._cuts(word), [], {}
        for begin, end in zip(cuts, cuts[1:]):
            piece, carried = word[begin:end], counts[-1] if counts else 0
            if piece not in known:
                if len(known) > PIECES_KEPT:
                    known = {}
                known[piece] = self._piece_counts(piece)
            counts += [carried + c for c in known[piece]]
        return counts

    def _learn(self, chunk: str) -> bytes | np.ndarray:
        if len(self.prefixes) > 200_000:
            self.prefixes = {}
        word = chunk.lstrip()
        counts = [0] * (len(chunk) - len(word)) + (self._counts(word) if word else [])
        steps = [b - a for a, b in zip([0, *counts], counts)]
        try:
            return array("b", steps).tobytes()
        except OverflowError:
            return np.array(steps, "<i2" if max(map(abs, steps)) < 1 << 15 else "<i8")

    def __call__(self, text: str) -> tuple[bytes, int]:
        """(steps, count of the whole text)."""
        if ODD_SPACE.search(text):
            return self._whole(text)
        self.steps.room()
        parts = list(map(self.steps.__getitem__, WORD_CHUNK.findall(text)))
        joined = b"".join(parts)
        if len(joined) != len(text):  # some part has steps of more than a byte
            wide = np.concatenate([p if isinstance(p, np.ndarray) else np.frombuffer(p, "i1") for p in parts])
            return wide.tobytes(), int(wide.sum(dtype="i8"))
        return joined, int(np.frombuffer(joined, "i1").sum(dtype="i8"))

    def _whole(self, text: str) -> tuple[bytes, int]:
        """Texts with characters that only Python takes for white space, as one run cut by the library."""
        steps = np.diff(np.array(self._long_counts(text), "<i8"), prepend=0)
        return steps.tobytes(), int(steps.sum())


def at_prefix(steps: bytes, n_chars: int) -> np.ndarray:
    """Token counts of text[:0], text[:1], ..., text[:n_chars]."""
    kind = {1: "i1", 2: "<i2", 8: "<i8"}[len(steps) // n_chars] if n_chars else "i1"
    return np.concatenate([[0], np.cumsum(np.frombuffer(steps, kind), dtype="i8")])


def prefix_counts(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", keep_steps: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_chars, n_tokens and `steps` of every whole text; no shuffle.

    A null text is the empty text: 0 tokens. Null ids and repeated rows stay as they are; an empty table gives no
    row. Special strings inside a text count as the library's default counts them. Exact at every prefix.
    """

    def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = kept_by_worker("prefix_counter_" + tokenizer, lambda: PrefixCounter(tokenizer))
        for batch in slices(batches):
            texts = batch.column(1).to_pylist()
            found = [count(t) for t in texts]
            out = {
                "doc_id": batch.column(0),
                "n_bytes": pa.array([len(t.encode()) for t in texts], pa.int64()),
                "n_chars": pa.array([len(t) for t in texts], pa.int64()),
                "n_tokens": pa.array([n for _, n in found], pa.int64()),
            }
            yield pa.record_batch(out | ({"steps": pa.array([s for s, _ in found], pa.binary())} if keep_steps else {}))

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    return rows.mapInArrow(counted, "doc_id long, n_bytes long, n_chars long, n_tokens long" + ", steps binary" * keep_steps)


def fit_to_budget(counts: DataFrame, budget: int) -> DataFrame:
    """doc_id and `fits`: the characters of the longest prefix of at most `budget` tokens, from the stored steps alone."""

    def fitted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            fits = [int(np.flatnonzero(at_prefix(s, n) <= budget)[-1]) for s, n in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.record_batch({"doc_id": batch.column(0), "fits": pa.array(fits, pa.int64())})

    return counts.select("doc_id", "steps", "n_chars").mapInArrow(fitted, "doc_id long, fits long")
