"""Language of whole texts by hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from its code point. An n-gram's vector binds those of its letters:
the product of the letters' vectors, each turned by its distance from the n-gram's end. A text's profile bundles, that
is adds up, the vectors of all its n-grams. A language's prototype bundles the profiles of its texts, each scaled to the
same length. A text gets the language whose prototype has the largest cosine with its profile.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatt.llm.common import slices

DIM, GRAM = 1024, 3
#: Scale at which unit profiles are rounded to integers, so that their sums do not depend on the order.
SCALE = 1 << 12
FOLDS = 5
#: Letters whose vectors a task keeps, n-grams bound at once, characters of texts counted together.
LETTERS_KEPT, BOUND_AT_ONCE, CHARS_AT_ONCE = 20_000, 4096, 1 << 18
UNKNOWN = "und"


class Profiles:
    """Profiles of texts; holds the vectors of the letters met so far."""

    def __init__(self, dim: int = DIM, gram: int = GRAM):
        self.dim, self.gram, self.vectors = dim, gram, {}
        self.kind = np.zeros(0x110000, "i1")  # 2 a letter, 1 a mark that goes with one
        self.known = np.zeros(0x110000, bool)

    def vector(self, code: int) -> np.ndarray:
        if code not in self.vectors:
            if len(self.vectors) > LETTERS_KEPT:
                self.vectors = {}
            self.vectors[code] = (2 * np.random.Generator(np.random.PCG64(code)).integers(0, 2, self.dim) - 1).astype("f4")
        return self.vectors[code]

    def codes(self, text: str) -> np.ndarray:
        """Code points of the lower-case letters, words apart by one 0, one at either end; empty without a letter.

        Marks that combine with a letter belong to its word.
        """
        codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4").astype("i8")
        for code in np.unique(codes[~self.known[codes]]).tolist():
            self.kind[code] = {"L": 2, "M": 1}.get(unicodedata.category(chr(code))[0], 0)
            self.known[code] = True
        kinds = self.kind[codes]
        if not (kinds == 2).any():
            return codes[:0]
        codes = np.concatenate([[0], np.where(kinds > 0, codes, 0), [0]])
        return codes[(codes != 0) | (np.concatenate([[1], codes[:-1]]) != 0)]

    def grams(self, codes: np.ndarray) -> np.ndarray:
        """Each n-gram as one number, 21 bits a letter. Texts shorter than an n-gram are one, padded in front."""
        if len(codes) < self.gram:
            codes = np.concatenate([np.zeros(self.gram - len(codes), "i8"), codes])
        out = np.zeros(len(codes) - self.gram + 1, "i8")
        for i in range(self.gram):
            out = out << 21 | codes[i : len(codes) - self.gram + 1 + i]
        return out

    def bound(self, grams: np.ndarray) -> np.ndarray:
        """The vectors of n-grams, one a row."""
        out = np.ones((len(grams), self.dim), "f4")
        for turn in range(self.gram):
            letters, which = np.unique(grams >> (21 * turn) & 0x1FFFFF, return_inverse=True)
            out *= np.stack([np.roll(self.vector(int(c)), turn) for c in letters])[which]
        return out

    def of(self, texts: list[str]) -> np.ndarray:
        """Profiles of texts, one a row; zeros where a text has no letter."""
        out, start = np.zeros((len(texts), self.dim)), 0
        while start < len(texts):
            end, size = start, 0
            while end < len(texts) and (end == start or size + len(texts[end]) <= CHARS_AT_ONCE):
                size += len(texts[end])
                end += 1
            coded = [self.codes(t) for t in texts[start:end]]
            counted = [np.unique(self.grams(c), return_counts=True) if len(c) else (c, c) for c in coded]
            every, column = np.unique(np.concatenate([g for g, _ in counted]), return_inverse=True)
            row = np.repeat(np.arange(len(counted)), [len(g) for g, _ in counted])
            count = np.concatenate([n for _, n in counted])
            for low in range(0, len(every), BOUND_AT_ONCE):
                held = (column >= low) & (column < low + BOUND_AT_ONCE)
                table = np.zeros((len(counted), min(BOUND_AT_ONCE, len(every) - low)), "f4")
                table[row[held], column[held] - low] = count[held]
                out[start:end] += table @ self.bound(every[low : low + BOUND_AT_ONCE])
            start = end
        return out


def held_out(id_col: str) -> Column:
    """Whether a document is kept from learning: crc32 of its id as text is divisible by 5; so are rows without an id."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), F.lit(FOLDS)) == 0


def prototypes(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", dim: int = DIM) -> dict[str, list[int]]:
    """The prototype of every language of `docs`, rows without a language or letter apart.

    Each task sends one vector a language that it met; they are added up in integers, so the order does not matter.
    What reaches the driver is one vector of `dim` numbers a language.
    """

    def bundled(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiles, sums = Profiles(dim), {}
        for batch in slices(batches):
            found, langs = profiles.of(batch.column(0).to_pylist()), np.array(batch.column(1).to_pylist(), object)
            length = np.linalg.norm(found, axis=1)
            units = np.rint(SCALE * found / np.where(length > 0, length, 1)[:, None]).astype("i8")
            for lang in set(langs[length > 0].tolist()):
                sums[lang] = sums.get(lang, 0) + units[(langs == lang) & (length > 0)].sum(axis=0)
        if sums:
            yield pa.record_batch({"lang": pa.array(list(sums), pa.string()), "sums": pa.array([s.tolist() for s in sums.values()], pa.list_(pa.int64()))})

    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    sums = rows.mapInArrow(bundled, "lang string, sums array<long>").select("lang", F.posexplode("sums").alias("at", "value"))
    total = sums.groupBy("lang", "at").agg(F.sum("value").alias("value")).groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("at", "value"))).alias("v"))
    return {r["lang"]: [x["value"] for x in r["v"]] for r in total.orderBy("lang").collect()}


def predict(docs: DataFrame, learned: dict[str, list[int]], text_col: str = "text") -> DataFrame:
    """`docs` with lang_pred and score in front of its own columns, which get the prefix `d_` if they clash.

    The score is the cosine of the text's profile with the prototype (0 where it is negative), to 6 digits; of equal
    ones the first language in code-point order wins. Null texts, texts without a letter, and all texts when nothing
    was learned are `und` with score 0.
    """
    names = list(learned)
    table = np.array([learned[n] for n in names], "f8") if names else np.zeros((0, DIM))
    length = np.linalg.norm(table, axis=1, keepdims=True)
    table = table / np.where(length > 0, length, 1)
    dim = table.shape[1]

    @F.pandas_udf("lang_pred string, score double")
    def judged(texts):
        import pandas as pd

        profiles, langs, scores = Profiles(dim), [], []
        for start in range(0, len(texts), 512):
            found = profiles.of([t if isinstance(t, str) else "" for t in texts.iloc[start : start + 512]])
            size = np.linalg.norm(found, axis=1)
            close = np.round(found @ table.T / np.where(size > 0, size, 1)[:, None], 6)
            for row, some in zip(close, size > 0):
                best = int(row.argmax()) if some and len(names) else None
                langs.append(UNKNOWN if best is None else names[best])
                scores.append(0.0 if best is None else min(max(float(row[best]), 0.0), 1.0))
        return pd.DataFrame({"lang_pred": langs, "score": np.array(scores, "f8")})

    packed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), judged(docs[text_col]).alias("_p"))
    own = [F.col("_row").getField(c).alias(f"d_{c}" if c in ("lang_pred", "score") else c) for c in docs.columns]
    return packed.select(F.col("_p.lang_pred"), F.col("_p.score"), *own)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row, learned from the rows that are not held out.

    Repeated rows are each learned from and judged; rows without an id are held out; a null language is not learned.
    Extra columns are not read. An empty table gives no row.
    """
    learned = prototypes(docs.where(~held_out(id_col)), text_col, lang_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("_text"))
    return predict(rows, learned, "_text").select("doc_id", "held_out", "lang_pred", "score")
