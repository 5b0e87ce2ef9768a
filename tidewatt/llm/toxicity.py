"""Toxicity by a classifier chain: categories in a fixed order, each a linear model over words and the earlier
categories' probabilities.

While a later model is trained, the probabilities of the earlier ones come from models that have not seen the row
(out of fold); while texts are scored, from the models trained on all training rows. A model is a ridge logistic
regression over the words and stems that go with its category: those whose share of texts differs between the classes by at
least LEAST_Z standard errors, MOST_WORDS at most.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatt.llm.common import whole_text

TOKEN = re.compile(r"[^\W_]+")
STEM = 5
#: Shares of a text's distinct words that a stem may reach, each a feature of its own.
STEM_SHARES = (0.005, 0.02, 0.05)
MOST_WORDS, LEAST_Z, LEAST_TEXTS = 512, 4.0, 5
RIDGE, ROUNDS = 1.0, 25


def features(text: str) -> set[str]:
    """The whole text's distinct lower-case words, their stems (first letters, with a tilde), and for each stem of two
    or more words which shares of the words it reaches."""
    words = set(TOKEN.findall(text.lower()))
    stems = Counter(w[:STEM] for w in words if len(w) > STEM)
    out = words | {f"{s}~" for s in stems}
    out.update(f"{s}~{share:g}" for s, n in stems.items() if n > 1 for share in STEM_SHARES if n >= share * len(words))
    return out


@dataclass(frozen=True)
class Link:
    """A linear model: weights of words, then of the earlier links' probabilities."""

    category: str
    words: dict[str, float]
    earlier: tuple[float, ...]
    bias: float


@dataclass(frozen=True)
class Chain:
    """Links in order; texts whose last probability is at or above `cut` are toxic."""

    links: tuple[Link, ...]
    cut: float

    def probabilities(self, text: str | None) -> list[float]:
        found, out = features(text or ""), []
        for link in self.links:
            z = link.bias + sum(link.words[w] for w in found & link.words.keys()) + sum(v * p for v, p in zip(link.earlier, out))
            out.append(float(1 / (1 + np.exp(-z))))
        return out


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Ridge logistic regression by Newton steps; the bias is not penalised. One class only: its log odds, smoothed."""
    n, m = x.shape
    if y.min(initial=1) == y.max(initial=0) or not m:
        return np.zeros(m), float(np.log((y.sum() + 0.5) / (n - y.sum() + 0.5)))
    x = np.column_stack([x, np.ones(n)])
    w, penalty = np.zeros(m + 1), np.append(np.full(m, RIDGE), 1e-6)
    w[-1] = np.log(y.mean() / (1 - y.mean()))
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - y) + penalty * w
        step = np.linalg.solve((x * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ x + np.diag(penalty), slope)
        w -= step * min(1.0, 5 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


class Texts:
    """Training texts as sets of feature numbers."""

    def __init__(self, texts: list[str]):
        self.names: dict[str, int] = {}
        self.rows = [np.array([self.names.setdefault(w, len(self.names)) for w in sorted(features(t))], "i8") for t in texts]
        self.words = list(self.names)

    def fit(self, picked: np.ndarray, y: np.ndarray, earlier: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """(numbers of the chosen words, weights of words and earlier probabilities, bias) from the picked rows."""
        size, own = len(self.words), y[picked]
        total = lambda rows: np.bincount(np.concatenate([*(self.rows[i] for i in rows), np.zeros(0, "i8")]), minlength=size)
        yes, no = total(picked[own == 1]), total(picked[own == 0])
        n1, n0 = max(int(own.sum()), 1), max(int((1 - own).sum()), 1)
        share = (yes + no) / (n1 + n0)
        z = np.abs(yes / n1 - no / n0) / np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / n1 + 1 / n0))
        z[(yes + no < LEAST_TEXTS) | (own.min(initial=1) == own.max(initial=0))] = 0
        chosen = np.sort(np.argsort(-z, kind="stable")[:MOST_WORDS])
        chosen = chosen[z[chosen] >= LEAST_Z]
        return chosen, *logistic(np.column_stack([self.marks(picked, chosen), earlier[picked]]), own)

    def marks(self, picked: np.ndarray, chosen: np.ndarray) -> np.ndarray:
        place = np.full(len(self.words) + 1, -1)
        place[chosen] = np.arange(len(chosen))
        out = np.zeros((len(picked), len(chosen)))
        for k, i in enumerate(picked):
            at = place[self.rows[i]]
            out[k, at[at >= 0]] = 1
        return out


def train_chain(texts: list[str], labels: np.ndarray, folds: np.ndarray, categories: tuple[str, ...]) -> Chain:
    """`labels`: one 0/1 column a category; `folds`: the fold of each row."""
    own, every, links = Texts(texts), np.arange(len(texts)), []
    earlier = np.zeros((len(texts), 0))
    for c, category in enumerate(categories):
        y, unseen = labels[:, c], np.zeros(len(texts))
        for fold in np.unique(folds):
            held = every[folds == fold]
            chosen, w, bias = own.fit(every[folds != fold], y, earlier)
            unseen[held] = 1 / (1 + np.exp(-(np.column_stack([own.marks(held, chosen), earlier[held]]) @ w + bias)))
        chosen, w, bias = own.fit(every, y, earlier)
        names = [own.words[i] for i in chosen]
        links.append(Link(category, dict(zip(names, w.tolist())), tuple(w[len(names) :].tolist()), bias))
        earlier = np.column_stack([earlier, unseen])
    return Chain(tuple(links), best_cut(earlier[:, -1], labels[:, -1]))


def best_cut(p: np.ndarray, y: np.ndarray) -> float:
    """The cut, in hundredths, with the best F1 on out-of-fold probabilities, the middle one of equals; 0.5 without a
    positive row."""
    cuts = np.arange(5, 96) / 100
    f1 = np.array([2 * ((p >= c) & (y == 1)).sum() / max((p >= c).sum() + (y == 1).sum(), 1) for c in cuts])
    best = np.flatnonzero(f1 == f1.max())
    return float(cuts[best[len(best) // 2]]) if f1.max() > 0 else 0.5


def fit_chain(docs: DataFrame, labels: DataFrame, categories: tuple[str, ...], id_col: str = "doc_id", text_col: str = "text", most_rows: int = 10_000, folds: int = 3) -> Chain:
    """Trains on the labelled rows, on about `most_rows` of them at most (picked by a hash of their id), in one task:
    `most_rows` is the bound of what it holds.

    `labels` has the id and one 0/1 column a category. Rows with a null id or category are left out; of several label
    rows of one id the largest values count. Copies of one text fall into one fold. Without labelled rows every
    probability is one half and nothing is toxic.
    """
    own = labels.select(F.col(id_col).alias("_id"), *[F.col(c).cast("int") for c in categories]).dropna()
    own = own.groupBy("_id").agg(*[F.max(c).alias(c) for c in categories])
    part = min(1.0, most_rows / max(own.count(), 1))
    own = own.where(F.pmod(F.xxhash64("_id"), F.lit(1_000_000)) < int(part * 1_000_000))
    texts = docs.select(F.col(id_col).alias("_id"), whole_text(text_col).alias("_text")).where(F.col(id_col).isNotNull())
    # The sample is bounded by `most_rows`; past 100,000 the planner chooses the join.
    rows = texts.join(F.broadcast(own) if most_rows <= 100_000 else own, "_id")
    rows = rows.select("_text", F.pmod(F.xxhash64("_text"), F.lit(folds)).cast("int").alias("fold"), *categories)

    def trained(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pickle

        table = pa.Table.from_batches(batches).to_pydict() if (batches := list(batches)) else None
        if table and table["_text"]:
            y = np.column_stack([table[c] for c in categories])
            chain = train_chain(table["_text"], y, np.array(table["fold"]), categories)
            plain = ([(k.category, k.words, k.earlier, k.bias) for k in chain.links], chain.cut)
            yield pa.record_batch({"model": pa.array([pickle.dumps(plain)], pa.binary())})

    # The scan and the join stay spread; only the sample moves to one task.
    found = rows.repartition(1).sortWithinPartitions("_text", *categories).mapInArrow(trained, "model binary").collect()
    if not found:
        return Chain(tuple(Link(c, {}, (0.0,) * i, 0.0) for i, c in enumerate(categories)), 0.75)
    import pickle

    links, cut = pickle.loads(found[0][0])
    return Chain(tuple(Link(*k) for k in links), cut)


def score(docs: DataFrame, chain: Chain, text_col: str = "text") -> DataFrame:
    """`docs` with p_<category> of every link and `is_toxic` in front of its own columns, which get the prefix `d_` if
    they clash; whole texts, no shuffle. A null text has no words. An empty table gives no row.
    """
    plain = ([(k.category, k.words, k.earlier, k.bias) for k in chain.links], chain.cut)
    names = [f"p_{k.category}" for k in chain.links]

    @F.pandas_udf(", ".join(f"`{n}` double" for n in names))
    def judged(texts):
        import pandas as pd

        own = Chain(tuple(Link(*k) for k in plain[0]), plain[1])
        return pd.DataFrame([own.probabilities(t) for t in texts], columns=names, dtype="float64")

    packed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), judged(docs[text_col]).alias("_p"))
    clash = {*names, "is_toxic"}
    own = [F.col("_row").getField(c).alias(f"d_{c}" if c in clash else c) for c in docs.columns]
    return packed.select(*[F.col("_p").getField(n).alias(n) for n in names], (F.col("_p").getField(names[-1]) >= chain.cut).alias("is_toxic"), *own)


def chain_for(docs: DataFrame, labels: DataFrame) -> Chain:
    """The production chain: low quality first, toxic second."""
    return fit_chain(docs, labels.select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic"), ("low_quality", "toxic"))
