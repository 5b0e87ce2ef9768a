"""Normal equations as a distributed aggregate, whole or per group.

Each task reduces its rows to one (X'X, X'y, y'y, n) per group with numpy; two
grouping rounds then add those vectors up in the JVM, combined map-side. No task
ever gathers rows: the largest thing to travel is one square of the feature
count per task and group.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PARTIAL = "key string, task int, stats array<double>"
FAN_IN = 64
MAX_SIZE = 2_000

Prepare = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]


@dataclass
class Gram:
    xtx: np.ndarray
    xty: np.ndarray
    yty: float
    n: int

    def packed(self) -> np.ndarray:
        return np.concatenate([self.xtx.ravel(), self.xty, [self.yty, self.n]])


def dot(x: Column, w: Column) -> Column:
    """Inner product of two arrays, in the JVM."""
    return F.aggregate(F.zip_with(x, w, lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v)


def _matrix(column: pa.ListArray) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _partials(prepare: Prepare | None):
    def run(batches):
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        sums: dict[str, Gram] = {}
        for batch in batches:
            batch = batch.filter(batch.column("x").is_valid())
            if batch.num_rows == 0:
                continue
            keys = np.asarray(batch.column("key").to_pandas())
            x_all = _matrix(batch.column("x"))
            if x_all.shape[1] > MAX_SIZE:
                raise ValueError(f"{x_all.shape[1]} features exceed the {MAX_SIZE} a solve may take")
            y_all = batch.column("y").to_numpy(zero_copy_only=False)
            for key in np.unique(keys):
                chosen = keys == key
                x, y = x_all[chosen], y_all[chosen]
                w = np.ones(len(y))
                if prepare is not None:
                    x, y, w = prepare(x, y)
                xw = x * w[:, None]
                part = Gram(xw.T @ x, xw.T @ y, float((w * y * y).sum()), len(y))
                seen = sums.get(key)
                sums[key] = part if seen is None else _add(seen, part)
        yield pa.RecordBatch.from_pydict(
            {
                "key": pa.array(list(sums), pa.string()),
                "task": pa.array([task] * len(sums), pa.int32()),
                "stats": pa.array([g.packed() for g in sums.values()], pa.list_(pa.float64())),
            }
        )

    return run


def _add(a: Gram, b: Gram) -> Gram:
    return Gram(a.xtx + b.xtx, a.xty + b.xty, a.yty + b.yty, a.n + b.n)


def unpack(stats) -> Gram:
    values = np.asarray(stats, dtype=float)
    size = round((np.sqrt(4 * len(values) - 7) - 1) / 2)
    square = size * size
    return Gram(values[:square].reshape(size, size), values[square : square + size], float(values[-2]), int(values[-1]))


def grams_by(df: DataFrame, key: Column, prepare: Prepare | None = None) -> DataFrame:
    """One packed Gram per key from rows with `x` (array) and `y`; rows lacking either drop."""
    # A null x is dropped in the task: a filter on it would compute the whole row twice.
    rows = df.where("y is not null").select(key.cast("string").alias("key"), "x", "y")
    return added_up(rows.mapInArrow(_partials(prepare), PARTIAL))


def added_up(partial: DataFrame) -> DataFrame:
    """(key, stats): the vectors of (key, task, stats) rows summed by key, in two rounds. A key's have one length."""
    vectors = partial.select("key", (F.col("task") % FAN_IN).alias("task"), array_to_vector("stats").alias("v"))
    halfway = vectors.groupBy("key", "task").agg(Summarizer.sum(F.col("v")).alias("v"))
    total = halfway.groupBy("key").agg(Summarizer.sum(F.col("v")).alias("v"))
    return total.select("key", vector_to_array("v").alias("stats"))


def gram_entries(grams: DataFrame) -> DataFrame:
    """Packed Grams as (key, row_no, col_no, value) rows."""

    def entries(pdf: pd.DataFrame) -> pd.DataFrame:
        xtx = unpack(pdf["stats"].iloc[0]).xtx
        row, col = np.indices(xtx.shape)
        return pd.DataFrame({"key": pdf["key"].iloc[0], "row_no": row.ravel(), "col_no": col.ravel(), "value": xtx.ravel()})

    return grams.groupBy("key").applyInPandas(entries, "key string, row_no int, col_no int, value double")


def gram(df: DataFrame, prepare: Prepare | None = None) -> Gram:
    """The Gram of all rows. Only its square of the feature count reaches the driver."""
    row = grams_by(df, F.lit("all"), prepare).first()
    if row is None:
        raise ValueError("no rows to fit")
    return unpack(row["stats"])


def smallest_solution(xtx: np.ndarray, xty: np.ndarray) -> np.ndarray:
    """The least-squares weights of the smallest norm. Directions of less than 1e-10 of the largest spread are rounding."""
    return np.linalg.lstsq(xtx, xty, rcond=1e-10)[0]


def solve_by(grams: DataFrame, penalty: np.ndarray) -> DataFrame:
    """(key, beta, n) of each group's penalised least squares, solved where the group is."""

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        g = unpack(pdf["stats"].iloc[0])
        beta = np.linalg.lstsq(g.xtx + penalty, g.xty, rcond=None)[0]
        return pd.DataFrame([{"key": pdf["key"].iloc[0], "beta": beta.tolist(), "n": g.n}])

    return grams.groupBy("key").applyInPandas(solve, "key string, beta array<double>, n long")
