"""Linear models: least squares, ridge and the epsilon-insensitive fit."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatt.models.features import fit_features
from tidewatt.models.gram import dot, gram, smallest_solution
from tidewatt.models.preprocess import cached

Predict = Callable[[DataFrame], DataFrame]


def fit_linear(train: DataFrame, target: str = "load_mw") -> Predict:
    """Least squares. Columns that depend on each other leave many solutions; the smallest weights are taken."""
    return _fit(train, target, 0.0)


def fit_ridge(train: DataFrame, target: str = "load_mw", alpha: float = 10.0) -> Predict:
    """Ridge with a free intercept; `alpha` multiplies the squared weights against the summed squared error."""
    return _fit(train, target, alpha)


def _fit(train: DataFrame, target: str, alpha: float) -> Predict:
    """The normal equations are one distributed aggregate, taken around the target's mean; their solution has the size
    of the feature list."""
    with cached(train) as rows:
        features = fit_features(rows)
        y = F.col(target).cast("double")
        centre = rows.agg(F.avg(y)).first()[0]
        if centre is None:
            raise ValueError("no rows to fit")
        x = F.concat(vector_to_array("features"), F.array(F.lit(1.0)))
        g = gram(features(rows).select(x.alias("x"), (y - centre).alias("y")))
    mean, level = g.xtx[:-1, -1] / g.n, g.xty[-1] / g.n
    spread = g.xtx[:-1, :-1] - g.n * np.outer(mean, mean)
    right = g.xty[:-1] - g.n * mean * level
    weights = np.linalg.solve(spread + alpha * np.eye(len(mean)), right) if alpha else smallest_solution(spread, right)
    coefficients, intercept = [float(w) for w in weights], float(centre + level - mean @ weights)

    def predict(df: DataFrame) -> DataFrame:
        value = dot(vector_to_array("features"), F.lit(coefficients)) + F.lit(intercept)
        return features(df).withColumn("predicted_load_mw", value).drop("features")

    return predict


def fit_eps_insensitive(
    train: DataFrame,
    target: str = "load_mw",
    c: float = 1.0,
    epsilon: float = 0.1,
    max_iter: int = 5_000,
    tolerance: float = 1e-6,
) -> Predict:
    """Linear fit that ignores errors up to `epsilon` and counts the rest linearly.

    Minimises |w|^2 / 2 + c * sum(max(0, |y - xw| - epsilon)) by reweighted
    normal equations; each step is one aggregate over the rows and a solve of
    the size of the feature list, until no weight moves by more than
    `tolerance` of the largest. `converged` of the returned function says
    whether that happened within `max_iter` steps.
    """
    with cached(train) as kept:
        features = fit_features(kept)
    design = features(train).select(
        F.concat(vector_to_array("features"), F.array(F.lit(1.0))).alias("x"), F.col(target).cast("double").alias("y")
    )
    with cached(design) as rows:
        start = gram(rows)
        size = start.xtx.shape[0]
        weights = np.linalg.solve(start.xtx + np.eye(size), start.xty)
        floor = max(1e-6 * float(np.sqrt(start.yty / max(start.n, 1))), 1e-9)
        converged = False
        for _ in range(max_iter):
            step = gram(rows, _reweight(weights, c, epsilon, floor))
            new = np.linalg.solve(step.xtx + np.eye(size), step.xty)
            moved = float(np.abs(new - weights).max())
            weights = new
            converged = moved <= tolerance * max(1.0, float(np.abs(weights).max()))
            if converged:
                break
    coefficients = [float(w) for w in weights]

    def predict(df: DataFrame) -> DataFrame:
        x = F.concat(vector_to_array("features"), F.array(F.lit(1.0)))
        return features(df).withColumn("predicted_load_mw", dot(x, F.lit(coefficients))).drop("features")

    predict.converged = converged
    return predict


def _reweight(weights: np.ndarray, c: float, epsilon: float, floor: float):
    def rows(x: np.ndarray, y: np.ndarray):
        residual = y - x @ weights
        beyond = np.abs(residual) - epsilon
        # Rows inside the tube pull with the smallest weight, so the step stays defined.
        weight = np.where(beyond > 0, c / np.maximum(beyond, floor), 1e-9)
        return x, y - np.sign(residual) * epsilon * (beyond > 0), weight

    return rows
