"""Tree ensembles from Spark ML under the parameter names of the model set."""

from __future__ import annotations

from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame

from tidewatt.models.features import fit_features
from tidewatt.models.linear import Predict
from tidewatt.models.preprocess import cached

MAX_DEPTH = 30  # Fixed value: the deepest tree Spark ML grows.


def _fit(train: DataFrame, estimator) -> Predict:
    with cached(train) as rows:
        features = fit_features(rows)
        model = estimator.fit(features(rows))
    return lambda df: model.transform(features(df)).drop("features")


def fit_boosted(
    train: DataFrame,
    target: str = "load_mw",
    n_estimators: int = 300,
    learning_rate: float = 0.05,
    max_depth: int = 6,
    subsample: float = 0.8,
    colsample: float = 0.8,
    min_child_rows: int = 1,
    seed: int = 42,
) -> Predict:
    return _fit(
        train,
        GBTRegressor(
            labelCol=target,
            predictionCol="predicted_load_mw",
            maxIter=n_estimators,
            stepSize=learning_rate,
            maxDepth=max_depth,
            subsamplingRate=subsample,
            featureSubsetStrategy=str(colsample),
            minInstancesPerNode=min_child_rows,
            seed=seed,
        ),
    )


def fit_boosted_shallow(train: DataFrame, target: str = "load_mw", num_leaves: int = 31, **kw) -> Predict:
    """Boosting limited by leaves: the depth whose full tree holds about that many leaves.

    Spark grows level by level, so the trees are balanced where a leaf-wise
    grower's are not.
    """
    return fit_boosted(train, target, max_depth=max(1, num_leaves.bit_length()), **kw)


def fit_forest(
    train: DataFrame,
    target: str = "load_mw",
    n_estimators: int = 300,
    max_depth: int = 0,
    min_samples_leaf: int = 1,
    seed: int = 42,
) -> Predict:
    """Random forest over all features per split; depth 0 means as deep as Spark grows."""
    return _fit(
        train,
        RandomForestRegressor(
            labelCol=target,
            predictionCol="predicted_load_mw",
            numTrees=n_estimators,
            maxDepth=max_depth if max_depth > 0 else MAX_DEPTH,
            minInstancesPerNode=min_samples_leaf,
            featureSubsetStrategy="all",
            seed=seed,
        ),
    )
