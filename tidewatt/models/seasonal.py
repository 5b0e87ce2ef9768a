"""Trend, seasons and weather regressors, one fit per region."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatt import constants as K
from tidewatt.models import basis as B
from tidewatt.models import rows as R
from tidewatt.models.gram import dot, grams_by, solve_by
from tidewatt.operators.ordered import small_table
from tidewatt.operators.quantiles import exact_quantiles

HINGES = 25
SEASONS = [("yearly", 365.25, 10), ("weekly", 7.0, 3), ("daily", 1.0, 4)]


def days(ts: str = "time_utc") -> Column:
    return F.unix_timestamp(ts) / F.lit(86400.0)


def design_rows(raw: np.ndarray) -> np.ndarray:
    """Design rows from (day, place in the history, scaled regressors)."""
    day, t = raw[:, 0], raw[:, 1]
    seasons = [R.fourier(day, period, order) for _, period, order in SEASONS]
    return np.hstack([np.ones((len(raw), 1)), t[:, None], R.hinges(t, HINGES), *seasons, raw[:, 2:]])


def fit_seasonal_by_region(
    train: DataFrame,
    changepoint_scale: float = 0.05,
    seasonality_scale: float = 10.0,
    regressors: list[str] | None = None,
):
    """Ridge fit of a hinged trend, Fourier seasons and regressors for each region.

    Regressors are filled with the region's own training median and scaled by
    its mean and deviation. Returns a function that scores rows; predictions
    never fall below zero, and a region that was not trained gets null.
    """
    names = [c for c in (regressors or K.SEASONAL_REGRESSORS) if c in train.columns]
    typed = train.withColumns({c: F.col(c).cast("double") for c in names})
    medians = small_table(exact_quantiles(typed, names, by=["region"]).toDF("region", *[f"__med_{c}" for c in names]))

    def fill(df: DataFrame) -> DataFrame:
        present = lambda c: F.col(c).cast("double") if c in df.columns else F.lit(None).cast("double")
        filled = {c: F.coalesce(present(c), F.col(f"__med_{c}"), F.lit(0.0)) for c in names}
        return df.join(medians, "region", "left").withColumns(filled).drop(*[f"__med_{c}" for c in names])

    filled = fill(typed)
    summary = filled.groupBy("region").agg(
        F.min(days()).alias("__d0"),
        F.max(days()).alias("__d1"),
        F.max(F.abs("load_mw")).alias("__scale"),
        *[F.avg(c).alias(f"__m_{c}") for c in names],
        *[F.stddev_pop(c).alias(f"__s_{c}") for c in names],
    )

    stats = small_table(summary)

    scaled = [
        F.when(F.col(f"__s_{c}") > 0, (F.col(c) - F.col(f"__m_{c}")) / F.col(f"__s_{c}")).otherwise(0.0) for c in names
    ]

    def placed(df: DataFrame) -> DataFrame:
        # Day and trend are columns of their own, as the terms below repeat them many times.
        return fill(df).join(stats, "region", "left").withColumn("__day", days()).withColumn(
            "__t", (F.col("__day") - F.col("__d0")) / F.greatest(F.col("__d1") - F.col("__d0"), F.lit(1e-9))
        )

    def design(df: DataFrame) -> DataFrame:
        joined = placed(df)
        day, t = F.col("__day"), F.col("__t")
        x = F.concat(
            F.array(F.lit(1.0), t),
            B.hinges(t, HINGES),
            *[B.fourier(day, period, order) for _, period, order in SEASONS],
            F.array(*scaled) if scaled else F.array().cast("array<double>"),
        )
        return joined.withColumn("x", x)

    seasons = 2 * sum(order for _, _, order in SEASONS)
    ridge = np.concatenate(
        [
            np.full(2, 1e-6),
            np.full(HINGES, 1.0 / changepoint_scale**2),
            np.full(seasons + len(names), 1.0 / seasonality_scale**2),
        ]
    )
    raw = F.array(F.col("__day"), F.col("__t"), *scaled).alias("x")
    rows = placed(typed).select("region", raw, (F.col("load_mw") / F.nullif(F.col("__scale"), F.lit(0.0))).alias("y"))
    betas = small_table(
        solve_by(grams_by(rows, F.col("region"), lambda x, y: R.complete(design_rows(x), y)), np.diag(ridge)).select(F.col("key").alias("region"), "beta")
    )

    def predict(df: DataFrame) -> DataFrame:
        scored = design(df).join(betas, "region", "left")
        value = dot(F.col("x"), F.col("beta")) * F.col("__scale")
        return scored.withColumn(
            "predicted_load_mw", F.when(value.isNotNull(), F.greatest(value, F.lit(0.0)))
        ).select(*df.columns, "predicted_load_mw")

    return predict
