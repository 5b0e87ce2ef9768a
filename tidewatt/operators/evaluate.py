"""Forecast errors, metrics, comparisons of model runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatt.functions import scalar as S
from tidewatt.operators.ordered import join_small, pick_one

ACTUAL, PREDICTED = "actual_load_mw", "predicted_load_mw"


def clean_predictions(df: DataFrame) -> DataFrame:
    """Numbers and times coerced, rows lacking any of the three dropped; a stored absolute_error is kept."""
    out = (
        df.withColumn("time_utc", F.col("time_utc").try_cast("timestamp"))
        .withColumn("actual_load_mw", S.coerce_numeric(F.col(ACTUAL)))
        .withColumn("predicted_load_mw", S.coerce_numeric(F.col(PREDICTED)))
        .dropna(subset=["time_utc", "actual_load_mw", "predicted_load_mw"])
    )
    if "absolute_error" in df.columns:
        return out.withColumn("absolute_error", S.coerce_numeric(F.col("absolute_error")))
    return out.withColumn("absolute_error", F.abs(F.col(PREDICTED) - F.col(ACTUAL)))


def predictions_frame(df: DataFrame) -> DataFrame:
    """Predictions with their four error columns."""
    return df.withColumns(S.error_columns(F.col(ACTUAL), F.col(PREDICTED)))


def metric_columns(actual: str = ACTUAL, predicted: str = PREDICTED) -> dict[str, Column]:
    """Aggregates of the forecast metrics. MAPE averages over non-zero actuals only."""
    actual, predicted = F.col(actual), F.col(predicted)
    error = predicted - actual
    return {
        "MSE": F.avg(error * error),
        "RMSE": F.sqrt(F.avg(error * error)),
        "MAE": F.avg(F.abs(error)),
        "MAPE": F.avg(S.ape_percent(actual, predicted)),
        "BIAS": F.avg(error),
        "MEAN_ACTUAL": F.avg(actual),
        "MEAN_FORECAST": F.avg(predicted),
    }


def metrics(df: DataFrame, keys: Sequence[str] = (), actual: str = ACTUAL, predicted: str = PREDICTED) -> DataFrame:
    aggs = [c.alias(n) for n, c in metric_columns(actual, predicted).items()]
    return df.groupBy(*keys).agg(*aggs) if keys else df.agg(*aggs)


def metrics_by_month(df: DataFrame) -> DataFrame:
    """Recomputed metrics of each (model, month), with row count and time bounds. The month is the run's own where the
    rows carry it, else that of their time."""
    m = metric_columns()
    m["MEAN_PREDICTED"] = m.pop("MEAN_FORECAST")
    return (
        (df if "month" in df.columns else df.withColumn("month", S.year_month(F.col("time_utc"))))
        .groupBy("model", "month")
        .agg(
            F.count("*").alias("rows"),
            F.min("time_utc").alias("start_time"),
            F.max("time_utc").alias("end_time"),
            *[c.alias(n) for n, c in m.items()],
        )
        .withColumn("month_ts", F.to_timestamp("month", "yyyy-MM"))
    )


def metrics_by_model(df: DataFrame) -> DataFrame:
    m = metric_columns()
    return df.groupBy("model").agg(
        F.count("*").alias("rows"),
        F.min("time_utc").alias("start_time"),
        F.max("time_utc").alias("end_time"),
        *[m[n].alias(f"{n}_recomputed") for n in ("RMSE", "MAE", "MAPE", "BIAS")],
        m["MEAN_ACTUAL"].alias("MEAN_ACTUAL"),
        m["MEAN_FORECAST"].alias("MEAN_FORECAST"),
    )


def common_window(df: DataFrame) -> DataFrame:
    """Latest start and earliest end over the models: one row, or none if they do not overlap."""
    bounds = df.groupBy("model").agg(F.min("time_utc").alias("s"), F.max("time_utc").alias("e"))
    return bounds.agg(F.max("s").alias("common_start"), F.min("e").alias("common_end")).where(
        F.col("common_start") <= F.col("common_end")
    )


def on_common_window(df: DataFrame) -> DataFrame:
    window = common_window(df)
    start, end = window.select("common_start").scalar(), window.select("common_end").scalar()
    return df.where((F.col("time_utc") >= start) & (F.col("time_utc") <= end))


def metrics_on_overlap(df: DataFrame) -> DataFrame:
    m = metric_columns()
    return (
        on_common_window(df)
        .groupBy("model")
        .agg(
            F.count("*").alias("rows_in_common_window"),
            F.min("time_utc").alias("common_start_time"),
            F.max("time_utc").alias("common_end_time"),
            *[m[n].alias(f"{n}_overlap") for n in ("RMSE", "MAE", "MAPE", "BIAS")],
        )
    )


def first_days(df: DataFrame, days: int = 7) -> DataFrame:
    """Rows of the first days of the common window (end included), counted from its first row."""
    common = on_common_window(df)
    first = common.agg(F.min("time_utc")).scalar()
    return common.where(F.col("time_utc") <= first + F.expr(f"INTERVAL {int(days)} DAYS"))


def mae_by(df: DataFrame, key: Column, name: str) -> DataFrame:
    return df.groupBy("model", key.alias(name)).agg(F.avg("absolute_error").alias("mae"), F.count("*").alias("rows"))


def mape_by(df: DataFrame, *keys: Column) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(S.ape_percent(F.col(ACTUAL), F.col(PREDICTED))).alias("mape"))


def histogram(df: DataFrame, value: Column, bins: int = 60) -> DataFrame:
    """Equal-width histogram per model over the model's own range; the last bin is closed.

    A constant series gets the unit-wide range around its value.
    """
    valued = df.select("model", value.alias("__v"))
    span = valued.groupBy("model").agg(F.min("__v").alias("lo0"), F.max("__v").alias("hi0"))
    flat = F.col("lo0") == F.col("hi0")
    span = span.select(
        "model",
        F.when(flat, F.col("lo0") - 0.5).otherwise(F.col("lo0")).alias("lo"),
        F.when(flat, F.col("hi0") + 0.5).otherwise(F.col("hi0")).alias("hi"),
    )
    width = (F.col("hi") - F.col("lo")) / bins
    binned = (
        join_small(valued, span, ["model"])
        .withColumn("bin", F.least(F.lit(bins - 1), F.floor((F.col("__v") - F.col("lo")) / width)))
        .groupBy("model", "lo", "hi", "bin")
        .agg(F.count("*").alias("frequency"))
    )
    grid = span.withColumn("bin", F.explode(F.expr(f"sequence(0L, {bins - 1}L)")))
    return (
        grid.join(binned.select("model", "bin", "frequency"), ["model", "bin"], "left")
        .select(
            "model",
            "bin",
            (F.col("lo") + F.col("bin") * width).alias("bin_start"),
            F.coalesce("frequency", F.lit(0)).alias("frequency"),
        )
    )


def rank_in_month(summary: DataFrame, metric: str, month: str = "month") -> DataFrame:
    """Rank of each model in its month, lower is better, ties share the lower rank.

    The input is a summary with one row per (model, month).
    """
    w = Window.partitionBy(month).orderBy(F.col(metric))
    return summary.where(F.col(metric).isNotNull()).withColumn("rank", F.rank().over(w))


def metric_matrix(summary: DataFrame, months: Sequence[str], metric: str = "MAPE") -> DataFrame:
    """Models by months with the mean over the months present. Months are a fixed list."""
    wide = summary.groupBy("model").agg(
        *[F.avg(F.when(F.col("month") == m, F.col(metric))).alias(m) for m in months]
    )
    total = sum((F.coalesce(F.col(f"`{m}`"), F.lit(0.0)) for m in months), F.lit(0.0))
    held = sum((F.col(f"`{m}`").isNotNull().cast("int") for m in months), F.lit(0))
    return wide.withColumn("mean", F.try_divide(total, held))


def leaderboard(summary: DataFrame, month: str, metric: str = "MAPE") -> DataFrame:
    return summary.where(F.col("month") == month).orderBy(F.col(metric).asc_nulls_last(), "model")


def metrics_table(files: DataFrame) -> DataFrame:
    """First row of each metrics file; model and month come from the file name."""
    from tidewatt.sources.files import with_run_name

    named = with_run_name(files.drop("model", "month")).where("kind = 'metrics'")
    first = pick_one(named, ["file_name"], [F.col("row_no")])
    latest = pick_one(first, ["model", "month"], [F.col("file_name").desc()])
    return latest.withColumn("month_ts", F.to_timestamp("month", "yyyy-MM"))


def against_baseline(df: DataFrame, baseline: str = "load_pred_mw", predicted: str = "predicted_load_mw") -> DataFrame:
    """Metrics against the day-ahead baseline over rows that have both values; none at all is an error."""
    from tidewatt.operators.panel import require_columns

    require_columns(df, [baseline, predicted])
    both = df.dropna(subset=[baseline, predicted])
    require_rows(both, f"No rows have both {baseline} and {predicted}")
    return metrics(both, actual=baseline, predicted=predicted)


def require_rows(df: DataFrame, message: str) -> DataFrame:
    if df.isEmpty():
        raise ValueError(message)
    return df


def blend(a: DataFrame, b: DataFrame, weight: float = 0.5, keys: Sequence[str] = ("region", "time_utc")) -> DataFrame:
    """weight * a + (1 - weight) * b of two prediction frames."""
    other = b.select(*keys, F.col("predicted_load_mw").alias("__b"))
    return (
        a.join(other, list(keys))
        .withColumn("predicted_load_mw", F.col(PREDICTED) * weight + F.col("__b") * (1 - weight))
        .drop("__b")
    )


def join_scored(scored: DataFrame, panel: DataFrame) -> DataFrame:
    """Scored index rows with the time and load of their (region, index); rows lacking either value drop."""
    rows = panel.select("region", "time_idx", "time_utc", F.col("load_mw").alias("actual_load_mw"))
    return scored.join(rows, ["region", "time_idx"], "left").dropna(subset=["actual_load_mw", "predicted_load_mw"])
