"""Monthly backtests over a model set, and next-day scoring."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from tidewatt.functions import scalar as S
from tidewatt.models import linear, trees
from tidewatt.models.additive import fit_additive_split
from tidewatt.models.features import month_data, with_calendar
from tidewatt.models.seasonal import fit_seasonal_by_region
from tidewatt.models.sweep import SETTINGS, sweep
from tidewatt.operators import evaluate as E
from tidewatt.operators import panel as P
from tidewatt.sources.files import write_run, write_runs
from tidewatt.session import NO_TABLE

Model = Callable[[DataFrame, DataFrame], DataFrame]


def _plain(fit) -> Callable[..., Model]:
    def build(**kw) -> Model:
        return lambda train, valid: fit(train, **kw)(valid)

    return build


def _additive(**kw) -> Model:
    def run(train: DataFrame, valid: DataFrame) -> DataFrame:
        model, lagged = fit_additive_split(train, valid, **kw)
        return model.predict(lagged)

    return run


def _blended(weight: float = 0.5, shallow: dict | None = None, deep: dict | None = None) -> Model:
    def run(train: DataFrame, valid: DataFrame) -> DataFrame:
        a = trees.fit_boosted_shallow(train, **(shallow or {}))(valid)
        b = trees.fit_boosted(train, **(deep or {}))(valid)
        return E.blend(a, b, weight)

    return run


MODELS: dict[str, Callable[..., Model]] = {
    "linear": _plain(linear.fit_linear),
    "ridge": _plain(linear.fit_ridge),
    "hinge_regression": _plain(linear.fit_eps_insensitive),
    "boosted": _plain(trees.fit_boosted),
    "boosted_shallow": _plain(trees.fit_boosted_shallow),
    "random_forest": _plain(trees.fit_forest),
    "boosted_blend": _blended,
    "additive": _additive,
    "seasonal": _plain(fit_seasonal_by_region),
}


def build_model(name: str, **kw) -> Model:
    if name not in MODELS:
        raise ValueError(f"Unsupported model {name!r}: expected one of {sorted(MODELS)}")
    return MODELS[name](**kw)


def modelled(panel: DataFrame, regions: Sequence[str] | None) -> DataFrame:
    """The panel's rows of the modelled regions; None means all. Regions with loads near zero spoil relative errors, so
    the usual choice is MODEL_REGIONS; a name that the panel lacks is an error."""
    return panel if regions is None else P.keep_regions(panel, regions)


def run_month(revised: DataFrame, name: str, month: str, regions: Sequence[str] | None = None, **kw) -> tuple[DataFrame, DataFrame]:
    """(predictions with error columns, one metrics row) of one model and month."""
    data = month_data(modelled(revised, regions), month)
    scored = build_model(name, **kw)(data.train, data.valid)
    predictions = E.predictions_frame(
        scored.select(
            "region",
            S.time_key(F.col("time_utc")).alias("time_key"),
            "time_utc",
            F.col("load_mw").alias("actual_load_mw"),
            "predicted_load_mw",
        )
    )
    start, following, end = P.month_bounds(month)
    measured = predictions.agg(
        F.count("*").alias("validation_rows_scored"), *[c.alias(n) for n, c in E.metric_columns().items()]
    )
    rows = measured.select(
        F.lit(name).alias("model"),
        F.lit(month).alias("predict_month"),
        F.lit(data.train.count()).alias("train_rows_used"),
        "validation_rows_scored",
        P.utc_lit(end).alias("training_end_time"),
        P.utc_lit(start).alias("validation_start_time"),
        P.utc_lit(following - P.timedelta(seconds=1)).alias("validation_end_time"),
        "RMSE",
        "MAE",
        "MAPE",
        "BIAS",
        "MEAN_ACTUAL",
        "MEAN_FORECAST",
        "MSE",
    )
    return predictions, rows


def finished_runs(spark: SparkSession, folder: str) -> set[tuple[str, str]]:
    """(model, month) pairs already in the results table."""
    try:
        done = spark.read.parquet(f"{folder}/metrics")
    except AnalysisException as error:
        if error.getCondition() not in NO_TABLE:
            raise
        return set()
    return {(r["model"], str(r["month"])) for r in done.select("model", "month").distinct().collect()}


def sweep_runs(
    revised: DataFrame, models: dict[str, dict], months: Sequence[str], folder: str, done: set[tuple[str, str]] = frozenset()
) -> list[tuple[str, str, str]]:
    """Every pair but those `done`, fitted in one pass: predictions written once, metrics taken from what was written."""
    predictions, trained, failures = sweep(revised, models, months, done)
    pairs = {(r["model"], r["month"]) for r in trained.collect()}
    if pairs:
        write_runs(predictions, folder, "predictions")
        written = revised.sparkSession.read.schema(predictions.schema).parquet(f"{folder}/predictions").join(F.broadcast(trained), ["model", "month"])
        start = F.to_timestamp(F.concat("month", F.lit("-01")))
        second = F.expr("INTERVAL 1 SECOND")
        measured = written.groupBy("model", "month", "train_rows_used").agg(F.count("*").alias("validation_rows_scored"), *[c.alias(n) for n, c in E.metric_columns().items()])
        rows = measured.select(
            F.col("month").alias("predict_month"),
            "train_rows_used",
            "validation_rows_scored",
            (start - second).alias("training_end_time"),
            start.alias("validation_start_time"),
            (start + F.expr("INTERVAL 1 MONTH") - second).alias("validation_end_time"),
            *["RMSE", "MAE", "MAPE", "BIAS", "MEAN_ACTUAL", "MEAN_FORECAST", "MSE"],
            "model",
            "month",
        )
        write_runs(rows, folder, "metrics")
    return failures


def backtest(
    revised: DataFrame, models: dict[str, dict], months: Sequence[str], folder: str, regions: Sequence[str] | None = None
) -> tuple[DataFrame, list[tuple[str, str, str]]]:
    """Every model on every month, expanding window; finished pairs are skipped.

    Linear, ridge, additive and seasonal models are swept over all months in
    one pass; the others are fitted month by month, so pass a written table.
    Results go to `folder`, partitioned by (model, month), so that a lost driver
    resumes where it stopped. A failed pair is reported, whatever its error,
    and the rest go on. Returns the metrics table and the failures.
    """
    spark = revised.sparkSession
    revised = modelled(revised, regions)
    done = finished_runs(spark, folder)
    swept = {name: params for name, params in models.items() if name in SETTINGS and set(params) <= set(SETTINGS[name])}
    failures = []
    if any((name, month) not in done for name in swept for month in months):
        try:
            failures += sweep_runs(revised, swept, months, folder, done)
        except Exception as error:  # as below: one failure must not end the others
            failures += [(name, month, str(error)) for name in swept for month in months if (name, month) not in done]
    for month in months:
        for name, params in models.items():
            if name in swept or (name, month) in done:
                continue
            try:
                predictions, metrics = run_month(revised, name, month, **params)
                write_run(predictions, metrics, folder, name, month)
            except Exception as error:
                failures.append((name, month, str(error)))
    if len(failures) == len(models) * len(months):
        raise ValueError(f"Every run failed: {failures[:3]}")
    return spark.read.parquet(f"{folder}/metrics"), failures


def score_next_day(history: DataFrame, next_day: DataFrame, name: str = "ridge", regions: Sequence[str] | None = None, **kw) -> DataFrame:
    """Train on all usable history and score the next day's rows; features they lack count as zero."""
    train = P.usable_rows(with_calendar(modelled(history, regions)))
    ahead = P.usable_next_day(with_calendar(modelled(next_day, regions)))
    E.require_rows(train, "No historical rows remain after dropping nulls.")
    E.require_rows(ahead, "No next-day rows remain after dropping nulls.")
    scored = build_model(name, **kw)(train, ahead)
    keep = ["region", "time_key", "time_utc", "load_pred_mw", "predicted_load_mw"]
    return scored.select(*[c for c in keep if c in scored.columns])


def next_day_sequences(history: DataFrame, next_day: DataFrame, features: Sequence[str], lookback: int = 24) -> DataFrame:
    """Lookback sequences of the next day's rows, led by the last `lookback` rows of each region."""
    from tidewatt.operators.ordered import lookback_sequences, require_sequences, tail_rows

    tail = tail_rows(history, lookback).withColumn("__next", F.lit(0))
    ahead = next_day.withColumn("__next", F.lit(1))
    both = P.union_parts(tail, ahead).na.fill(0.0, list(features))
    built = require_sequences(lookback_sequences(both, features, lookback))
    return built.where("__next = 1").drop("__next")
