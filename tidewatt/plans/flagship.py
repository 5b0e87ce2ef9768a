"""Whole jobs put together from the operators."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatt import constants as K
from tidewatt.functions import scalar as S
from tidewatt.functions.holidays import with_calendar_flags
from tidewatt.operators import evaluate as E
from tidewatt.operators import panel as P
from tidewatt.operators import weather as W
from tidewatt.plans import fixtures as X
from tidewatt.session import utc
from tidewatt.sources import files as SF

SCHEMA = {c: "double" for c in [*K.REVISED_COLUMNS, "load_pred_mw"]}
SCHEMA.update({"region": "string", "time_key": "string", "time_utc": "timestamp"})
SCHEMA.update({c: "int" for c in K.FEATURE_COLUMNS[:3]})


def with_schema(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return P.fill_schema(df, {c: SCHEMA[c] for c in columns})


# ---- panel --------------------------------------------------------------------------------


def build_panel(
    station_hours: DataFrame,
    weights: DataFrame,
    load_wide: DataFrame,
    start: date,
    end: date,
    regions: Sequence[str] = tuple(K.REGIONS),
    allow_missing: bool = False,
    stations_per_region: int = 5,
) -> DataFrame:
    """Hourly panel of the days [start, end]: weighted weather in Fahrenheit joined with load.

    Unknown region names are an error, as is a region without load unless
    `allow_missing`.
    """
    unknown = sorted(set(regions) - set(K.REGIONS))
    if unknown:
        raise ValueError(f"Unknown region(s): {unknown}")
    spine = P.hour_spine(weights.sparkSession, start, end).select(
        F.explode(F.array(*[F.lit(r) for r in regions])).alias("region"), "time_utc"
    )
    chosen = W.top_stations(P.keep_regions(weights, regions, check=False), stations_per_region)
    weather = W.region_weather(P.strict_range(station_hours, start, end), chosen, spine)
    load = W.load_long(P.strict_range(load_wide, start, end), regions)
    joined = W.join_weather_load(weather, load, allow_missing)
    return with_schema(with_keys(joined), K.PANEL_COLUMNS)


def with_keys(df: DataFrame) -> DataFrame:
    return W.with_degree_days(df).withColumn("time_key", S.time_key(F.col("time_utc")))


def revise(panel: DataFrame) -> DataFrame:
    """Calendar flags and the exact weekly lag on a merged panel."""
    return P.with_week_lag(with_calendar_flags(panel))


def daily_actuals(spark: SparkSession, raw_paths: str | Sequence[str], out: str) -> DataFrame:
    """Raw panel files to the merged, revised and usable panel, in one lazy plan, written to `out`."""
    merged = SF.merge_panels(SF.read_panel(utc(spark), raw_paths))
    SF.write_panel(P.usable_rows(revise(merged)), out)
    return spark.read.parquet(out)


def clean_panel_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """Hourly spine, panel values, weekly lag, usable rows, coverage per region."""
    panel = X.panel(utc(spark), folder).drop("ord")
    full = P.reindex(panel, P.region_spine(panel))
    return P.coverage_by_region(P.usable_rows(P.with_week_lag(full, panel)))


# ---- next day -----------------------------------------------------------------------------


def next_day_features(
    weather: DataFrame, day_ahead: DataFrame, history: DataFrame | None, day: date | None = None, check: bool = True
) -> DataFrame:
    """Features of one UTC day (tomorrow by default) in file order, with the day-ahead load where there is one.

    The lag comes from `history`; without it, it stays null. Each region must
    have exactly 24 hours, which `check` verifies.
    """
    hours = P.target_day(weather, day)
    load = day_ahead.groupBy("region", "time_utc").agg(F.avg("load_mw").alias("load_pred_mw"))
    joined = with_calendar_flags(with_keys(hours.join(load, P.KEY, "left")))
    lagged = P.without_history(joined) if history is None else P.with_week_lag(joined, history)
    if check:
        P.require_complete_day(hours, weather.select("region"))
    return with_schema(lagged, K.NEXT_DAY_COLUMNS)


# ---- comparison ---------------------------------------------------------------------------


def compare_monthly_runs(spark: SparkSession, folder: str, metric: str = "RMSE") -> dict[str, DataFrame]:
    """Reported and recomputed metrics of every (model, month) in a run directory, and the monthly ranks."""
    reported, predictions = SF.load_runs(utc(spark), folder)
    recomputed = E.metrics_by_month(E.clean_predictions(predictions))
    return {
        "summary": E.metrics_table(reported),
        "recomputed": recomputed,
        "ranks": E.rank_in_month(recomputed.select("model", "month", metric), metric),
    }


def compare_model_runs(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Models with one run each: reported metrics, recomputed ones, and those on the common window."""
    reported, predictions = SF.load_model_runs(utc(spark), folder)
    out = {} if reported is None else {"summary": reported}
    if predictions is not None:
        clean = E.clean_predictions(predictions)
        out.update(
            recomputed=E.metrics_by_model(clean),
            overlap=E.metrics_on_overlap(clean),
            first_week=E.first_days(clean),
            by_hour=E.mae_by(clean, F.hour("time_utc"), "hour"),
            by_day=E.mae_by(clean, F.to_date("time_utc"), "day"),
            error_histogram=E.histogram(clean, F.col("predicted_load_mw") - F.col("actual_load_mw")),
            absolute_error_histogram=E.histogram(clean, F.col("absolute_error")),
        )
    return out
