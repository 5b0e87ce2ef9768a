"""Station weights and weighted spatial means, and the weather-load join."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatt import constants as K
from tidewatt.functions import scalar as S
from tidewatt.operators.ordered import attach_group_stats, join_small, top_rows
from tidewatt.operators.panel import KEY


# ---- weights ------------------------------------------------------------------------------


def normalize_weights(stations: DataFrame, weight: str = "population_weight", keys: Sequence[str] = ("region",)) -> DataFrame:
    """Weights clipped at zero and divided by the group total; uniform where nothing is left."""
    clipped = stations.withColumn(weight, F.greatest(F.col(weight).cast("double"), F.lit(0.0)))
    summed = attach_group_stats(clipped, keys, __total=F.sum(weight), __stations=F.count("*"))
    return summed.withColumn(
        weight,
        F.when(F.col("__total") > 0, F.col(weight) / F.col("__total")).otherwise(F.lit(1.0) / F.col("__stations")),
    ).drop("__total", "__stations")


def normalize_weights_strict(
    stations: DataFrame, weight: str = "population_weight", keys: Sequence[str] = ("region",), check: bool = True
) -> DataFrame:
    """Weights divided by the group total, unclipped; a total that is not positive is an error."""
    summed = attach_group_stats(stations, keys, __total=F.sum(weight))
    if check:
        bad = summed.where(F.col("__total") <= 0).select(*keys).distinct().take(20)
        if bad:
            raise ValueError(f"Non-positive total weights for: {sorted(tuple(r) for r in bad)}")
    return summed.withColumn(weight, F.col(weight) / F.col("__total")).drop("__total")


def top_stations(stations: DataFrame, k: int = 5, weight: str = "population_weight") -> DataFrame:
    """The k heaviest stations of each region with their weights normalised again."""
    kept = top_rows(stations, k, ["region"], [F.col(weight).desc(), F.col("station_name")])
    return normalize_weights(kept, weight)


# ---- weighted means -----------------------------------------------------------------------


def _by(keys: Sequence[str], df: DataFrame, aggs) -> DataFrame:
    return df.groupBy(*keys).agg(*aggs)


def weighted_mean_strict(df: DataFrame, values: Sequence[str], weight: str, keys: Sequence[str] = KEY) -> DataFrame:
    """Sum of weight times value; one missing station makes the mean missing."""
    return _by(
        keys,
        df,
        [F.when(F.count(v) == F.count("*"), F.sum(F.col(weight) * F.col(v))).alias(v) for v in values],
    )


def weighted_mean_renormalized(
    df: DataFrame, values: Sequence[str], weight: str, keys: Sequence[str] = KEY
) -> DataFrame:
    """Weights rescaled to the stations that have a value; null when none has."""
    return _by(
        keys,
        df,
        [
            F.try_divide(
                F.sum(F.col(weight) * F.col(v)), F.sum(F.when(F.col(v).isNotNull(), F.col(weight)))
            ).alias(v)
            for v in values
        ],
    )


def weighted_mean_zero_fill(df: DataFrame, values: Sequence[str], weight: str, keys: Sequence[str] = KEY) -> DataFrame:
    """Sum of weight times value with missing values as zero, weights untouched."""
    return _by(keys, df, [F.sum(F.coalesce(F.col(weight) * F.col(v), F.lit(0.0))).alias(v) for v in values])


def region_weather(
    station_hours: DataFrame, weights: DataFrame, spine: DataFrame | None = None, celsius: bool = True
) -> DataFrame:
    """Population-weighted hourly weather per region, temperatures in Fahrenheit."""
    shares = weights.select("region", "station_name", "population_weight")
    joined = join_small(station_hours, shares, ["region", "station_name"])
    out = weighted_mean_strict(joined, K.WEATHER_VARS, "population_weight")
    if celsius:
        for name in ("temperature_2m", "apparent_temperature"):
            out = out.withColumn(name, S.c_to_f(F.col(name)))
    return out if spine is None else spine.join(out, KEY, "left")


def with_degree_days(df: DataFrame, base: float = 65.0) -> DataFrame:
    t = F.col("temperature_2m")
    return df.withColumn("cdd_65f", S.cooling_degrees(t, base)).withColumn("hdd_65f", S.heating_degrees(t, base))


def join_weather_load(weather: DataFrame, load: DataFrame, allow_missing: bool = False) -> DataFrame:
    """Weather rows with their load. A region without any load is an error unless allowed."""
    if not allow_missing:
        lacking = weather.select("region").distinct().join(load.select("region").distinct(), "region", "left_anti").take(20)
        if lacking:
            raise ValueError(f"No load for region(s): {sorted(r['region'] for r in lacking)}")
    return weather.join(load.select("region", "time_utc", "load_mw"), KEY, "left")


def load_long(wide: DataFrame, regions: Sequence[str] = tuple(K.REGIONS), name: str = "load_mw") -> DataFrame:
    """time_utc x region columns to (region, time_utc, load)."""
    present = [r for r in regions if r in wide.columns]
    if not present:
        return wide.where("false").select(
            F.lit(None).cast("string").alias("region"), "time_utc", F.lit(None).cast("double").alias(name)
        )
    return wide.unpivot(["time_utc"], present, "region", name).select("region", "time_utc", name)


def common_times(series: DataFrame, names: Sequence[str], time: str = "time_utc") -> DataFrame:
    """Times at which every one of the named value columns has some value."""
    per_time = series.groupBy(time).agg(*[F.count(c).alias(c) for c in names])
    for c in names:
        per_time = per_time.where(F.col(c) > 0)
    return per_time.select(time)


def intersect_times(*series: DataFrame, time: str = "time_utc") -> DataFrame:
    """Times present in each of several series."""
    out = series[0].select(time)
    for other in series[1:]:
        out = out.intersect(other.select(time))
    return out.distinct() if len(series) == 1 else out


def wide_features(
    df: DataFrame, index: Sequence[str], entity: str, entities: Sequence, values: Sequence[str], pattern: str = "{value}__{entity}"
) -> DataFrame:
    """One column per (value, entity), e.g. `temperature__fresno`. Entities are a fixed list."""
    return df.groupBy(*index).agg(
        *[
            F.max(F.when(F.col(entity) == e, F.col(v))).alias(pattern.format(value=v, entity=e))
            for v in values
            for e in entities
        ]
    )
