"""Long area-load feeds (actual and day-ahead) to (time_utc, region, load)."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from tidewatt import constants as K
from tidewatt.functions import scalar as S
from tidewatt.operators.reconcile import pivot_last, with_total


def snake_columns(df: DataFrame) -> DataFrame:
    """Column names trimmed, lower-cased and underscored."""
    clean = lambda c: re.sub("_+", "_", re.sub(r"[\s\-/]+", "_", c.strip().lower())).strip("_")
    return df.toDF(*[clean(c) for c in df.columns])


def pick_value_column(df: DataFrame) -> str:
    for name in K.AREA_VALUE_COLUMNS:
        if name in df.columns:
            return name
    numeric = [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, NumericType) and f.name not in K.AREA_NON_VALUE_COLUMNS
    ]
    if len(numeric) == 1:
        return numeric[0]
    raise ValueError(f"Could not identify the load value column among {df.columns}")


def pick_area_column(df: DataFrame) -> str:
    for name in ["tac_area_name", *K.AREA_COLUMNS]:
        if name in df.columns:
            return name
    raise ValueError(f"No area column among {df.columns}")


#: A time text that says its own offset.
OFFSET = "(Z|[+-][0-9]{2}:?[0-9]{2})\\s*$"


def with_interval_start(df: DataFrame, area: str) -> DataFrame:
    """Adds `__start`, the UTC start of the interval, from the UTC column or else the market-local one.

    A local text with an offset is converted once. Of a local hour that the clock repeats in autumn, the second row of
    an area in feed order is the second hour; those few rows alone are numbered.
    """
    if "interval_start_utc" in df.columns:
        return df.withColumn("__start", F.col("interval_start_utc").try_cast("timestamp"))
    if "interval_start_local" not in df.columns:
        raise ValueError(f"No interval start column among {df.columns}")
    text = F.col("interval_start_local").cast("string")
    wall = F.col("interval_start_local").try_cast("timestamp")
    first = S.market_to_utc(wall)
    later = first + F.expr("interval 1 hour")
    told = text.rlike(OFFSET)
    known = df.withColumns({"__start": F.when(told, wall).otherwise(first), "__order": F.monotonically_increasing_id()})
    known = known.withColumn("__twice", F.coalesce(~told & (F.from_utc_timestamp(later, K.MARKET_TZ) == wall), F.lit(False)))
    in_feed = Window.partitionBy(area, "interval_start_local").orderBy("__order")
    repeated = known.where("__twice").withColumn("__nth", F.row_number().over(in_feed))
    second = repeated.withColumn("__start", F.when(F.col("__nth") > 1, F.col("__start") + F.expr("interval 1 hour")).otherwise(F.col("__start")))
    return known.where("not __twice").unionByName(second.drop("__nth")).drop("__order", "__twice")


def standardize_area_long(raw: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Usable rows as (time_utc, region, load_mw): bad times, areas and numbers drop."""
    df = snake_columns(raw)
    value, area = pick_value_column(df), pick_area_column(df)
    number = F.col(value) if isinstance(df.schema[value].dataType, NumericType) else S.coerce_numeric(F.col(value))
    return with_interval_start(df, area).select(
        F.col("__start").alias("time_utc"),
        S.area_to_region(F.col(area)).alias("region"),
        number.cast("double").alias("load_mw"),
        *keep,
    ).dropna(subset=["time_utc", "region", "load_mw"])


def standardize_day_ahead(raw: DataFrame) -> DataFrame:
    """Day-ahead rows of the known areas; a bad number stays as null, a bad time drops."""
    start = next((c for c in K.DAY_AHEAD_START_COLUMNS if c in raw.columns), None)
    if start is None:
        raise ValueError(f"No interval start column among {raw.columns}")
    missing = {"TAC_AREA_NAME", "MW"} - set(raw.columns)
    if missing:
        raise ValueError(f"Missing required columns: {sorted(missing)}")
    return (
        raw.where(F.col("TAC_AREA_NAME").isin(list(K.DAY_AHEAD_AREAS)))
        .select(
            F.col(start).try_cast("timestamp").alias("time_utc"),
            S.lookup(K.DAY_AHEAD_AREAS, F.col("TAC_AREA_NAME")).alias("region"),
            F.col("MW").try_cast("double").alias("load_mw"),
        )
        .dropna(subset=["time_utc"])
    )


def area_feed_to_wide(raw: DataFrame, order: str) -> DataFrame:
    """A long feed as one column an area and the total: the feed's own where it reports one, else the areas' sum.

    `order` names the feed's column that says which of two rows of an hour is the later.
    """
    long = standardize_area_long(raw, keep=(order,))
    wide = pivot_last(long, "load_mw", order, [*K.AREA_REGIONS, K.TOTAL_REGION])
    return with_total(wide)
