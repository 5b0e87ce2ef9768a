"""Why a weekly lag is missing: classification, cross-tabs, distances."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatt import constants as K
from tidewatt.functions import scalar as S
from tidewatt.operators.ordered import attach_group_stats, top_rows
from tidewatt.operators.panel import KEY, drop_region, week

# Reasons, most specific last.
BEFORE = "before_region_start"
AFTER = "after_region_end"
OTHER_REGIONS = "prev_week_time_exists_in_other_regions_only"
DST = "dst_or_calendar_alignment_issue"
UNKNOWN = "unknown_no_match_within_region"
UNEXPECTED = "unexpected_no_match"
REASONS = [BEFORE, AFTER, OTHER_REGIONS, DST, UNKNOWN]


def with_region_bounds(panel: DataFrame) -> DataFrame:
    return attach_group_stats(
        panel, ["region"], region_start=F.min("time_utc"), region_end=F.max("time_utc")
    )


def missing_lag(panel: DataFrame, skip_region: str | None = K.NO_LOAD_REGION) -> DataFrame:
    """Rows whose region has no row exactly 7 days earlier (anti-join on the key)."""
    rows = panel if skip_region is None else drop_region(panel, skip_region)
    later = rows.select("region", (F.col("time_utc") + week()).alias("time_utc"))
    bounded = with_region_bounds(rows).withColumn("previous_week_time", F.col("time_utc") - week())
    return bounded.join(later, KEY, "left_anti")


def with_any_region(missing: DataFrame, panel: DataFrame) -> DataFrame:
    """Marks rows whose previous-week hour exists in some region."""
    hours = panel.select(F.col("time_utc").alias("previous_week_time")).distinct().withColumn("__seen", F.lit(1))
    return (
        missing.join(hours, "previous_week_time", "left")
        .withColumn("prev_week_exists_any_region", F.coalesce("__seen", F.lit(0)).cast("int"))
        .drop("__seen")
    )


def classify(missing: DataFrame) -> DataFrame:
    prev = F.col("previous_week_time")
    return missing.withColumn(
        "missing_reason",
        F.when(prev < F.col("region_start"), BEFORE)
        .when(prev > F.col("region_end"), AFTER)
        .when(F.col("prev_week_exists_any_region") == 1, OTHER_REGIONS)
        .when(F.month("time_utc").isin(3, 11), DST)
        .otherwise(UNKNOWN),
    )


def classify_exact(missing: DataFrame) -> DataFrame:
    prev = F.col("previous_week_time")
    return missing.withColumn(
        "missing_reason",
        F.when(prev < F.col("region_start"), BEFORE).when(prev > F.col("region_end"), AFTER).otherwise(UNEXPECTED),
    )


def missing_with_reason(panel: DataFrame, skip_region: str | None = K.NO_LOAD_REGION) -> DataFrame:
    rows = panel if skip_region is None else drop_region(panel, skip_region)
    return classify(with_any_region(missing_lag(rows, None), rows))


def cross_tab(missing: DataFrame, key: Column, name: str, domain: Sequence[str] | None = None) -> DataFrame:
    """Counts of each reason per key value, zero where none; `domain` fixes the rows."""
    counts = missing.groupBy(key.alias(name)).agg(
        *[F.count_if(F.col("missing_reason") == r).alias(r) for r in REASONS]
    )
    if domain is None:
        return counts
    fixed = missing.sparkSession.createDataFrame([(v,) for v in domain], f"{name} string")
    return fixed.join(counts, name, "left").na.fill(0, REASONS)


def value_counts(missing: DataFrame, key: Column, name: str, domain: Sequence[str] | None = None) -> DataFrame:
    counts = missing.groupBy(key.alias(name)).agg(F.count("*").alias("missing_rows"))
    if domain is None:
        return counts
    fixed = missing.sparkSession.createDataFrame([(v,) for v in domain], f"{name} string")
    return fixed.join(counts, name, "left").na.fill(0, ["missing_rows"])


def with_lag_presence(panel: DataFrame) -> DataFrame:
    """Rows with a flag whether a non-null load exists exactly 7 days earlier."""
    earlier = panel.select(
        "region", (F.col("time_utc") + week()).alias("time_utc"), F.col("load_mw").alias("__prev")
    )
    return panel.join(earlier, KEY, "left").withColumn("has_previous_week", F.col("__prev").isNotNull()).drop("__prev")


def missing_rate(flagged: DataFrame, keys: Sequence[str]) -> DataFrame:
    missing = F.count_if(~F.col("has_previous_week"))
    return flagged.groupBy(*keys).agg(
        F.count("*").alias("total_rows"),
        missing.alias("missing_rows"),
        (F.lit(100.0) * missing / F.count("*")).alias("pct_missing"),
    )


def start_distance(flagged: DataFrame) -> DataFrame:
    """Hours and days from the region's first hour, for rows without a previous week."""
    hours = S.hours_between(F.col("time_utc"), F.col("region_start"))
    return (
        attach_group_stats(flagged, ["region"], region_start=F.min("time_utc"))
        .where(~F.col("has_previous_week"))
        .withColumn("hours_from_start", hours)
        .withColumn("days_from_start", hours / 24.0)
    )


def describe(df: DataFrame, column: str, probabilities: Sequence[float] = (0.25, 0.5, 0.75, 0.9, 0.95, 0.99)) -> DataFrame:
    """count, mean, std, min, exact linear percentiles, max of an hour-grained column.

    `percentile` keeps one counter per distinct value, here at most one per
    hour of the calendar; for unbounded values use `quantiles.exact_quantiles`.
    """
    q = F.percentile(column, F.array(*[F.lit(float(p)) for p in probabilities]))
    packed = df.agg(
        F.count(column).alias("count"),
        F.avg(column).alias("mean"),
        F.stddev_samp(column).alias("std"),
        F.min(column).alias("min"),
        q.alias("__q"),
        F.max(column).alias("max"),
    )
    names = [f"p{round(p * 100)}" for p in probabilities]
    return packed.select(
        "count", "mean", "std", "min", *[F.col("__q")[i].alias(n) for i, n in enumerate(names)], "max"
    )


def distance_buckets(distances: DataFrame) -> DataFrame:
    h = F.col("hours_from_start")
    share = F.try_divide(F.lit(100.0) * F.count_if(h < 168), F.count("*"))
    return distances.agg(
        F.count_if(h < 24).alias("within_first_24h"),
        F.count_if(h < 168).alias("within_first_7d"),
        F.count_if(h < 192).alias("within_first_8d"),
        F.count_if(h >= 168).alias("after_first_7d"),
        share.alias("pct_first_week"),
        F.when(share > 95, "expected_start_of_history").otherwise("gaps_likely").alias("verdict"),
    )


def time_range(panel: DataFrame) -> DataFrame:
    return panel.groupBy("region").agg(
        F.min("time_utc").alias("earliest_time"), F.max("time_utc").alias("latest_time"), F.count("*").alias("total_rows")
    )


def offset_distribution(rows: DataFrame, local: Column, utc: Column) -> DataFrame:
    """How many rows carry each offset between a local key and UTC; null where either is unreadable."""
    return rows.groupBy(S.hours_between(local, utc).alias("utc_offset_hours")).agg(F.count("*").alias("rows"))


def samples(missing: DataFrame, n: int = 20, order: Sequence[str] = ("region", "time_utc")) -> DataFrame:
    """First n rows of each reason."""
    return top_rows(missing, n, ["missing_reason"], [F.col(c) for c in order], rank="sample_no")
