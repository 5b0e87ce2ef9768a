"""The hourly panel: spine, de-duplication, filters, lags and quality audits."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatt import constants as K
from tidewatt.functions import scalar as S
from tidewatt.operators.ordered import (
    attach_group_stats,
    day_chunk,
    month_chunk,
    pick_one,
    with_running_counts,
)

KEY = ["region", "time_utc"]


def week() -> Column:
    return F.expr("INTERVAL 7 DAYS")


# ---- schema -------------------------------------------------------------------------------


def require_columns(df: DataFrame, needed: Sequence[str]) -> DataFrame:
    missing = sorted(set(needed) - set(df.columns))
    if missing:
        raise ValueError(f"Missing required columns: {missing}")
    return df


def preferred_order(df: DataFrame, first: Sequence[str]) -> DataFrame:
    """Named columns first, in that order and where present, then the rest."""
    head = [c for c in first if c in df.columns]
    return df.select(*head, *[c for c in df.columns if c not in head])


def fill_schema(df: DataFrame, schema: dict[str, str]) -> DataFrame:
    """Exactly the columns of `schema` (name to type); absent ones are null."""
    return df.select(
        *[
            F.col(name) if name in df.columns else F.lit(None).cast(kind).alias(name)
            for name, kind in schema.items()
        ]
    )


def align_features(df: DataFrame, features: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Model columns in training order; those absent at scoring time are zero."""
    return df.select(
        *keep, *[F.col(c) if c in df.columns else F.lit(0.0).alias(c) for c in features]
    )


def feature_columns(df: DataFrame) -> list[str]:
    """Columns that may enter a model: everything but target and time."""
    return [c for c in df.columns if c not in {"load_mw", "load_pred_mw", "time_utc", "time_key"}]


# ---- spine and filters --------------------------------------------------------------------


def day_start(day: date) -> datetime:
    return datetime(day.year, day.month, day.day)


def utc_lit(moment: datetime) -> Column:
    return F.lit(moment.replace(tzinfo=timezone.utc)) if moment.tzinfo is None else F.lit(moment)


def hour_spine(spark: SparkSession, start: date, end: date) -> DataFrame:
    """Every hour of the days [start, end], both inclusive: 24 rows a day.

    Days come from a distributed range, hours from a per-day sequence, so a
    long spine never sits in one row.
    """
    days = (end - start).days + 1
    first = int(day_start(start).replace(tzinfo=timezone.utc).timestamp())
    return (
        spark.range(max(days, 0))
        .select(F.explode(F.sequence(F.lit(0), F.lit(23))).alias("h"), "id")
        .select(F.timestamp_seconds(F.lit(first) + F.col("id") * 86400 + F.col("h") * 3600).alias("time_utc"))
    )


def region_spine(panel: DataFrame, keys: Sequence[str] = ("region",)) -> DataFrame:
    """Every hour of every day between the panel's first and last day, per region."""
    # The bounds come from the same per-region aggregate, so the panel is read once.
    spans = panel.groupBy(*keys).agg(F.min("time_utc").alias("__lo"), F.max("time_utc").alias("__hi"))
    first = spans.agg(F.date_trunc("day", F.min("__lo"))).scalar()
    last = spans.agg(F.date_trunc("day", F.max("__hi"))).scalar()
    days = spans.select(*keys, F.explode(F.sequence(first, last, F.expr("interval 1 day"))).alias("__day"))
    return days.select(
        *keys,
        F.explode(F.expr("sequence(__day, __day + interval 23 hours, interval 1 hour)")).alias("time_utc"),
    )


def reindex(panel: DataFrame, spine: DataFrame, on: Sequence[str] = KEY) -> DataFrame:
    """The spine's rows with the panel's values; hours the panel lacks are null."""
    return spine.join(panel, list(on), "left")


def keep_regions(panel: DataFrame, regions: Sequence[str], check: bool = True) -> DataFrame:
    """Rows of the named regions; a name the panel does not hold is an error."""
    kept = panel.where(F.col("region").isin(list(regions)))
    if check:
        found = {r["region"] for r in kept.select("region").distinct().collect()}
        unknown = sorted(set(regions) - found)
        if unknown:
            raise ValueError(f"Unknown region(s): {unknown}")
    return kept


def drop_region(panel: DataFrame, region: str = K.NO_LOAD_REGION) -> DataFrame:
    return panel.where(F.col("region") != region)


def month_bounds(month: str) -> tuple[datetime, datetime, datetime]:
    """(month start, next month start, last second before the month) of `YYYY-MM`."""
    parts = month.split("-")
    if len(parts) != 2 or not all(p.isdigit() for p in parts) or not 1 <= int(parts[1]) <= 12:
        raise ValueError(f"Invalid month {month!r}: expected YYYY-MM")
    year, number = int(parts[0]), int(parts[1])
    start = datetime(year, number, 1)
    following = datetime(year + number // 12, number % 12 + 1, 1)
    return start, following, start - timedelta(seconds=1)


def month_split(panel: DataFrame, month: str) -> tuple[DataFrame, DataFrame]:
    """Training rows before the month, validation rows inside it."""
    start, following, _ = month_bounds(month)
    t = F.col("time_utc")
    return (
        panel.where(t < utc_lit(start)),
        panel.where((t >= utc_lit(start)) & (t < utc_lit(following))),
    )


def cutoff_split(panel: DataFrame, cutoff: datetime) -> tuple[DataFrame, DataFrame]:
    t = F.col("time_utc")
    return panel.where(t <= utc_lit(cutoff)), panel.where(t > utc_lit(cutoff))


def usable_rows(panel: DataFrame) -> DataFrame:
    return panel.dropna(subset=["load_mw", "load_previous_week"])


def usable_rows_report(panel: DataFrame) -> DataFrame:
    target, lag = F.col("load_mw").isNull(), F.col("load_previous_week").isNull()
    return panel.agg(
        F.count("*").alias("rows_before"),
        F.count_if(target).alias("missing_load"),
        F.count_if(lag).alias("missing_previous_week"),
        F.count_if(target | lag).alias("rows_dropped"),
        F.count_if(~target & ~lag).alias("rows_after"),
    )


def usable_next_day(frame: DataFrame) -> DataFrame:
    """Next-day rows have no target yet: only a missing lag, where the column exists, drops a row."""
    return frame.dropna(subset=["load_previous_week"]) if "load_previous_week" in frame.columns else frame


def buffered_range(panel: DataFrame, start: date, end: date, hours: int = 48) -> DataFrame:
    """Rows within `hours` of the days [start, end]: what must be read before merging sources."""
    lo = day_start(start) - timedelta(hours=hours)
    hi = day_start(end) + timedelta(hours=23 + hours)
    return panel.where((F.col("time_utc") >= utc_lit(lo)) & (F.col("time_utc") <= utc_lit(hi)))


def strict_range(panel: DataFrame, start: date, end: date) -> DataFrame:
    lo, hi = day_start(start), day_start(end) + timedelta(hours=23)
    return panel.where((F.col("time_utc") >= utc_lit(lo)) & (F.col("time_utc") <= utc_lit(hi)))


def target_day(frame: DataFrame, day: date | None = None) -> DataFrame:
    """Rows of one UTC day; tomorrow when no day is named."""
    if day is None:
        first = F.date_add(F.current_date(), 1)
        return frame.where(
            (F.col("time_utc") >= first.cast("timestamp"))
            & (F.col("time_utc") < F.date_add(first, 1).cast("timestamp"))
        )
    lo = day_start(day)
    return frame.where(
        (F.col("time_utc") >= utc_lit(lo)) & (F.col("time_utc") < utc_lit(lo + timedelta(days=1)))
    )


# ---- de-duplication and unions ------------------------------------------------------------


def union_parts(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def keep_last(df: DataFrame, order: Sequence[str], keys: Sequence[str] = KEY) -> DataFrame:
    """The last row of each key in `order` (file order, then row order).

    The rank limit is applied before the shuffle too, so a key with very many
    copies sends one row per map task.
    """
    return pick_one(df, keys, [F.col(c).desc() for c in order])


def keep_first(df: DataFrame, order: Sequence[str], keys: Sequence[str] = KEY) -> DataFrame:
    return pick_one(df, keys, [F.col(c).asc() for c in order])


def dedup_report(df: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    per_key = df.groupBy(*keys).agg(F.count("*").alias("n"))
    return per_key.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows_before"),
        F.count("*").alias("rows_after"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("rows_removed"),
    )


# ---- exact weekly lag ---------------------------------------------------------------------


def shifted_week(history: DataFrame, value: str = "load_mw", name: str = "load_previous_week") -> DataFrame:
    return history.select("region", (F.col("time_utc") + week()).alias("time_utc"), F.col(value).alias(name))


def with_week_lag(panel: DataFrame, history: DataFrame | None = None, name: str = "load_previous_week") -> DataFrame:
    """The load exactly 7 days earlier by clock time, from the panel itself or from `history`.

    An equi-join on (region, time): it spreads over all keys, so it does not
    depend on the number of regions. Duplicate history keys fan out.
    """
    source = panel if history is None else history
    base = panel.drop(name)
    return base.join(shifted_week(source, name=name), KEY, "left")


def without_history(panel: DataFrame, name: str = "load_previous_week") -> DataFrame:
    return panel.withColumn(name, F.lit(None).cast("double"))


def lag_check_rows(panel: DataFrame) -> DataFrame:
    """Each row with the lag its history says it should have, and the verdict.

    A stored null where history has a value counts as wrong.
    """
    expected = shifted_week(panel, name="expected_load_previous_week")
    return panel.join(expected, KEY, "left").withColumn(
        "lag_ok",
        F.when(
            F.col("expected_load_previous_week").isNotNull(),
            F.coalesce(F.col("load_previous_week") == F.col("expected_load_previous_week"), F.lit(False)),
        ),
    )


def lag_validate(panel: DataFrame) -> DataFrame:
    return lag_check_rows(panel).agg(
        F.count("*").alias("total_rows"),
        F.count("lag_ok").alias("rows_with_history"),
        F.count_if("lag_ok").alias("correct_rows"),
        F.count_if(~F.col("lag_ok")).alias("incorrect_rows"),
    )


def lag_bad_rows(panel: DataFrame) -> DataFrame:
    return lag_check_rows(panel).where(~F.col("lag_ok")).drop("lag_ok")


# ---- audits -------------------------------------------------------------------------------


def coverage_by_region(panel: DataFrame) -> DataFrame:
    return panel.groupBy("region").agg(
        F.min("time_utc").alias("first_time_utc"),
        F.max("time_utc").alias("last_time_utc"),
        F.count("*").alias("rows"),
        F.count_if(F.col("load_mw").isNull()).alias("missing_load_rows"),
    )


def missing_by_region(panel: DataFrame) -> DataFrame:
    missing = F.count_if(F.col("load_mw").isNull())
    return panel.groupBy("region").agg(
        F.count("*").alias("rows"),
        missing.alias("missing_load_rows"),
        (missing / F.count("*")).alias("missing_load_fraction"),
    )


def present_hours(panel: DataFrame) -> DataFrame:
    return panel.groupBy("region").agg(F.count("load_mw").alias("present_hours"))


def panel_overall(panel: DataFrame) -> DataFrame:
    return panel.agg(
        F.count("*").alias("rows"),
        F.concat_ws(",", F.array_sort(F.collect_set("region"))).alias("regions"),
        F.min("time_utc").alias("first_time_utc"),
        F.max("time_utc").alias("last_time_utc"),
    )


def column_missing(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Null count per column, in one pass over the data."""
    wide = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return wide.unpivot([], list(columns), "column_name", "missing_rows")


def time_key_mismatches(panel: DataFrame) -> DataFrame:
    parsed = S.parse_time_key(F.col("time_key"))
    return panel.where(F.coalesce(parsed != F.col("time_utc"), F.lit(True)))


def degree_day_check(panel: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """Rows whose degree days do not follow from the temperature; a null counts as bad."""

    def bad(stored: str, expected: Column) -> Column:
        return ~F.coalesce(F.abs(F.col(stored) - expected) < tolerance, F.lit(False))

    t = F.col("temperature_2m")
    return panel.agg(
        F.count_if(bad("cdd_65f", S.cooling_degrees(t))).alias("cdd_bad_rows"),
        F.count_if(bad("hdd_65f", S.heating_degrees(t))).alias("hdd_bad_rows"),
    )


def _chunk_gaps(panel: DataFrame) -> DataFrame:
    """Per (region, day): bounds, counts and the gaps inside the day.

    Copies of an hour are counted before anything is ordered, so an hour with
    very many copies reaches its window as one row.
    """
    hours = panel.groupBy("region", "time_utc").agg(F.count("*").alias("__n"), F.count("load_mw").alias("__p"))
    within = Window.partitionBy("region", "__chunk").orderBy("time_utc")
    step = S.hours_between(F.col("time_utc"), F.lag("time_utc").over(within))
    loaded = F.when(F.col("__p") > 0, F.col("time_utc"))
    return (
        hours.withColumn("__chunk", day_chunk())
        .withColumn("__step", step)
        .groupBy("region", "__chunk")
        .agg(
            F.min("time_utc").alias("t0"),
            F.max("time_utc").alias("t1"),
            F.sum("__n").alias("n"),
            F.sum(F.col("__n") - 1).alias("dups"),
            F.count_if(F.col("__step") > 1).alias("gaps"),
            F.max(F.when(F.col("__step") > 1, F.col("__step"))).alias("widest"),
            F.sum("__p").alias("present"),
            F.min(loaded).alias("p0"),
            F.max(loaded).alias("p1"),
        )
    )


def panel_audit(panel: DataFrame) -> DataFrame:
    """Per region: row counts, duplicates, gaps over one hour, and where the load is present.

    Gaps inside a day come from a per-day window; gaps across days from the
    day bounds, one row per region and day.
    """
    chunks = _chunk_gaps(panel)
    across = S.hours_between(F.col("t0"), F.lag("t1").over(Window.partitionBy("region").orderBy("__chunk")))
    stitched = chunks.withColumn("jump", across)
    expected = S.hours_between(F.max("t1"), F.min("t0")) + 1
    return stitched.groupBy("region").agg(
        F.sum("n").alias("actual_rows"),
        F.floor(expected).cast("bigint").alias("expected_hourly_rows"),
        F.sum("dups").alias("duplicate_timestamps"),
        (F.sum("gaps") + F.count_if(F.col("jump") > 1)).alias("num_gaps_gt_1h"),
        F.coalesce(
            F.greatest(F.max("widest"), F.max(F.when(F.col("jump") > 1, F.col("jump")))), F.lit(0.0)
        ).alias("largest_gap_hours"),
        F.sum("present").alias("load_present_rows"),
        (F.sum("n") - F.sum("present")).alias("load_missing_rows"),
        F.min("p0").alias("first_load_present_utc"),
        F.max("p1").alias("last_load_present_utc"),
    )


def gap_audit(panel: DataFrame) -> DataFrame:
    audit = panel_audit(panel)
    return audit.select(
        "region",
        "num_gaps_gt_1h",
        "largest_gap_hours",
        F.col("expected_hourly_rows").alias("expected_hourly_rows_if_contiguous"),
        "actual_rows",
        (F.col("expected_hourly_rows") - F.col("actual_rows")).alias("missing_hours_within_span"),
    )


def missing_blocks(panel: DataFrame, value: str = "load_mw") -> DataFrame:
    """Runs of consecutive rows without a value: start, end and length.

    A missing row's position among all rows minus its position among missing
    rows is constant along a run, so the runs fall out of one aggregate. Meant
    for a de-duplicated panel, whose (region, month) holds at most 744 hours.
    """
    missing = F.col(value).isNull()
    # Duplicate hours order deterministically: present rows first.
    order = [F.col("time_utc"), F.col(value).desc_nulls_last()]
    counted = with_running_counts(
        panel.select("region", "time_utc", value),
        ["region"],
        order,
        month_chunk(),
        {"n_all": F.lit(True), "n_missing": missing},
    )
    return (
        counted.where(missing)
        .withColumn("run", F.col("n_all") - F.col("n_missing"))
        .groupBy("region", "run")
        .agg(
            F.min("time_utc").alias("block_start"),
            F.max("time_utc").alias("block_end"),
            F.count("*").alias("block_rows"),
        )
        .drop("run")
    )


def first_blocks(blocks: DataFrame, n: int = 10) -> DataFrame:
    """The first n blocks of each region, with how many more there are."""
    from tidewatt.operators.ordered import top_rows

    ranked = top_rows(blocks, n, ["region"], [F.col("block_start")], rank="block_no")
    totals = blocks.groupBy("region").agg(F.count("*").alias("__blocks"))
    return ranked.join(totals, "region").withColumn(
        "more_blocks", F.greatest(F.col("__blocks") - n, F.lit(0))
    ).drop("__blocks")


def load_cutoff(panel: DataFrame) -> DataFrame:
    """Per region: last hour with load, rows after it, and whether all of those lack load."""
    bounded = attach_group_stats(
        panel.select("region", "time_utc", "load_mw"),
        ["region"],
        last_load_utc=F.max(F.when(F.col("load_mw").isNotNull(), F.col("time_utc"))),
    )
    after = F.col("time_utc") > F.col("last_load_utc")
    return bounded.groupBy("region", "last_load_utc").agg(
        F.count_if(after).alias("rows_after"),
        F.count_if(after & F.col("load_mw").isNotNull()).alias("rows_after_with_load"),
    )


def day_completeness(frame: DataFrame, expected_regions: DataFrame, hours: int = 24) -> DataFrame:
    """Per expected or actual region: rows of the day and whether they are complete."""
    actual = frame.groupBy("region").agg(F.count("*").alias("day_rows"))
    expected = expected_regions.select("region").distinct().withColumn("__expected", F.lit(1))
    return (
        expected.join(actual, "region", "full")
        .select(
            "region",
            F.coalesce("day_rows", F.lit(0)).alias("day_rows"),
            F.coalesce("__expected", F.lit(0)).cast("int").alias("is_expected"),
        )
        .withColumn("is_complete", ((F.col("day_rows") == hours) & (F.col("is_expected") == 1)).cast("int"))
    )


def require_complete_day(frame: DataFrame, expected_regions: DataFrame, hours: int = 24) -> DataFrame:
    """Error unless every expected region, and no other, has exactly `hours` rows."""
    bad = day_completeness(frame, expected_regions, hours).where("is_complete = 0").take(20)
    if bad:
        raise ValueError("Incomplete day: " + "; ".join(f"{r['region']}={r['day_rows']}" for r in bad))
    return frame
