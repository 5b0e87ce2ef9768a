"""Missing weekly lags: which, where, when and why."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatt import constants as K
from tidewatt.functions import holidays as H
from tidewatt.functions import scalar as S
from tidewatt.operators import diagnose as D
from tidewatt.plans import fixtures as X
from tidewatt.plans.calendar_queries import FEDERAL_RULES, STATE_RULES
from tidewatt.plans.registry import query

# `signup` stands in for the region without load; the rows of `click` are moved on and those of `view` back, so that
# regions start and end apart and all reasons occur.
GAPPY = X.PANEL + """, gappy as (
  select region, case region when 'click' then time_utc + interval 3 day when 'view' then time_utc - interval 11 day else time_utc end as time_utc,
    ord, load_mw from panel)"""

MISSING = GAPPY + """, kept as (select * from gappy where region <> 'signup'),
bounds as (select region, min(time_utc) as region_start, max(time_utc) as region_end from kept group by region),
missing as (
  select k.*, k.time_utc - interval 7 day as previous_week_time, b.region_start, b.region_end,
         cast(k.time_utc - interval 7 day in (select time_utc from kept) as int) as prev_week_exists_any_region
  from kept k join bounds b on b.region = k.region
  where not exists (select 1 from kept h where h.region = k.region and h.time_utc = k.time_utc - interval 7 day)),
reasoned as (
  select *, case when previous_week_time < region_start then 'before_region_start'
                 when previous_week_time > region_end then 'after_region_end'
                 when prev_week_exists_any_region = 1 then 'prev_week_time_exists_in_other_regions_only'
                 when month(time_utc) in (3, 11) then 'dst_or_calendar_alignment_issue'
                 else 'unknown_no_match_within_region' end as missing_reason from missing)"""

FLAGGED = GAPPY + """, flagged as (
  select g.*, h.load_mw is not null as has_previous_week, min(g.time_utc) over (partition by g.region) as region_start
  from gappy g left join gappy h on h.region = g.region and h.time_utc + interval 7 day = g.time_utc),
dist as (select *, date_diff('second', region_start, time_utc) / 3600.0 as h from flagged where not has_previous_week)"""


def gappy(spark, sf):
    moved = "case region when 'click' then time_utc + interval 3 day when 'view' then time_utc - interval 11 day else time_utc end"
    return X.panel(spark, sf).withColumn("time_utc", F.expr(moved))


def reasoned(spark, sf):
    return D.missing_with_reason(gappy(spark, sf), "signup")


def flagged(spark, sf):
    return D.with_lag_presence(gappy(spark, sf))


@query("lag_missing_anti", f"with {MISSING} select region, time_utc, load_mw, previous_week_time, region_start, region_end from missing")
def _(spark, sf):
    return D.missing_lag(gappy(spark, sf), "signup").drop("ord")


@query(
    "region_bounds",
    f"""with {GAPPY} select region, time_utc, min(time_utc) over (partition by region) as region_start,
        max(time_utc) over (partition by region) as region_end from gappy""",
)
def _(spark, sf):
    return D.with_region_bounds(gappy(spark, sf).select("region", "time_utc"))


@query("lag_any_region", f"with {MISSING} select region, time_utc, previous_week_time, prev_week_exists_any_region from missing")
def _(spark, sf):
    rows = D.drop_region(gappy(spark, sf), "signup")
    out = D.with_any_region(D.missing_lag(rows, None), rows)
    return out.select("region", "time_utc", "previous_week_time", "prev_week_exists_any_region")


@query("lag_missing_reason", f"with {MISSING} select region, time_utc, missing_reason from reasoned")
def _(spark, sf):
    return reasoned(spark, sf).select("region", "time_utc", "missing_reason")


@query(
    "lag_missing_reason3",
    f"""with {MISSING} select region, time_utc, case when previous_week_time < region_start then 'before_region_start'
        when previous_week_time > region_end then 'after_region_end' else 'unexpected_no_match' end as missing_reason from missing""",
)
def _(spark, sf):
    return D.classify_exact(D.missing_lag(gappy(spark, sf), "signup")).select("region", "time_utc", "missing_reason")


COUNTS = ", ".join(f"count(*) filter (missing_reason = '{r}') as {r}" for r in D.REASONS)
WEEKDAY_LIST = "(select unnest(['" + "', '".join(K.WEEKDAYS) + "']) as weekday)"


@query("xtab_region", f"with {MISSING} select region, {COUNTS} from reasoned group by 1")
def _(spark, sf):
    return D.cross_tab(reasoned(spark, sf), F.col("region"), "region")


@query("xtab_month", f"with {MISSING} select strftime(time_utc, '%Y-%m') as year_month, {COUNTS} from reasoned group by 1")
def _(spark, sf):
    return D.cross_tab(reasoned(spark, sf), S.year_month(F.col("time_utc")), "year_month")


@query("xtab_hour", f"with {MISSING} select cast(hour(time_utc) as int) as hour, {COUNTS} from reasoned group by 1")
def _(spark, sf):
    return D.cross_tab(reasoned(spark, sf), F.hour("time_utc"), "hour")


@query(
    "xtab_weekday",
    f"""with {MISSING} select w.weekday, {COUNTS} from {WEEKDAY_LIST} w
        left join reasoned r on dayname(r.time_utc) = w.weekday group by 1""",
)
def _(spark, sf):
    return D.cross_tab(reasoned(spark, sf), S.weekday_name(F.col("time_utc")), "weekday", K.WEEKDAYS)


@query(
    "xtab_recent",
    f"""with {MISSING} select strftime(time_utc, '%Y-%m') as year_month, {COUNTS} from reasoned
        where time_utc >= timestamp '2024-01-15' group by 1""",
)
def _(spark, sf):
    recent = reasoned(spark, sf).where("time_utc >= timestamp'2024-01-15'")
    return D.cross_tab(recent, S.year_month(F.col("time_utc")), "year_month")


@query(
    "sample_by_reason",
    f"""with {MISSING} select region, time_utc, missing_reason,
        cast(row_number() over (partition by missing_reason order by region, time_utc) as int) as sample_no
        from reasoned qualify row_number() over (partition by missing_reason order by region, time_utc) <= 20""",
)
def _(spark, sf):
    return D.samples(reasoned(spark, sf)).select("region", "time_utc", "missing_reason", "sample_no")


@query("missing_by_month", f"with {FLAGGED} select strftime(time_utc, '%Y-%m') as year_month, count(*) as missing_rows from dist group by 1")
def _(spark, sf):
    return D.value_counts(flagged(spark, sf).where(~F.col("has_previous_week")), S.year_month(F.col("time_utc")), "year_month")


@query(
    "missing_by_weekday",
    f"with {FLAGGED} select w.weekday, count(d.region) as missing_rows from {WEEKDAY_LIST} w left join dist d on dayname(d.time_utc) = w.weekday group by 1",
)
def _(spark, sf):
    missing = flagged(spark, sf).where(~F.col("has_previous_week"))
    return D.value_counts(missing, S.weekday_name(F.col("time_utc")), "weekday", K.WEEKDAYS)


@query("missing_by_hour", f"with {FLAGGED} select cast(hour(time_utc) as int) as hour, count(*) as missing_rows from dist group by 1")
def _(spark, sf):
    return D.value_counts(flagged(spark, sf).where(~F.col("has_previous_week")), F.hour("time_utc"), "hour")


CALENDAR = """wd as (select d, year(d) as y, month(d) as m, day(d) as dd, isodow(d) as w, (day(d) - 1) // 7 + 1 as nth,
    day(d) + 7 > day(last_day(d)) as is_last from (select unnest(generate_series(date '2023-01-01', date '2025-12-31', interval 1 day)) as d)),
fixed as (select y, m, dd, case w when 6 then d - interval 1 day when 7 then d + interval 1 day else d end as hday from wd),
marked as (select *, cast(isodow(time_utc) >= 6 as int) as is_weekend,
    cast(date_trunc('day', time_utc) in (select hday from (""" + FEDERAL_RULES + """)) as int) as US_federal_holidays,
    cast(date_trunc('day', time_utc) in (select hday from (""" + STATE_RULES + """)) as int) as state_holidays from flagged)"""


@query(
    "missing_by_flag",
    f"""with {FLAGGED}, {CALENDAR} select 'is_weekend' as flag, is_weekend as flag_value, count(*) as missing_rows from marked where not has_previous_week group by 2
        union all select 'US_federal_holidays', US_federal_holidays, count(*) from marked where not has_previous_week group by 2
        union all select 'state_holidays', state_holidays, count(*) from marked where not has_previous_week group by 2""",
)
def _(spark, sf):
    missing = H.with_calendar_flags(flagged(spark, sf)).where(~F.col("has_previous_week"))
    return missing.unpivot([], K.FEATURE_COLUMNS[:3], "flag", "flag_value").groupBy("flag", "flag_value").agg(
        F.count("*").alias("missing_rows")
    )


@query(
    "missing_rate_flag",
    f"""with {FLAGGED}, {CALENDAR}, long as (
          select 'is_weekend' as flag, is_weekend as flag_value, has_previous_week from marked
          union all select 'US_federal_holidays', US_federal_holidays, has_previous_week from marked
          union all select 'state_holidays', state_holidays, has_previous_week from marked)
        select flag, flag_value, count(*) as total_rows, count(*) filter (not has_previous_week) as missing_rows,
        round(100.0 * count(*) filter (not has_previous_week) / count(*), 6) as pct_missing from long group by 1, 2""",
)
def _(spark, sf):
    marked = H.with_calendar_flags(flagged(spark, sf))
    long = marked.unpivot(["has_previous_week"], K.FEATURE_COLUMNS[:3], "flag", "flag_value")
    return D.missing_rate(long, ["flag", "flag_value"]).withColumn("pct_missing", F.round("pct_missing", 6))


@query(
    "missing_rate_region",
    f"""with {FLAGGED} select region, count(*) as total_rows, count(*) filter (not has_previous_week) as missing_rows,
        round(100.0 * count(*) filter (not has_previous_week) / count(*), 6) as pct_missing from flagged group by 1""",
)
def _(spark, sf):
    rate = D.missing_rate(flagged(spark, sf), ["region"]).withColumn("pct_missing", F.round("pct_missing", 6))
    return rate.orderBy(F.desc("missing_rows"), F.desc("pct_missing"))


@query(
    "start_distance",
    f"""with {FLAGGED} select region, time_utc, cast(h as double) as hours_from_start, round(h / 24.0, 8) as days_from_start from dist""",
)
def _(spark, sf):
    return D.start_distance(flagged(spark, sf)).select(
        "region", "time_utc", "hours_from_start", F.round("days_from_start", 8).alias("days_from_start")
    )


@query(
    "start_distance_describe",
    f"""with {FLAGGED} select count(h) as count, round(avg(h), 6) as mean, round(stddev_samp(h), 6) as std, cast(min(h) as double) as min,
        quantile_cont(h, 0.25) as p25, quantile_cont(h, 0.5) as p50, quantile_cont(h, 0.75) as p75, round(quantile_cont(h, 0.9), 6) as p90,
        round(quantile_cont(h, 0.95), 6) as p95, round(quantile_cont(h, 0.99), 6) as p99, cast(max(h) as double) as max
        from (select cast(h as double) as h from dist)""",
)
def _(spark, sf):
    out = D.describe(D.start_distance(flagged(spark, sf)), "hours_from_start")
    return out.withColumns({c: F.round(c, 6) for c in ("mean", "std", "p90", "p95", "p99")})


@query(
    "start_distance_buckets",
    f"""with {FLAGGED} select count(*) filter (h < 24) as within_first_24h, count(*) filter (h < 168) as within_first_7d,
        count(*) filter (h < 192) as within_first_8d, count(*) filter (h >= 168) as after_first_7d,
        round(100.0 * count(*) filter (h < 168) / count(*), 6) as pct_first_week,
        case when 100.0 * count(*) filter (h < 168) / count(*) > 95 then 'expected_start_of_history' else 'gaps_likely' end as verdict from dist""",
)
def _(spark, sf):
    return D.distance_buckets(D.start_distance(flagged(spark, sf))).withColumn("pct_first_week", F.round("pct_first_week", 6))


@query(
    "time_range_region",
    f"with {GAPPY} select region, min(time_utc) as earliest_time, max(time_utc) as latest_time, count(*) as total_rows from gappy group by 1",
)
def _(spark, sf):
    return D.time_range(gappy(spark, sf))


@query(
    "time_range_all",
    f"with {GAPPY} select min(time_utc) as earliest_time, max(time_utc) as latest_time from gappy",
)
def _(spark, sf):
    return gappy(spark, sf).agg(F.min("time_utc").alias("earliest_time"), F.max("time_utc").alias("latest_time"))
