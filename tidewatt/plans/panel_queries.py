"""Panel scan, spine, filters, lags, de-duplication, audits and windows."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from tidewatt import constants as K
from tidewatt.functions import scalar as S
from tidewatt.operators import ordered as O
from tidewatt.operators import panel as P
from tidewatt.operators import reconcile as R
from tidewatt.operators.weather import with_degree_days
from tidewatt.plans import fixtures as X
from tidewatt.plans.registry import query
from tidewatt.sources import files as SF

# ---- scan and sink ------------------------------------------------------------------------

TEXT = X.PANEL + """, raw as (
  select region, case when ord % 29 = 0 then 'bad ' || ord else strftime(time_utc, '%Y-%m-%d %H:%M:%S') end as time_utc,
         case when load_mw is null or ord % 23 = 0 then 'n/a' else cast(cast(round(load_mw * 100) as bigint) as varchar) end as load_mw
  from panel)"""


def raw_panel(spark, sf):
    return X.panel(spark, sf).select(
        "region",
        F.when(F.col("ord") % 29 == 0, F.concat(F.lit("bad "), F.col("ord").cast("string")))
        .otherwise(F.date_format("time_utc", K.TIME_TEXT_FORMAT))
        .alias("time_utc"),
        F.when(F.col("load_mw").isNull() | (F.col("ord") % 23 == 0), "n/a")
        .otherwise(X.cents("load_mw").cast("string"))
        .alias("load_mw"),
    )


@query(
    "panel_scan",
    f"""with {TEXT} select region, try_cast(time_utc as timestamp) as time_utc, try_cast(load_mw as double) as load_mw
        from raw where try_cast(time_utc as timestamp) is not null""",
)
def _(spark, sf):
    return SF.parse_panel(raw_panel(spark, sf), strict=False)


@query(
    "panel_scan_report",
    f"""with {TEXT} select count(*) as rows, count(*) filter (try_cast(time_utc as timestamp) is null) as bad_time_rows from raw""",
)
def _(spark, sf):
    return SF.bad_times(raw_panel(spark, sf))


@query(
    "panel_sink_format",
    f"""with {X.PANEL} select region, strftime(time_utc, '%Y-%m-%d:%H') as time_key,
        strftime(time_utc, '%Y-%m-%d %H:%M:%S') as time_utc, load_mw,
        (select 'caiso_dataset_' || strftime(min(time_utc), '%Y%m%d') || '_to_' || strftime(max(time_utc), '%Y%m%d') || '.csv' from panel) as file_name
        from panel""",
)
def _(spark, sf):
    panel = X.panel(spark, sf).drop("ord")
    span = panel.agg(F.min("time_utc").alias("start_date"), F.max("time_utc").alias("end_date"))
    return SF.panel_text(panel).withColumn("file_name", SF.infer_span(span).select("file_name").scalar())


@query(
    "score_zero_fill",
    f"""with {X.LAGGED} select region, time_utc, 0.0::double as temperature_2m, 0.0::double as wind_speed_10m,
        load_previous_week, 0.0::double as is_weekend from lagged""",
)
def _(spark, sf):
    features = ["temperature_2m", "wind_speed_10m", "load_previous_week", "is_weekend"]
    return P.align_features(X.lagged(spark, sf), features, keep=["region", "time_utc"])


@query(
    "schema_fill",
    f"""with {X.PANEL} select region, null::varchar as time_key, time_utc, null::double as temperature_2m, load_mw,
        null::double as load_previous_week from panel""",
)
def _(spark, sf):
    return P.fill_schema(
        X.panel(spark, sf),
        {
            "region": "string",
            "time_key": "string",
            "time_utc": "timestamp",
            "temperature_2m": "double",
            "load_mw": "double",
            "load_previous_week": "double",
        },
    )


# ---- filters ------------------------------------------------------------------------------


@query("region_filter", f"with {X.PANEL} select region, time_utc, load_mw from panel where region in ('click', 'view', 'error')")
def _(spark, sf):
    return P.keep_regions(X.panel(spark, sf), ["click", "view", "error"]).drop("ord")


@query(
    "usable_rows",
    f"""with {X.LAGGED} select region, time_utc, load_mw, load_previous_week from lagged
        where load_mw is not null and load_previous_week is not null""",
)
def _(spark, sf):
    return P.usable_rows(X.lagged(spark, sf)).drop("ord")


@query(
    "usable_rows_report",
    f"""with {X.LAGGED} select count(*) as rows_before, count(*) filter (load_mw is null) as missing_load,
        count(*) filter (load_previous_week is null) as missing_previous_week,
        count(*) filter (load_mw is null or load_previous_week is null) as rows_dropped,
        count(*) filter (load_mw is not null and load_previous_week is not null) as rows_after from lagged""",
)
def _(spark, sf):
    return P.usable_rows_report(X.lagged(spark, sf))


@query(
    "usable_next_day",
    f"with {X.LAGGED} select region, time_utc, load_previous_week from lagged where load_previous_week is not null",
)
def _(spark, sf):
    return P.usable_next_day(X.lagged(spark, sf).drop("load_mw", "ord"))


@query(
    "buffered_range",
    f"""with {X.PARTS},
        near as (select * from parts where time_utc >= timestamp '2024-01-08 00:00:00' and time_utc <= timestamp '2024-01-14 23:00:00'),
        merged as (select region, time_utc, arg_min(load_mw, part_no) filter (load_mw is not null) as load_mw from near group by 1, 2),
        hours as (select r.region, h.t as time_utc from (select distinct region from parts) r,
          (select unnest(generate_series(timestamp '2024-01-10 00:00:00', timestamp '2024-01-12 23:00:00', interval 1 hour)) as t) h)
        select h.region, h.time_utc, m.load_mw from hours h left join merged m on m.region = h.region and m.time_utc = h.time_utc""",
)
def _(spark, sf):
    start, end = date(2024, 1, 10), date(2024, 1, 12)
    parts = X.parts(spark, sf)
    merged = R.coalesce_parts(P.buffered_range(parts, start, end), ["load_mw"], "part_no", P.KEY)
    hours = parts.select("region").distinct().select(
        "region",
        F.explode(
            F.sequence(P.utc_lit(P.day_start(start)), F.lit("2024-01-12 23:00:00").cast("timestamp"), F.expr("interval 1 hour"))
        ).alias("time_utc"),
    )
    return P.reindex(P.strict_range(merged, start, end), hours)


@query(
    "target_day",
    f"""with {X.PANEL} select region, time_utc, load_mw from panel
        where time_utc >= timestamp '2024-01-15' and time_utc < timestamp '2024-01-16'""",
)
def _(spark, sf):
    return P.target_day(X.panel(spark, sf), date(2024, 1, 15)).drop("ord")


# ---- lags ---------------------------------------------------------------------------------


@query("lag_week_exact", f"with {X.LAGGED} select region, time_utc, load_mw, load_previous_week from lagged")
def _(spark, sf):
    return X.lagged(spark, sf).drop("ord")


@query(
    "lag_week_history",
    f"""with {X.PANEL}, {X.PARTS} select p.region, p.time_utc, p.load_mw, h.load_mw as load_previous_week
        from panel p left join (select * from parts where part_no = 1) h
        on h.region = p.region and h.time_utc + interval 7 day = p.time_utc""",
)
def _(spark, sf):
    return P.with_week_lag(X.panel(spark, sf).drop("ord"), X.parts(spark, sf).where("part_no = 1"))


STORED = X.LAGGED + """, stored as (
  select region, time_utc, load_mw,
         case when ord % 17 = 0 then null when ord % 13 = 0 then load_previous_week + 1 else load_previous_week end as load_previous_week
  from lagged), checked as (
  select s.region, s.time_utc, s.load_mw, s.load_previous_week, h.load_mw as expected_load_previous_week
  from stored s left join stored h on h.region = s.region and h.time_utc + interval 7 day = s.time_utc)"""


def stored_lag(spark, sf):
    return X.lagged(spark, sf).withColumn(
        "load_previous_week",
        F.when(F.col("ord") % 17 == 0, None)
        .when(F.col("ord") % 13 == 0, F.col("load_previous_week") + 1)
        .otherwise(F.col("load_previous_week")),
    ).drop("ord")


@query(
    "lag_validate",
    f"""with {STORED} select count(*) as total_rows, count(expected_load_previous_week) as rows_with_history,
        count(*) filter (expected_load_previous_week is not null and load_previous_week = expected_load_previous_week) as correct_rows,
        count(*) filter (expected_load_previous_week is not null and load_previous_week is distinct from expected_load_previous_week) as incorrect_rows
        from checked""",
)
def _(spark, sf):
    return P.lag_validate(stored_lag(spark, sf))


@query(
    "lag_validate_bad",
    f"""with {STORED} select * from checked
        where expected_load_previous_week is not null and load_previous_week is distinct from expected_load_previous_week""",
)
def _(spark, sf):
    return P.lag_bad_rows(stored_lag(spark, sf))


# ---- spine, unions, de-duplication --------------------------------------------------------

SPINE = """ends as (select date_trunc('day', min(time_utc)) as d0, date_trunc('day', max(time_utc)) + interval 23 hour as d1 from panel),
spine as (select r.region, h.t as time_utc from (select distinct region from panel) r,
          (select unnest(generate_series(d0, d1, interval 1 hour)) as t from ends) h)"""


@query(
    "hour_spine",
    f"""with {X.PANEL}, {SPINE} select s.region, s.time_utc, p.load_mw
        from spine s left join panel p on p.region = s.region and p.time_utc = s.time_utc""",
)
def _(spark, sf):
    panel = X.panel(spark, sf).drop("ord")
    return P.reindex(panel, P.region_spine(panel))


@query("union_parts", f"with {X.PARTS} select part_no, region, time_utc, load_mw, case when part_no = 1 then row_ord::double end as row_ord from parts")
def _(spark, sf):
    parts = X.parts(spark, sf).withColumn("row_ord", F.col("row_ord").cast("double"))
    return P.union_parts(parts.where("part_no = 0").drop("row_ord"), parts.where("part_no = 1"))


@query(
    "dedup_last",
    f"""with {X.PARTS} select region, time_utc, part_no, load_mw from parts
        qualify row_number() over (partition by region, time_utc order by part_no desc, row_ord desc) = 1""",
)
def _(spark, sf):
    return P.keep_last(X.parts(spark, sf), ["part_no", "row_ord"]).drop("row_ord")


@query(
    "dedup_first",
    f"""with {X.PARTS} select region, time_utc, part_no, load_mw from parts
        qualify row_number() over (partition by region, time_utc order by part_no, row_ord) = 1""",
)
def _(spark, sf):
    return P.keep_first(X.parts(spark, sf), ["part_no", "row_ord"]).drop("row_ord")


@query(
    "dedup_report",
    f"""with {X.PARTS}, k as (select count(*) as n from parts group by region, time_utc)
        select cast(sum(n) as bigint) as rows_before, count(*) as rows_after, cast(sum(n - 1) as bigint) as rows_removed from k""",
)
def _(spark, sf):
    return P.dedup_report(X.parts(spark, sf))


# ---- several sources ----------------------------------------------------------------------

FILLED = X.PARTS + """, filled as (
  select coalesce(a.region, b.region) as region, coalesce(a.time_utc, b.time_utc) as time_utc,
         coalesce(a.load_mw, b.load_mw) as load_mw
  from (select * from parts where part_no = 0) a full join (select * from parts where part_no = 1) b
  on a.region = b.region and a.time_utc = b.time_utc)"""


@query("source_fill", f"with {FILLED} select region, time_utc, load_mw from filled")
def _(spark, sf):
    parts = X.parts(spark, sf)
    return R.fill_from(parts.where("part_no = 0"), parts.where("part_no = 1"), ["load_mw"], P.KEY)


@query(
    "source_strategy",
    f"""with {FILLED}, {X.PANEL}, {SPINE}, cells as (
        select s.region, s.time_utc, a.load_mw as before_mw, f.load_mw as after_mw from spine s
        left join (select * from parts where part_no = 0) a on a.region = s.region and a.time_utc = s.time_utc
        left join filled f on f.region = s.region and f.time_utc = s.time_utc)
        select region, count(*) as requested, count(*) filter (before_mw is null) as missing_before,
        count(*) filter (after_mw is null) as missing_after,
        count(*) filter (before_mw is null) - count(*) filter (after_mw is null) as filled
        from cells group by region""",
)
def _(spark, sf):
    parts = X.parts(spark, sf)
    spine = P.region_spine(parts)
    a, b = (P.reindex(parts.where(f"part_no = {n}").select(*P.KEY, "load_mw"), spine) for n in (0, 1))
    chosen, _ = R.choose_source(lambda: a, lambda: b, ["load_mw"], "a_then_b", P.KEY)
    return R.source_fill_report(spine, a, chosen, "load_mw", P.KEY)


# ---- audits -------------------------------------------------------------------------------


@query(
    "coverage_by_region",
    f"""with {X.PANEL} select region, min(time_utc) as first_time_utc, max(time_utc) as last_time_utc, count(*) as rows,
        count(*) filter (load_mw is null) as missing_load_rows from panel group by region""",
)
def _(spark, sf):
    return P.coverage_by_region(X.panel(spark, sf))


@query(
    "missing_by_region",
    f"""with {X.PANEL} select region, count(*) as rows, count(*) filter (load_mw is null) as missing_load_rows,
        round(count(*) filter (load_mw is null) / count(*), 6) as missing_load_fraction from panel group by region""",
)
def _(spark, sf):
    return P.missing_by_region(X.panel(spark, sf)).withColumn("missing_load_fraction", F.round("missing_load_fraction", 6))


AUDIT = """steps as (
  select *, date_diff('second', lag(time_utc) over (partition by region order by time_utc), time_utc) / 3600.0 as step from rows_in),
audit as (
  select region, count(*) as actual_rows,
         cast(date_diff('hour', min(time_utc), max(time_utc)) + 1 as bigint) as expected_hourly_rows,
         count(*) filter (step = 0) as duplicate_timestamps, count(*) filter (step > 1) as num_gaps_gt_1h,
         cast(coalesce(max(step) filter (step > 1), 0) as double) as largest_gap_hours,
         count(load_mw) as load_present_rows, count(*) - count(load_mw) as load_missing_rows,
         min(time_utc) filter (load_mw is not null) as first_load_present_utc,
         max(time_utc) filter (load_mw is not null) as last_load_present_utc
  from steps group by region)"""


@query("panel_audit", f"with {X.PARTS}, rows_in as (select region, time_utc, load_mw from parts), {AUDIT} select * from audit")
def _(spark, sf):
    return P.panel_audit(X.parts(spark, sf))


@query(
    "gap_audit",
    f"""with {X.PANEL}, rows_in as (select region, time_utc, load_mw from panel), {AUDIT}
        select region, num_gaps_gt_1h, largest_gap_hours, expected_hourly_rows as expected_hourly_rows_if_contiguous,
        actual_rows, expected_hourly_rows - actual_rows as missing_hours_within_span from audit""",
)
def _(spark, sf):
    return P.gap_audit(X.panel(spark, sf))


@query(
    "panel_overall",
    f"""with {X.PANEL} select count(*) as rows, string_agg(distinct region, ',' order by region) as regions,
        min(time_utc) as first_time_utc, max(time_utc) as last_time_utc from panel""",
)
def _(spark, sf):
    return P.panel_overall(X.panel(spark, sf))


@query(
    "column_missing",
    f"""with {X.LAGGED} select 'load_mw' as column_name, count(*) filter (load_mw is null) as missing_rows from lagged
        union all select 'load_previous_week', count(*) filter (load_previous_week is null) from lagged
        union all select 'time_utc', count(*) filter (time_utc is null) from lagged""",
)
def _(spark, sf):
    return P.column_missing(X.lagged(spark, sf), ["load_mw", "load_previous_week", "time_utc"])


@query(
    "time_key_mismatch",
    f"""with {X.PANEL} select region, time_utc, strftime(time_utc + interval 1 hour, '%Y-%m-%d:%H') as time_key
        from panel where ord % 37 = 0""",
)
def _(spark, sf):
    shifted = F.when(F.col("ord") % 37 == 0, F.col("time_utc") + F.expr("INTERVAL 1 HOUR")).otherwise(F.col("time_utc"))
    keyed = X.panel(spark, sf).withColumn("time_key", S.time_key(shifted))
    return P.time_key_mismatches(keyed).select("region", "time_utc", "time_key")


@query(
    "load_cutoff",
    f"""with {X.PANEL}, cut as (select region, time_utc, case when time_utc < timestamp '2024-01-25' then load_mw end as load_mw from panel),
        last as (select region, max(time_utc) filter (load_mw is not null) as last_load_utc from cut group by region)
        select c.region, l.last_load_utc, count(*) filter (c.time_utc > l.last_load_utc) as rows_after,
        count(*) filter (c.time_utc > l.last_load_utc and c.load_mw is not null) as rows_after_with_load
        from cut c join last l on c.region = l.region group by 1, 2""",
)
def _(spark, sf):
    cut = X.panel(spark, sf).withColumn("load_mw", F.expr("case when time_utc < timestamp'2024-01-25' then load_mw end"))
    return P.load_cutoff(cut)


@query(
    "day_completeness",
    f"""with {X.PANEL}, day as (select region, count(*) as n from panel
          where time_utc >= timestamp '2024-01-15' and time_utc < timestamp '2024-01-16' group by 1),
        expected as (select distinct region from panel)
        select e.region, coalesce(d.n, 0) as day_rows, 1 as is_expected, cast(coalesce(d.n, 0) = 24 as int) as is_complete
        from expected e left join day d on d.region = e.region""",
)
def _(spark, sf):
    panel = X.panel(spark, sf)
    return P.day_completeness(P.target_day(panel, date(2024, 1, 15)), panel)


# ---- windows ------------------------------------------------------------------------------


@query(
    "missing_blocks",
    f"""with {X.PANEL}, f as (select region, time_utc, load_mw is null as m,
          row_number() over (partition by region order by time_utc)
          - sum(case when load_mw is null then 1 else 0 end) over (partition by region order by time_utc rows unbounded preceding) as run from panel)
        select region, min(time_utc) as block_start, max(time_utc) as block_end, count(*) as block_rows
        from f where m group by region, run""",
)
def _(spark, sf):
    return P.missing_blocks(X.panel(spark, sf))


@query(
    "missing_blocks_head",
    f"""with {X.PANEL}, f as (select region, time_utc, load_mw is null as m,
          row_number() over (partition by region order by time_utc)
          - sum(case when load_mw is null then 1 else 0 end) over (partition by region order by time_utc rows unbounded preceding) as run from panel),
        b as (select region, min(time_utc) as block_start, max(time_utc) as block_end, count(*) as block_rows from f where m group by region, run)
        select region, block_start, block_end, block_rows, cast(row_number() over (partition by region order by block_start) as int) as block_no,
        greatest(count(*) over (partition by region) - 10, 0) as more_blocks from b
        qualify row_number() over (partition by region order by block_start) <= 10""",
)
def _(spark, sf):
    return P.first_blocks(P.missing_blocks(X.panel(spark, sf)), 10)


@query(
    "lag_rows_24",
    f"""with {X.PANEL} select region, time_utc, load_mw, lag(load_mw, 24) over (partition by region order by time_utc) as load_lag_24h from panel""",
)
def _(spark, sf):
    return O.lag_rows(X.panel(spark, sf).drop("ord"), "load_mw", 24, "load_lag_24h")


@query(
    "trailing_mean_24",
    f"""with {X.PANEL} select region, time_utc, load_mw, round(avg(load_mw) over
        (partition by region order by time_utc rows between 24 preceding and 1 preceding), 8) as load_24h_avg from panel""",
)
def _(spark, sf):
    out = O.trailing_mean(X.panel(spark, sf).drop("ord"), "load_mw", 24, "load_24h_avg")
    return out.withColumn("load_24h_avg", F.round("load_24h_avg", 8))


@query(
    "time_idx",
    f"""with {X.PANEL} select region, time_utc, row_number() over (partition by region order by time_utc) - 1 as time_idx from panel""",
)
def _(spark, sf):
    return O.with_ordinal(X.panel(spark, sf).select("region", "time_utc"))


@query(
    "first_valid_time_idx",
    f"""with {X.PANEL}, i as (select region, time_utc, row_number() over (partition by region order by time_utc) - 1 as time_idx from panel)
        select region, min(time_idx) as first_valid_time_idx from i where time_utc >= timestamp '2024-01-20' group by region""",
)
def _(spark, sf):
    indexed = O.with_ordinal(X.panel(spark, sf).select("region", "time_utc"))
    valid = indexed.where(F.col("time_utc") >= F.lit("2024-01-20").cast("timestamp"))
    return valid.groupBy("region").agg(F.min("time_idx").alias("first_valid_time_idx"))


@query(
    "tail_history",
    f"""with {X.PANEL}, h as (select * from panel where time_utc < timestamp '2024-01-20'),
        t as (select region, time_utc, load_mw, 'history' as origin from h
              qualify row_number() over (partition by region order by time_utc desc) <= 24)
        select * from t union all
        select region, time_utc, null, 'next_day' from panel where time_utc >= timestamp '2024-01-20' and time_utc < timestamp '2024-01-21'""",
)
def _(spark, sf):
    panel = X.panel(spark, sf).drop("ord")
    history = panel.where(F.col("time_utc") < F.lit("2024-01-20").cast("timestamp"))
    ahead = P.target_day(panel, date(2024, 1, 20)).drop("load_mw")
    return P.union_parts(
        O.tail_rows(history, 24).withColumn("origin", F.lit("history")), ahead.withColumn("origin", F.lit("next_day"))
    )


@query(
    "lookback_sequences",
    f"""with {X.PANEL}, w as (select region, time_utc, load_mw,
          count(*) over s as n, sum(hour(time_utc)) over s as hour_sum, min(time_utc) over s as first_time, max(time_utc) over s as last_time,
          sum(cast(round(coalesce(load_mw, 0) * 100) as bigint)) over s as load_sum
          from panel window s as (partition by region order by time_utc rows between 24 preceding and 1 preceding))
        select region, time_utc, load_mw, cast(hour_sum as bigint) as hour_sum, cast(load_sum as bigint) as load_sum,
               epoch(first_time)::bigint as first_epoch, epoch(last_time)::bigint as last_epoch
        from w where n = 24""",
)
def _(spark, sf):
    rows = X.panel(spark, sf).select(
        "*", F.hour("time_utc").alias("h"), F.unix_timestamp("time_utc").alias("e"), F.coalesce("load_mw", F.lit(0.0)).alias("l")
    )
    built = O.lookback_sequences(rows, ["h", "l", "e"], 24)
    total = lambda i, scale: F.aggregate("sequence", F.lit(0).cast("bigint"), lambda acc, x: acc + F.round(x[i] * scale).cast("bigint"))
    return built.select(
        "region",
        "time_utc",
        "load_mw",
        total(0, 1).alias("hour_sum"),
        total(1, 100).alias("load_sum"),
        F.element_at("sequence", 1)[2].cast("bigint").alias("first_epoch"),
        F.element_at("sequence", -1)[2].cast("bigint").alias("last_epoch"),
    )


@query(
    "regions_unseen",
    f"""with {X.PANEL} select distinct region from panel where time_utc >= timestamp '2024-01-20'
        except select distinct region from panel where time_utc < timestamp '2024-01-20' and region <> 'view'""",
)
def _(spark, sf):
    train, valid = P.cutoff_split(X.panel(spark, sf), P.datetime(2024, 1, 19, 23, 59, 59))
    return valid.select("region").subtract(train.where("region <> 'view'").select("region"))


# ---- scalar features ----------------------------------------------------------------------


@query(
    "time_key",
    f"""with {X.PANEL} select region, time_utc, strftime(time_utc, '%Y-%m-%d:%H') as time_key,
        strptime(strftime(time_utc, '%Y-%m-%d:%H'), '%Y-%m-%d:%H') as parsed from panel""",
)
def _(spark, sf):
    keyed = X.panel(spark, sf).select("region", "time_utc", S.time_key(F.col("time_utc")).alias("time_key"))
    return keyed.withColumn("parsed", S.parse_time_key(F.col("time_key")))


@query(
    "calendar_parts",
    f"""with {X.PANEL} select region, time_utc, cast(year(time_utc) as int) as year, cast(month(time_utc) as int) as month,
        cast(day(time_utc) as int) as day, cast(isodow(time_utc) - 1 as int) as day_of_week, cast(hour(time_utc) as int) as hour,
        cast(dayofyear(time_utc) as int) as day_of_year from panel""",
)
def _(spark, sf):
    return X.panel(spark, sf).select("region", "time_utc").withColumns(S.calendar_parts(F.col("time_utc")))


@query(
    "cyclic_features",
    f"""with {X.PANEL} select region, time_utc, round(sin(2 * pi() * hour(time_utc) / 24.0), 9) + 0.0 as hour_sin,
        round(cos(2 * pi() * hour(time_utc) / 24.0), 9) + 0.0 as hour_cos,
        round(sin(2 * pi() * dayofyear(time_utc) / 365.25), 9) + 0.0 as doy_sin,
        round(cos(2 * pi() * dayofyear(time_utc) / 365.25), 9) + 0.0 as doy_cos from panel""",
)
def _(spark, sf):
    parts = {n: F.round(c, 9) + 0.0 for n, c in S.cyclic_parts(F.col("time_utc")).items()}
    return X.panel(spark, sf).select("region", "time_utc").withColumns(parts)


@query(
    "hour_onehot",
    f"""with {X.PANEL} select region, strftime(time_utc, '%Y-%m-%d:%H') as time_key, """
    + ", ".join(f"cast(hour(time_utc) = {h} as int) as hour_{h:02d}" for h in range(24))
    + " from panel",
)
def _(spark, sf):
    keyed = X.panel(spark, sf).select("region", S.time_key(F.col("time_utc")).alias("time_key"))
    checked = keyed.where(
        F.when(S.valid_hour_suffix(F.col("time_key")), F.lit(True)).otherwise(
            F.raise_error(F.concat(F.lit("bad time_key "), F.coalesce("time_key", F.lit("null")))).cast("boolean")
        )
    )
    return checked.withColumns(S.hour_indicators(F.col("time_key")))


@query(
    "log_link",
    f"""with {X.PANEL} select region, time_utc, round(ln(1 + load_mw), 9) as log_load,
        round(greatest(exp(ln(1 + load_mw)) - 1, 0), 4) as back from panel where load_mw is not null
        union all select region, time_utc, null, null from panel where load_mw is null""",
)
def _(spark, sf):
    logged = X.panel(spark, sf).select("region", "time_utc", S.to_log(F.col("load_mw")).alias("l"))
    return logged.select(
        "region", "time_utc", F.round("l", 9).alias("log_load"), F.round(S.from_log(F.col("l")), 4).alias("back")
    )


@query("region_code", f"with {X.PANEL} select distinct region, cast(dense_rank() over (order by region) - 1 as int) as region_code from panel")
def _(spark, sf):
    from tidewatt.models.preprocess import region_codes

    return region_codes(X.panel(spark, sf))


# ---- train-only preprocessing -------------------------------------------------------------

SPLIT = X.LAGGED + """, train as (select * from lagged where time_utc < timestamp '2024-01-20'),
 valid as (select * from lagged where time_utc >= timestamp '2024-01-20')"""


def split(spark, sf):
    return P.cutoff_split(X.lagged(spark, sf), P.datetime(2024, 1, 19, 23, 59, 59))


@query(
    "impute_median",
    f"""with {SPLIT}, m as (select median(load_mw) as a, median(load_previous_week) as b from train),
        r as (select region from train group by region order by count(*) desc, region limit 1)
        select case when v.ord % 5 = 0 then r.region else v.region end as region, time_utc,
        coalesce(load_mw, m.a) as load_mw, coalesce(load_previous_week, m.b) as load_previous_week
        from valid v, m, r""",
)
def _(spark, sf):
    from tidewatt.models.preprocess import fit_imputer

    train, valid = split(spark, sf)
    holes = valid.withColumn("region", F.when(F.col("ord") % 5 != 0, F.col("region")))
    return fit_imputer(train, ["load_mw", "load_previous_week"], ["region"])(holes).drop("ord")


@query(
    "median_by_region",
    f"""with {X.PANEL}
        select region, round(median(load_mw), 7) as load_mw, round(median(load_mw * load_mw - 40 * load_mw), 7) as bent,
        round(median(case when day(time_utc) % 2 = 0 then load_mw end), 7) as even_days, median(hour(time_utc)::double) as hour
        from panel group by region""",
)
def _(spark, sf):
    """Several columns of every region in the same three passes."""
    from tidewatt.operators.quantiles import exact_quantiles

    load, hour = F.col("load_mw"), F.hour("time_utc").cast("double")
    even = F.when(F.dayofmonth("time_utc") % 2 == 0, load)
    rows = X.panel(spark, sf).select("region", "load_mw", (load * load - 40 * load).alias("bent"), even.alias("even_days"), hour.alias("hour"))
    found = exact_quantiles(rows, ["load_mw", "bent", "even_days", "hour"], by=["region"])
    return found.select("region", *[F.round(c, 7).alias(c) for c in ("load_mw", "bent", "even_days")], "hour")


@query(
    "standardize",
    f"""with {SPLIT}, m as (select avg(load_mw) as ma, stddev_pop(load_mw) as sa, avg(hour(time_utc)) as mh, stddev_pop(hour(time_utc)) as sh from train)
        select region, time_utc, round((load_mw - ma) / sa, 6) as load_mw, round((hour(time_utc) - mh) / sh, 6) as hour, 0.0::double as flat
        from valid, m""",
)
def _(spark, sf):
    from tidewatt.models.preprocess import fit_scaler

    train, valid = (
        d.select("region", "time_utc", "load_mw", F.hour("time_utc").cast("double").alias("hour"), F.lit(3.0).alias("flat"))
        for d in split(spark, sf)
    )
    names = ["load_mw", "hour", "flat"]
    scaled = fit_scaler(train, names)(valid)
    return scaled.withColumns({c: F.round(c, 6) for c in names})


@query(
    "region_onehot",
    f"""with {SPLIT} select region, time_utc, """
    + ", ".join(f"cast(region = '{r}' as int) as region_{r}" for r in ["click", "error", "purchase", "signup"])
    + " from valid",
)
def _(spark, sf):
    from tidewatt.models.preprocess import fit_onehot

    train, valid = split(spark, sf)
    return fit_onehot(train.where("region <> 'view'"), "region")(valid.select("region", "time_utc"))


@query(
    "target_scale",
    f"""with {SPLIT}, m as (select avg(load_mw) as mu, stddev_pop(load_mw) as sd from train)
        select region, time_utc, round((load_mw - mu) / sd, 6) as scaled, round(((load_mw - mu) / sd) * sd + mu, 4) as restored from valid, m""",
)
def _(spark, sf):
    from tidewatt.models.preprocess import fit_target_scale

    train, valid = split(spark, sf)
    scale = fit_target_scale(train, "load_mw")
    scaled = scale.apply(F.col("load_mw"))
    return valid.select(
        "region", "time_utc", F.round(scaled, 6).alias("scaled"), F.round(scale.invert(scaled), 4).alias("restored")
    )


@query(
    "clean_panel_coverage",
    f"""with {X.LAGGED}, u as (select * from lagged where load_mw is not null and load_previous_week is not null)
        select region, min(time_utc) as first_time_utc, max(time_utc) as last_time_utc, count(*) as rows,
        count(*) filter (load_mw is null) as missing_load_rows from u group by region""",
)
def _(spark, sf):
    from tidewatt.plans.flagship import clean_panel_coverage

    return clean_panel_coverage(spark, sf)
