"""File names, run directories, payloads, sheets, area feeds and links."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidewatt import constants as K
from tidewatt.functions import scalar as S
from tidewatt.operators import diagnose as D
from tidewatt.operators import evaluate as E
from tidewatt.operators import reconcile as R
from tidewatt.operators.panel import present_hours, reindex, region_spine
from tidewatt.operators.weather import load_long
from tidewatt.plans import fixtures as X
from tidewatt.plans.registry import query
from tidewatt.sources import area_load as A
from tidewatt.sources import files as SF
from tidewatt.sources import links as L
from tidewatt.sources import sheets as SH
from tidewatt.sources.weather_json import explode_hourly_json
from tidewatt.session import shared_dir

# ---- file names ---------------------------------------------------------------------------


@query(
    "file_span_parse",
    f"""with {X.SPANS} select file_name, strftime(span_start, '%Y-%m-%d') as start_date, strftime(span_end, '%Y-%m-%d') as end_date,
        cast(span_end >= span_start as int) as span_ok from spans""",
)
def _(spark, sf):
    out = SF.with_file_span(X.files(spark, sf).select("file_name"), on_reversed="flag")
    return out.withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in ("start_date", "end_date")})


@query(
    "file_span_total",
    f"""with {X.SPANS} select strftime(min(span_start), '%Y-%m-%d') as start_date, strftime(max(span_end), '%Y-%m-%d') as end_date,
        'caiso_dataset_' || strftime(min(span_start), '%Y%m%d') || '_to_' || strftime(max(span_end), '%Y%m%d') || '.csv' as file_name
        from spans where span_end >= span_start""",
)
def _(spark, sf):
    spans = SF.with_file_span(X.files(spark, sf), on_reversed="flag").where("span_ok = 1")
    out = SF.infer_span(spans)
    return out.withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in ("start_date", "end_date")})


RUN_NAMES = X.RUN_FILES + """, named as (
  select *, replace(replace(lower(trim(regexp_extract(file_name, '^(.+)_(\\d{4}-\\d{2})_(metrics|predictions)\\.csv$', 1))), ' ', '_'), '-', '_') as model,
         regexp_extract(file_name, '^(.+)_(\\d{4}-\\d{2})_(metrics|predictions)\\.csv$', 2) as month,
         regexp_extract(file_name, '^(.+)_(\\d{4}-\\d{2})_(metrics|predictions)\\.csv$', 3) as kind
  from run_files where regexp_matches(file_name, '^(.+)_(\\d{4}-\\d{2})_(metrics|predictions)\\.csv$'))"""


@query("run_name_parse", f"with {RUN_NAMES} select file_id, row_no, file_name, model, month, kind from named")
def _(spark, sf):
    return SF.with_run_name(X.run_files(spark, sf).select("file_id", "row_no", "file_name"))


@query(
    "run_stem_model",
    f"""with {X.RUN_FILES} select distinct file_name, replace(replace(regexp_replace(regexp_replace(regexp_replace(lower(file_name), '\\.csv$', ''),
        '_metrics$', ''), '_predictions$', ''), ' ', '_'), '-', '_') as model from run_files""",
)
def _(spark, sf):
    names = X.run_files(spark, sf).select("file_name").distinct()
    return names.withColumn("model", SF.model_from_stem(F.col("file_name")))


@query(
    "runs_classify",
    f"""with {RUN_NAMES}, f as (select distinct on (file_name) * from named order by file_name, file_id, row_no),
        good as (select * from f where kind = 'metrics' or (list_contains(header, 'time_utc') and list_contains(header, 'actual_load_mw')
          and list_contains(header, 'predicted_load_mw')))
        select model, month, kind, file_name from good
        qualify row_number() over (partition by model, month, kind order by file_name desc) = 1""",
)
def _(spark, sf):
    from tidewatt.operators.ordered import pick_one

    listed = pick_one(X.run_files(spark, sf), ["file_name"], [F.col("file_id"), F.col("row_no")])
    return SF.classify_run_files(listed).select("model", "month", "kind", "file_name")


@query(
    "model_files_classify",
    f"""with {X.RUN_FILES}, f as (select distinct on (file_name) * from run_files order by file_name, file_id, row_no),
        k as (select file_name, replace(replace(regexp_replace(regexp_replace(regexp_replace(lower(file_name), '\\.csv$', ''),
          '_metrics$', ''), '_predictions$', ''), ' ', '_'), '-', '_') as model,
          case when list_contains(header, 'model') and (list_contains(header, 'RMSE') or list_contains(header, 'MAE')) then 'metrics'
               when list_contains(header, 'time_utc') and list_contains(header, 'actual_load_mw') and list_contains(header, 'predicted_load_mw')
               then 'predictions' end as kind from f)
        select model, kind, file_name from k where kind is not null
        qualify row_number() over (partition by model, kind order by file_name desc) = 1""",
)
def _(spark, sf):
    from tidewatt.operators.ordered import pick_one

    listed = pick_one(X.run_files(spark, sf), ["file_name"], [F.col("file_id"), F.col("row_no")])
    return SF.classify_model_files(listed).select("model", "kind", "file_name")


@query(
    "metrics_table",
    f"""with {RUN_NAMES} select model, month, strptime(month, '%Y-%m') as month_ts, file_name, amount / 100 as "RMSE"
        from named where kind = 'metrics'
        qualify row_number() over (partition by model, month order by file_name desc, file_id, row_no) = 1""",
)
def _(spark, sf):
    rows = X.run_files(spark, sf).select(
        "file_name",
        F.struct("file_id", "row_no").alias("row_no"),
        (F.col("amount") / 100).alias("RMSE"),
        F.lit("x").alias("model"),
        F.lit("x").alias("month"),
    )
    return E.metrics_table(rows).select("model", "month", "month_ts", "file_name", "RMSE")


@query(
    "month_coverage",
    f"""with {X.SPANS}, ok as (select distinct file_name, span_start, span_end from spans where span_end >= span_start),
        e as (select date_trunc('month', min(span_start)) as a, date_trunc('month', max(span_end)) as b from ok),
        m as (select unnest(generate_series(a, b, interval 1 month)) as month_start from e)
        select m.month_start, count(ok.file_name) as covering_files, min(ok.file_name) as first_file from m
        left join ok on ok.span_start <= m.month_start + interval 1 month - interval 1 hour and ok.span_end >= m.month_start
        group by 1""",
)
def _(spark, sf):
    ok = SF.with_file_span(X.files(spark, sf).select("file_name"), on_reversed="flag").where("span_ok = 1").distinct()
    spans = ok.select(
        "file_name", F.col("start_date").cast("timestamp").alias("span_start"), F.col("end_date").cast("timestamp").alias("span_end")
    )
    return (
        SH.month_coverage(spans, SH.month_starts(spans))
        .groupBy("month_start")
        .agg(F.count("file_name").alias("covering_files"), F.min("file_name").alias("first_file"))
    )


# ---- weather payloads ---------------------------------------------------------------------


@query(
    "weather_json_explode",
    f"""with {X.PANEL} select region, date_trunc('day', time_utc) as day, time_utc, load_mw as temperature_2m,
        null::double as precipitation, cast(ord as double) as cloud_cover from panel""",
)
def _(spark, sf):
    return explode_hourly_json(X.payloads(spark, sf), variables=["temperature_2m", "precipitation", "cloud_cover"])


# ---- sheets -------------------------------------------------------------------------------

HEADER = X.SHEET_CELLS + """, cell as (
  select workbook, sheet, row_idx, generate_subscripts(cells, 1) as position, unnest(cells) as raw from sheet_cells where row_idx < 80),
canon as (
  select *, trim(regexp_replace(regexp_replace(lower(trim(raw)), '[_\\-/]+', ' ', 'g'), '\\s+', ' ', 'g')) as norm from cell),
named as (
  select *, case when norm in ('date', 'opr dt', 'opr date', 'trading date', 'trade date', 'market date') then 'date'
                 when norm in ('hr', 'hour', 'opr hr', 'he', 'hour ending', 'he hour') then 'hr'
                 when norm in ('pge', 'pge tac', 'pg&e', 'pg&e tac') then 'pge' when norm in ('sce', 'sce tac') then 'sce'
                 when norm in ('sdge', 'sdg&e', 'sdge tac', 'sdg&e tac') then 'sdge' when norm in ('mwd', 'mwd tac') then 'mwd'
                 when norm in ('caiso', 'total', 'system') then 'caiso' end as canonical from canon),
header as (
  select workbook, sheet, min(row_idx) as header_row from (
    select workbook, sheet, row_idx from named group by 1, 2, 3
    having count(*) filter (canonical = 'date') > 0 and count(*) filter (canonical = 'hr') > 0) group by 1, 2)"""

# Market wall clock to UTC by the US rule: 7 hours from the second Sunday of March 03:00 to the
# first Sunday of November 02:00, else 8.
MARKET = """case when wall >= date_trunc('year', wall) + interval 2 month
    + to_days(cast((7 - isodow(date_trunc('year', wall) + interval 2 month)) % 7 + 7 as int)) + interval 3 hour
  and wall < date_trunc('year', wall) + interval 10 month
    + to_days(cast((7 - isodow(date_trunc('year', wall) + interval 10 month)) % 7 as int)) + interval 2 hour
  then wall + interval 7 hour else wall + interval 8 hour end"""

SHEET_LOAD = HEADER + f""", body as (
  select s.workbook, s.sheet, s.row_idx,
    case when try_cast(cells[1] as double) is not null then timestamp '1899-12-30' + to_days(cast(try_cast(cells[1] as double) as int))
         else coalesce(try_cast(cells[1] as timestamp), try_strptime(cells[1], '%m/%d/%Y')) end as day,
    cast(try_cast(cells[2] as double) as int) as hr, cells[3] as v3, cells[4] as v4
  from sheet_cells s join header h on h.workbook = s.workbook and h.sheet = s.sheet and s.row_idx > h.header_row),
walls as (select *, day + to_hours(hr - 1) as wall from body where day is not null and hr is not null),
timed as (
  select workbook, sheet, row_idx, {MARKET} as time_utc,
    case when sheet = 's1' then try_cast(v4 as double) end as caiso,
    case when sheet = 's0' then try_cast(v3 as double) end as pge,
    case when sheet = 's0' then try_cast(v4 as double) end as sce,
    case when sheet = 's1' then try_cast(v3 as double) end as sdge,
    case when sheet = 's2' then try_cast(v3 as double) end as mwd,
    case sheet when 's2' then case when workbook = 'click' then '' else 'mwd' end when 's1' then 'caiso,sdge' else 'pge,sce' end as load_cols
  from walls),
loaded as (
  select * from timed where load_cols <> '' qualify row_number() over (partition by workbook, sheet, time_utc order by row_idx) = 1),
sized as (select workbook, sheet, case when load_cols = '' then 0 else len(string_split(load_cols, ',')) end as n_load_cols, count(*) as sheet_rows
          from loaded group by 1, 2, load_cols),
best as (select * from sized qualify row_number() over (partition by workbook order by n_load_cols desc, sheet_rows desc, sheet) = 1)"""


@query("sheet_header_row", f"with {HEADER} select workbook, sheet, header_row from header")
def _(spark, sf):
    return SH.find_header(X.sheet_cells(spark, sf)).select("workbook", "sheet", "header_row")


@query(
    "alias_rename",
    f"""with {HEADER} select n.workbook, n.sheet, cast(n.position - 1 as int) as position, n.raw, n.canonical
        from named n join header h on h.workbook = n.workbook and h.sheet = n.sheet and h.header_row = n.row_idx""",
)
def _(spark, sf):
    return SH.header_names(X.sheet_cells(spark, sf))


@query(
    "sheet_to_load",
    f"with {SHEET_LOAD} select workbook, sheet, time_utc, caiso, pge, sce, sdge, null::double as vea, mwd from loaded",
)
def _(spark, sf):
    return SH.parse_sheets(X.sheet_cells(spark, sf)).drop("n_load_cols")


@query("best_sheet", f"with {SHEET_LOAD} select workbook, sheet, cast(n_load_cols as int) as n_load_cols, sheet_rows from best")
def _(spark, sf):
    return SH.best_sheets(SH.parse_sheets(X.sheet_cells(spark, sf)))


@query(
    "merge_parts_coalesce",
    f"""with {SHEET_LOAD}, p as (select l.* from loaded l join best b on b.workbook = l.workbook and b.sheet = l.sheet)
        select time_utc, """
    + ", ".join(
        f"arg_min({r}, workbook) filter ({r} is not null) as {r}" if r != "vea" else "null::double as vea" for r in K.REGIONS
    )
    + " from p group by 1",
)
def _(spark, sf):
    return SH.merge_workbooks(X.sheet_cells(spark, sf))


SHEET_AUDIT = SHEET_LOAD + """, sheet_stats as (
  select workbook, sheet, load_cols, count(*) as n, min(time_utc) as t0, max(time_utc) as t1 from timed group by 1, 2, 3),
audited as (
  select s.workbook, s.sheet, case when h.header_row is null then 'no_header_row_found' when t.n is null then 'empty_after_date_hr_cleaning'
      when t.load_cols = '' then 'no_recognized_load_columns' else 'ok' end as reason, t.load_cols, t.n, t.t0, t.t1
  from (select distinct workbook, sheet from sheet_cells) s left join header h on h.workbook = s.workbook and h.sheet = s.sheet
  left join sheet_stats t on t.workbook = s.workbook and t.sheet = s.sheet),
audit as (
  select workbook, sheet, case when reason = 'ok' then 'parsed' else 'skipped' end as status, reason,
    case when reason = 'ok' then n else 0 end as rows, case when reason = 'ok' then load_cols else '' end as load_cols,
    case when reason = 'ok' then t0 end as min_time_utc, case when reason = 'ok' then t1 end as max_time_utc from audited)"""


@query("sheet_audit", f"with {SHEET_AUDIT} select * from audit")
def _(spark, sf):
    return SH.sheet_audit(X.sheet_cells(spark, sf))


@query(
    "workbook_audit",
    f"""with {SHEET_AUDIT}, b as (select * from audit where status = 'parsed'
          qualify row_number() over (partition by workbook order by len(string_split(load_cols, ',')) desc, rows desc, sheet) = 1),
        t as (select workbook, count(*) as num_sheets, count(*) filter (status = 'parsed') as num_parsed_sheets from audit group by 1)
        select t.workbook, num_sheets, num_parsed_sheets, b.sheet as best_sheet, coalesce(b.load_cols, '') as best_load_cols,
        coalesce(b.rows, 0) as best_rows, b.min_time_utc as best_min_time_utc, b.max_time_utc as best_max_time_utc
        from t left join b on b.workbook = t.workbook""",
)
def _(spark, sf):
    return SH.workbook_audit(SH.sheet_audit(X.sheet_cells(spark, sf)))


NAMES = """name_cells as (
  select event_id, event_type || case event_id % 4 when 0 then ' _TAC-/Area ' when 1 then '  Load (MW)' when 2 then '__HE/hour--' else '-X__y ' end as raw from events)"""


def name_cells(spark, sf):
    tail = F.element_at(
        F.array(F.lit(" _TAC-/Area "), F.lit("  Load (MW)"), F.lit("__HE/hour--"), F.lit("-X__y ")), (F.col("event_id") % 4).cast("int") + 1
    )
    return X.table(spark, sf, "events").select("event_id", F.concat("event_type", tail).alias("raw"))


@query(
    "norm_header",
    f"""with {NAMES} select event_id, raw, trim(regexp_replace(regexp_replace(lower(trim(raw)), '[_\\-/]+', ' ', 'g'), '\\s+', ' ', 'g')) as norm from name_cells""",
)
def _(spark, sf):
    return name_cells(spark, sf).withColumn("norm", S.norm_header(F.col("raw")))


@query(
    "norm_snake",
    f"""with {NAMES} select event_id, raw, trim(regexp_replace(regexp_replace(lower(trim(raw)), '[\\s\\-/]+', '_', 'g'), '_+', '_', 'g'), '_') as norm from name_cells""",
)
def _(spark, sf):
    return name_cells(spark, sf).withColumn("norm", S.norm_snake(F.col("raw")))


@query(
    "coerce_date",
    """select event_id, case event_id % 4 when 0 then timestamp '1899-12-30' + to_days(cast(45000 + event_id % 1000 as int)) + interval 12 hour
         when 1 then date_trunc('day', ts) when 2 then date_trunc('day', ts) end as parsed from events""",
)
def _(spark, sf):
    text = (
        F.when(F.col("event_id") % 4 == 0, F.concat((F.col("event_id") % 1000 + 45000).cast("string"), F.lit(".5")))
        .when(F.col("event_id") % 4 == 1, F.date_format("ts", "yyyy-MM-dd"))
        .when(F.col("event_id") % 4 == 2, F.date_format("ts", "M/d/yyyy"))
        .otherwise(F.lit("not a date"))
    )
    return X.table(spark, sf, "events").select("event_id", S.coerce_date(text).alias("parsed"))


# ---- area feeds ---------------------------------------------------------------------------

AREA = X.AREA_LONG + """, named as (
  select *, case tac_area_name when 'PGE-TAC' then 'pge' when 'SCE-TAC' then 'sce' when 'sdg&e tac' then 'sdge' when 'VEA_TAC North' then 'vea' end as region,
         try_strptime(interval_start_gmt, '%Y-%m-%d %H:%M:%S') as time_utc, try_cast(mw as double) as load_mw from area_long),
std as (select event_id, time_utc, region, load_mw from named where time_utc is not null and region is not null and load_mw is not null),
wide as (select time_utc, """ + ", ".join(
    f"arg_max(load_mw, event_id) filter (region = '{r}') as {r}" for r in K.AREA_REGIONS
) + " from std group by 1)"


def area_std(spark, sf):
    return A.standardize_area_long(X.area_feed(spark, sf), keep=("event_id",))


@query("area_long_std", f"with {AREA} select * from std")
def _(spark, sf):
    return area_std(spark, sf)


LOCAL = "America/Los_Angeles"


@query(
    "area_local_std",
    f"""with {AREA} select event_id, timezone('UTC', timezone('{LOCAL}', timezone('{LOCAL}', timezone('UTC', time_utc)))) as time_utc, region, load_mw from std""",
)
def _(spark, sf):
    """The feed by local starts: every third row tells its offset, the others are market time."""
    feed = X.area_feed(spark, sf)
    utc = F.col("Interval Start UTC").try_cast("timestamp")
    local = F.from_utc_timestamp(utc, LOCAL)
    hours = (F.unix_timestamp(utc) - F.unix_timestamp(local)) / 3600
    told = F.concat(F.date_format(local, "yyyy-MM-dd HH:mm:ss"), F.format_string("-%02d:00", hours.cast("int")))
    text = F.when(F.col("event_id") % 3 == 0, told).otherwise(F.date_format(local, "yyyy-MM-dd HH:mm:ss"))
    renamed = feed.withColumn("Interval Start Local", F.coalesce(text, F.lit("bad"))).drop("Interval Start UTC")
    return A.standardize_area_long(renamed, keep=("event_id",))


@query(
    "area_wide_total",
    f"""with {AREA}, told as (select time_utc, arg_max(load_mw, event_id) as caiso from named
          where tac_area_name = 'CA ISO-TAC' and time_utc is not null and load_mw is not null group by 1)
        select time_utc, pge, sce, sdge, vea, mwd, caiso from wide full join told using (time_utc)""",
)
def _(spark, sf):
    """A feed that reports its own total, which is then not summed."""
    feed = X.area_feed(spark, sf)
    area = next(c for c in feed.columns if "tac" in c.lower())
    named = feed.withColumn(area, F.when(F.col(area) == "CA ISO-TAC", F.lit("Total")).otherwise(F.col(area)))
    return A.area_feed_to_wide(named, "event_id")


@query(
    "panel_files_read",
    f"""with {X.PANEL} select region, time_utc, load_mw, case when hour(time_utc) % 3 = 2 then 'x, y' end as "note, of the feed" from panel""",
)
def _(spark, sf):
    """The panel written as CSV files of three headers, one with a comma in a name, and read back by their headers."""
    folder = f"{shared_dir(spark)}/panel-files-{uuid.uuid4().hex}"
    rows = X.panel(spark, sf).withColumn("note, of the feed", F.lit("x, y")).withColumn("time_utc_text", F.date_format("time_utc", "yyyy-MM-dd HH:mm:ss"))
    shapes = [["region", "time_utc", "load_mw"], ["load_mw", "time_utc", "region"], ["time_utc", "note, of the feed", "region", "load_mw"]]
    for k, columns in enumerate(shapes):
        own = rows.where(F.hour("time_utc") % 3 == k).drop("time_utc").withColumnRenamed("time_utc_text", "time_utc")
        own.select(*[f"`{c}`" for c in columns]).write.option("header", True).csv(f"{folder}/shape-{k}")
    paths = [f"{folder}/shape-{k}" for k in range(len(shapes))]
    read = SF.parse_panel(SF.read_by_header(spark, paths, SF.read_headers(spark, paths)))
    return read.select("region", "time_utc", "load_mw", "note, of the feed")


@query(
    "dayahead_std",
    f"""with {X.AREA_LONG} select event_id, try_strptime(interval_start_gmt, '%Y-%m-%d %H:%M:%S') as time_utc,
        case tac_area_name when 'PGE-TAC' then 'pge' when 'SCE-TAC' then 'sce' else 'caiso' end as region, try_cast(mw as double) as load_mw
        from area_long where tac_area_name in ('PGE-TAC', 'SCE-TAC', 'CA ISO-TAC') and interval_start_gmt <> 'bad'""".replace("select event_id, ", "select "),
)
def _(spark, sf):
    return day_ahead(spark, sf)


def day_ahead(spark, sf):
    return A.standardize_day_ahead(
        X.area_long(spark, sf).select(
            F.col("interval_start_gmt").alias("INTERVALSTARTTIME_GMT"), F.col("tac_area_name").alias("TAC_AREA_NAME"), F.col("mw").alias("MW")
        )
    )


@query(
    "area_to_region",
    """select event_id, case event_type when 'click' then 'pge' when 'view' then 'sdge' when 'purchase' then 'caiso'
         when 'signup' then 'mwd' end as region from events""",
)
def _(spark, sf):
    kind = F.col("event_type")
    name = (
        F.when(kind == "click", " PG&E_TAC")
        .when(kind == "view", "SDG&E North")
        .when(kind == "purchase", "System")
        .when(kind == "signup", "MWD/TAC")
        .otherwise("CA ISO-TAC")
    )
    return X.table(spark, sf, "events").select("event_id", S.area_to_region(name).alias("region"))


@query("coerce_numeric", f"with {X.AREA_LONG} select event_id, try_cast(mw as double) as mw from area_long")
def _(spark, sf):
    return X.area_long(spark, sf).select("event_id", S.coerce_numeric(F.col("mw")).alias("mw"))


@query(
    "market_to_utc",
    f"""with {X.AREA_LONG}, w as (select event_id, market_date + to_hours(hour_ending - 1) as wall from area_long)
        select event_id, wall as market_time, {MARKET} as time_utc from w""",
)
def _(spark, sf):
    rows = X.area_long(spark, sf)
    wall = F.timestamp_seconds(F.unix_timestamp("market_date") + (F.col("hour_ending") - 1) * 3600)
    return rows.select(
        "event_id", wall.alias("market_time"), S.hour_ending_to_utc(F.col("market_date"), F.col("hour_ending")).alias("time_utc")
    )


@query(
    "pivot_last",
    f"with {AREA} select time_utc, null::double as caiso, pge, sce, sdge, vea, null::double as mwd from (select *, 1 from wide) x".replace(
        "select *, 1 from wide", "select time_utc, pge, sce, sdge, vea from wide"
    ),
)
def _(spark, sf):
    return R.pivot_last(area_std(spark, sf), "load_mw", "event_id")


@query(
    "synth_total",
    f"""with {AREA} select time_utc, pge, sce, sdge, vea, mwd, case when coalesce(pge, sce, sdge, vea, mwd) is not null then
        coalesce(pge, 0) + coalesce(sce, 0) + coalesce(sdge, 0) + coalesce(vea, 0) + coalesce(mwd, 0) end as caiso from wide""",
)
def _(spark, sf):
    return R.with_total(R.pivot_last(area_std(spark, sf), "load_mw", "event_id", K.AREA_REGIONS))


DAY_AHEAD = X.AREA_LONG + """, da as (
  select try_strptime(interval_start_gmt, '%Y-%m-%d %H:%M:%S') as time_utc, case tac_area_name when 'PGE-TAC' then 'pge'
    when 'SCE-TAC' then 'sce' else 'caiso' end as region, try_cast(mw as double) as load_mw
  from area_long where tac_area_name in ('PGE-TAC', 'SCE-TAC', 'CA ISO-TAC') and interval_start_gmt <> 'bad')"""


@query(
    "pivot_mean",
    f"with {DAY_AHEAD} select time_utc, "
    + ", ".join(f"round(avg(load_mw) filter (region = '{r}'), 6) as {r}" for r in K.REGIONS)
    + " from da group by 1",
)
def _(spark, sf):
    wide = R.pivot_mean(day_ahead(spark, sf), "load_mw")
    return wide.withColumns({r: F.round(r, 6) for r in K.REGIONS})


@query(
    "present_hours",
    f"""with {DAY_AHEAD}, m as (select time_utc, region, avg(load_mw) as v from da group by 1, 2)
        select r.region, count(m.v) as present_hours from (select unnest(['caiso', 'pge', 'sce', 'sdge', 'vea', 'mwd']) as region) r
        left join m on m.region = r.region group by 1""",
)
def _(spark, sf):
    wide = R.pivot_mean(day_ahead(spark, sf), "load_mw")
    return present_hours(load_long(wide))


@query(
    "load_long_spine",
    f"""with {AREA}, long as (unpivot wide on pge, sce, sdge, vea into name region value load_mw),
        e as (select date_trunc('day', min(time_utc)) as a, date_trunc('day', max(time_utc)) + interval 23 hour as b from wide),
        h as (select unnest(generate_series(a, b, interval 1 hour)) as time_utc from e),
        g as (select h.time_utc, r.region from h, (select unnest(['pge', 'sce', 'sdge', 'vea']) as region) r)
        select g.region, g.time_utc, l.load_mw from g left join long l on l.region = g.region and l.time_utc = g.time_utc""",
)
def _(spark, sf):
    """Wide load to (region, hour) rows on the full spine."""
    areas = ["pge", "sce", "sdge", "vea"]
    long = load_long(R.pivot_last(area_std(spark, sf), "load_mw", "event_id", areas), areas)
    return reindex(long, region_spine(long))


@query(
    "offset_distribution",
    f"""with {X.AREA_LONG}, w as (select *, market_date + to_hours(hour_ending - 1) as wall from area_long),
        o as (select wall, case when mw <> 'n/a' then {MARKET} end as time_utc from w)
        select date_diff('second', time_utc, wall) / 3600.0 as utc_offset_hours, count(*) as rows from o group by 1""".replace(
        "/ 3600.0 as", "/ 3600.0::double as"
    ),
)
def _(spark, sf):
    rows = X.area_long(spark, sf)
    wall = F.timestamp_seconds(F.unix_timestamp("market_date") + (F.col("hour_ending") - 1) * 3600)
    utc = F.when(F.col("mw") != "n/a", S.market_to_utc(wall))
    return D.offset_distribution(rows, wall, utc)


# ---- links --------------------------------------------------------------------------------


@query(
    "html_links",
    r"""with m as (select page_id, url, regexp_extract(url, '^([A-Za-z]+://[^/?#]+)', 1) as root,
          regexp_extract_all(html, 'href\s*=\s*"([^"]+)"', 1, 'i') || regexp_extract_all(html, 'href\s*=\s*''([^'']+)''', 1, 'i') as hrefs from pages),
        h as (select page_id, url, root, generate_subscripts(hrefs, 1) as pos, unnest(hrefs) as href from m),
        l as (select page_id, url, pos, case when regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.\-]*:') then href
             when href like '//%' then regexp_extract(root, '^([A-Za-z]+:)', 1) || href
             when href like '/%' then root || href else root || '/' || href end as link from h),
        d as (select page_id, url, link, min(pos) as pos from l group by 1, 2, 3)
        select page_id, url, link, cast(row_number() over (partition by page_id order by pos) - 1 as int) as link_no from d""",
)
def _(spark, sf):
    return L.extract_links(X.table(spark, sf, "pages"), extension="")


@query(
    "link_year_filter",
    r"""with l as (select page_id, url || '/load' || case when page_id % 5 = 0 then '' else '-' || (2012 + page_id % 17) end || '.xlsx' as link from pages)
        select page_id, link from l where len(regexp_extract_all(link, '(?:19|20)\d{2}')) = 0
        or len(list_filter(regexp_extract_all(link, '(?:19|20)\d{2}'), lambda y: cast(y as int) between 2018 and 2022)) > 0""",
)
def _(spark, sf):
    n = F.col("page_id")
    year = F.when(n % 5 == 0, "").otherwise(F.concat(F.lit("-"), (n % 17 + 2012).cast("string")))
    links = X.table(spark, sf, "pages").select("page_id", F.concat("url", F.lit("/load"), year, F.lit(".xlsx")).alias("link"))
    return links.where(L.link_relevant(F.col("link"), 2018, 2022))
