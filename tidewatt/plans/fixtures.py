"""The engine's inputs derived from a folder of star-schema tables.

Each frame has an SQL twin (a CTE of the same name). Money and values become
integer hundredths before they are summed, so sums are exact on both sides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatt.functions import scalar as S
from tidewatt.operators import panel as P
from tidewatt.sources.weather_json import pack_hourly_json


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    # Naive times mean UTC; the session is pinned to it.
    return df.withColumns({f.name: F.col(f.name).cast("timestamp") for f in df.schema if f.dataType.typeName() == "timestamp_ntz"})


def cents(col: str) -> Column:
    return F.round(F.col(col) * 100).cast("bigint")


def hour_of(col: str = "ts") -> Column:
    return F.date_trunc("hour", F.col(col))


# ---- F1: hourly panel with gaps and missing load ------------------------------------------

PANEL = """panel as (
  select event_type as region, date_trunc('hour', ts) as time_utc, min(event_id) as ord,
         case when min(event_id) % 11 = 0 then null
              else cast(sum(cast(round(value * 100) as bigint)) as double) / 100 end as load_mw
  from events group by 1, 2)"""


def panel(spark: SparkSession, folder: str) -> DataFrame:
    return (
        table(spark, folder, "events")
        .groupBy(F.col("event_type").alias("region"), hour_of().alias("time_utc"))
        .agg(F.min("event_id").alias("ord"), F.sum(cents("value")).alias("c"))
        .select(
            "region",
            "time_utc",
            "ord",
            F.when(F.col("ord") % 11 == 0, None).otherwise(F.col("c").cast("double") / 100).alias("load_mw"),
        )
    )


LAGGED = PANEL + """, lagged as (
  select p.region, p.time_utc, p.ord, p.load_mw, h.load_mw as load_previous_week
  from panel p left join panel h on h.region = p.region and h.time_utc + interval 7 day = p.time_utc)"""


def lagged(spark: SparkSession, folder: str) -> DataFrame:
    return P.with_week_lag(panel(spark, folder))


# ---- F1p: overlapping parts ---------------------------------------------------------------

PARTS = """parts as (
  select cast(event_id % 2 as int) as part_no, event_type as region, date_trunc('hour', ts) as time_utc,
         case when min(event_id) % 7 = 0 then null
              else cast(sum(cast(round(value * 100) as bigint)) as double) / 100 end as load_mw,
         min(event_id) as row_ord
  from events group by 1, 2, 3)"""


def parts(spark: SparkSession, folder: str) -> DataFrame:
    return parts_of(table(spark, folder, "events"))


def parts_of(events: DataFrame) -> DataFrame:
    return (
        events.groupBy(
            (F.col("event_id") % 2).cast("int").alias("part_no"),
            F.col("event_type").alias("region"),
            hour_of().alias("time_utc"),
        )
        .agg(F.sum(cents("value")).alias("c"), F.min("event_id").alias("row_ord"))
        .select(
            "part_no",
            "region",
            "time_utc",
            F.when(F.col("row_ord") % 7 == 0, None).otherwise(F.col("c").cast("double") / 100).alias("load_mw"),
            "row_ord",
        )
    )


# ---- F2: station weather on a full grid ---------------------------------------------------

STATION_WEATHER = """days as (select min(date_trunc('day', ts)) as d0, max(date_trunc('day', ts)) as d1 from events),
grid as (
  select r.event_type as region, s.station_id, d.day + to_hours(cast(6 * k.slot as int)) as time_utc
  from (select distinct event_type from events) r,
       (select unnest(range(0, 5)) as station_id) s,
       (select unnest(generate_series(d0, d1, interval 1 day)) as day from days) d,
       (select unnest(range(0, 4)) as slot) k),
cells as (
  select event_type as region, user_id % 5 as station_id,
         date_trunc('day', ts) + to_hours(cast(6 * (hour(ts) // 6) as int)) as time_utc,
         cast(sum(cast(round(value * 100) as bigint)) as double) / 100 / count(*) as temperature_2m,
         cast(min(event_id) % 101 as double) as cloud_cover
  from events group by 1, 2, 3),
station_weather as (
  select g.region, g.station_id, g.time_utc, c.temperature_2m,
         case when c.cloud_cover < 90 then c.cloud_cover end as cloud_cover
  from grid g left join cells c on c.region = g.region and c.station_id = g.station_id and c.time_utc = g.time_utc)"""


def station_weather(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events")
    first = events.agg(F.date_trunc("day", F.min("ts"))).scalar()
    last = events.agg(F.date_trunc("day", F.max("ts"))).scalar()
    grid = (
        events.select(F.col("event_type").alias("region"))
        .distinct()
        .select("region", F.explode(F.sequence(first, last, F.expr("interval 1 day"))).alias("day"))
        .select("region", "day", F.explode(F.expr("sequence(0L, 4L)")).alias("station_id"))
        .select(
            "region",
            "station_id",
            F.explode(F.expr("sequence(day, day + interval 18 hours, interval 6 hours)")).alias("time_utc"),
        )
    )
    slot = F.timestamp_seconds(F.floor(F.unix_timestamp("ts") / 21600) * 21600)
    cells = (
        events.groupBy(
            F.col("event_type").alias("region"), (F.col("user_id") % 5).alias("station_id"), slot.alias("time_utc")
        )
        .agg(
            (F.sum(cents("value")).cast("double") / 100 / F.count("*")).alias("temperature_2m"),
            (F.min("event_id") % 101).cast("double").alias("c"),
        )
        .select("region", "station_id", "time_utc", "temperature_2m", F.when(F.col("c") < 90, F.col("c")).alias("cloud_cover"))
    )
    return grid.join(cells, ["region", "station_id", "time_utc"], "left")


STATION_WEIGHTS = """station_weights as (
  select distinct region, station_id, cast(station_id as double) as raw_weight from station_weather)"""


def station_weights(spark: SparkSession, folder: str) -> DataFrame:
    """Raw weights 0 to 4 of the grid's stations."""
    return (
        table(spark, folder, "events")
        .select(F.col("event_type").alias("region"))
        .distinct()
        .select("region", F.explode(F.expr("sequence(0L, 4L)")).alias("station_id"))
        .withColumn("raw_weight", F.col("station_id").cast("double"))
    )


# ---- F3: station populations --------------------------------------------------------------

STATIONS = """stations as (
  select r_name as region, s_name as station_name,
         cast(round(s_acctbal * 100) as bigint) - 300000 as population_est,
         30.0 + s_suppkey % 20 as latitude, -120.0 + s_suppkey % 7 as longitude
  from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey)"""


def stations(spark: SparkSession, folder: str) -> DataFrame:
    return (
        table(spark, folder, "supplier")
        .join(table(spark, folder, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            F.col("r_name").alias("region"),
            F.col("s_name").alias("station_name"),
            (cents("s_acctbal") - 300000).alias("population_est"),
            (F.lit(30.0) + F.col("s_suppkey") % 20).alias("latitude"),
            (F.lit(-120.0) + F.col("s_suppkey") % 7).alias("longitude"),
        )
    )


# ---- F4: predictions of several models, in whole megawatts so that sums are exact ---------

PREDICTIONS = """predictions as (
  select l_returnflag || l_linestatus as model, cast(l_linenumber as varchar) as region,
         l_shipdate + to_hours(cast(l_suppkey % 24 as int)) as time_utc,
         case when l_linenumber = 7 then 0.0 else floor(l_extendedprice) end as actual_load_mw,
         floor(l_extendedprice * (1 - l_discount + l_tax)) as predicted_load_mw,
         l_orderkey as ord
  from lineitem)"""


def predictions(spark: SparkSession, folder: str) -> DataFrame:
    at = F.timestamp_seconds(F.unix_timestamp("l_shipdate") + (F.col("l_suppkey") % 24) * 3600)
    return table(spark, folder, "lineitem").select(
        F.concat("l_returnflag", "l_linestatus").alias("model"),
        F.col("l_linenumber").cast("string").alias("region"),
        at.alias("time_utc"),
        F.when(F.col("l_linenumber") == 7, 0.0).otherwise(F.floor("l_extendedprice").cast("double")).alias("actual_load_mw"),
        F.floor(F.col("l_extendedprice") * (1 - F.col("l_discount") + F.col("l_tax"))).cast("double").alias("predicted_load_mw"),
        F.col("l_orderkey").alias("ord"),
    )


# ---- F5: daily panel over many years ------------------------------------------------------

DAILY = """daily as (
  select o_orderpriority as region, o_orderdate + interval 25 year as time_utc,
         cast(sum(cast(round(o_totalprice * 100) as bigint)) as double) / 100 as load_mw
  from orders group by 1, 2)"""


def daily(spark: SparkSession, folder: str) -> DataFrame:
    return (
        table(spark, folder, "orders")
        .groupBy(
            F.col("o_orderpriority").alias("region"),
            (F.col("o_orderdate") + F.expr("INTERVAL 25 YEARS")).alias("time_utc"),
        )
        .agg((F.sum(cents("o_totalprice")).cast("double") / 100).alias("load_mw"))
    )


# ---- F6: workbook sheets ------------------------------------------------------------------

_SHEET_NO = "cast(user_id % 3 as int)"

SHEET_CELLS = f"""sheet_source as (
  select event_id, event_type as workbook, {_SHEET_NO} as sheet_no, ts, cast(round(value * 100) as bigint) as c from events),
sheet_list as (select distinct workbook, sheet_no from sheet_source),
sheet_cells as (
  select workbook, 's' || sheet_no as sheet, cast(0 as bigint) as row_idx, ['Hourly load', '', '', ''] as cells from sheet_list
  union all
  select workbook, 's' || sheet_no, cast(2 + sheet_no as bigint),
    case sheet_no when 0 then ['OPR_DATE', 'HE', 'PG&E TAC', 'SCE-TAC']
         when 1 then [' Trade Date', 'Hour', 'SDG&E-TAC', 'Total']
         else case when workbook = 'view' then ['Date', 'Notes', 'PGE', 'SCE']
              when workbook = 'click' then ['date', 'hr', 'foo', 'bar']
              else ['market/date', 'Hour  Ending', 'MWD', 'bar'] end end
  from sheet_list
  union all
  select workbook, 's' || sheet_no, 100 + event_id,
    [case when sheet_no = 1 then cast(date_diff('day', date '1899-12-30', cast(ts as date)) as varchar)
          when sheet_no = 0 and event_id % 5 = 0 then strftime(ts, '%m/%d/%Y')
          when event_id % 19 = 0 then 'total'
          else strftime(ts, '%Y-%m-%d') end,
     case when event_id % 13 = 0 then 'n/a' else cast(hour(ts) + 1 as varchar) end,
     case when event_id % 17 = 0 then 'n/a' else cast(c as varchar) end,
     case when event_id % 3 = 0 then '' else cast(c * 2 as varchar) end]
  from sheet_source)"""


def sheet_cells(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events").select(
        "event_id",
        F.col("event_type").alias("workbook"),
        (F.col("user_id") % 3).alias("n"),
        "ts",
        cents("value").alias("c"),
    )
    sheet = F.concat(F.lit("s"), F.col("n").cast("string")).alias("sheet")
    cells = lambda *texts: F.array(*[F.lit(t) for t in texts])
    listed = events.select("workbook", "n").distinct()
    titles = listed.select("workbook", sheet, F.lit(0).cast("bigint").alias("row_idx"), cells("Hourly load", "", "", "").alias("cells"))
    header = (
        F.when(F.col("n") == 0, cells("OPR_DATE", "HE", "PG&E TAC", "SCE-TAC"))
        .when(F.col("n") == 1, cells(" Trade Date", "Hour", "SDG&E-TAC", "Total"))
        .when(F.col("workbook") == "view", cells("Date", "Notes", "PGE", "SCE"))
        .when(F.col("workbook") == "click", cells("date", "hr", "foo", "bar"))
        .otherwise(cells("market/date", "Hour  Ending", "MWD", "bar"))
    )
    headers = listed.select("workbook", sheet, (F.col("n") + 2).alias("row_idx"), header.alias("cells"))
    serial = F.datediff(F.to_date("ts"), F.lit("1899-12-30").cast("date")).cast("string")
    every = lambda k: F.col("event_id") % k == 0
    body = events.select(
        "workbook",
        sheet,
        (F.col("event_id") + 100).alias("row_idx"),
        F.array(
            F.when(F.col("n") == 1, serial)
            .when((F.col("n") == 0) & every(5), F.date_format("ts", "MM/dd/yyyy"))
            .when(every(19), "total")
            .otherwise(F.date_format("ts", "yyyy-MM-dd")),
            F.when(every(13), "n/a").otherwise((F.hour("ts") + 1).cast("string")),
            F.when(every(17), "n/a").otherwise(F.col("c").cast("string")),
            F.when(every(3), "").otherwise((F.col("c") * 2).cast("string")),
        ).alias("cells"),
    )
    return titles.unionByName(headers).unionByName(body)


# ---- F7: long area load -------------------------------------------------------------------

AREA_LONG = """area_long as (
  select event_id,
         case event_type when 'click' then 'PGE-TAC' when 'view' then 'SCE-TAC' when 'purchase' then 'sdg&e tac'
              when 'signup' then 'VEA_TAC North' else 'CA ISO-TAC' end as tac_area_name,
         case when event_id % 31 = 0 then 'bad' else strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') end as interval_start_gmt,
         date_trunc('day', ts) + to_days(cast(event_id % 731 as int)) as market_date,
         cast(hour(ts) + 1 as int) as hour_ending,
         case when event_id % 13 = 0 then 'n/a' else cast(cast(round(value * 100) as bigint) as varchar) end as mw
  from events)"""


def area_long(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.col("event_type")
    return table(spark, folder, "events").select(
        "event_id",
        F.when(kind == "click", "PGE-TAC")
        .when(kind == "view", "SCE-TAC")
        .when(kind == "purchase", "sdg&e tac")
        .when(kind == "signup", "VEA_TAC North")
        .otherwise("CA ISO-TAC")
        .alias("tac_area_name"),
        F.when(F.col("event_id") % 31 == 0, "bad").otherwise(F.date_format(hour_of(), "yyyy-MM-dd HH:mm:ss")).alias("interval_start_gmt"),
        F.date_add(F.to_date("ts"), (F.col("event_id") % 731).cast("int")).cast("timestamp").alias("market_date"),
        (F.hour("ts") + 1).alias("hour_ending"),
        F.when(F.col("event_id") % 13 == 0, "n/a").otherwise(cents("value").cast("string")).alias("mw"),
    )


def area_feed(spark: SparkSession, folder: str) -> DataFrame:
    """The feed under the column names its source uses."""
    return area_long(spark, folder).select(
        "event_id",
        F.col("interval_start_gmt").alias("Interval Start UTC"),
        F.col("tac_area_name").alias("TAC-Area Name"),
        F.col("mw").alias("MW"),
    )


# ---- F8: file names -----------------------------------------------------------------------

FILES = """files as (
  select o_orderkey as file_id,
         case when o_orderkey % 13 = 0 then 'station_weights_' || strftime(o_orderdate, '%Y%m%d') || '.csv'
              when o_orderkey % 11 = 0 then 'caiso_dataset_' || strftime(o_orderdate, '%Y%m') || '_to_' || strftime(o_orderdate, '%Y%m%d') || '.csv'
              else 'caiso_dataset_' || strftime(o_orderdate, '%Y%m%d') || '_to_'
                   || strftime(o_orderdate + to_days(cast(o_custkey % 90 - 2 as int)), '%Y%m%d') || '.csv' end as file_name
  from orders)"""


def files(spark: SparkSession, folder: str) -> DataFrame:
    day = F.date_format("o_orderdate", "yyyyMMdd")
    until = F.date_format(F.date_add(F.to_date("o_orderdate"), (F.col("o_custkey") % 90 - 2).cast("int")), "yyyyMMdd")
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("file_id"),
        F.when(F.col("o_orderkey") % 13 == 0, F.concat(F.lit("station_weights_"), day, F.lit(".csv")))
        .when(
            F.col("o_orderkey") % 11 == 0,
            F.concat(F.lit("caiso_dataset_"), F.date_format("o_orderdate", "yyyyMM"), F.lit("_to_"), day, F.lit(".csv")),
        )
        .otherwise(F.concat(F.lit("caiso_dataset_"), day, F.lit("_to_"), until, F.lit(".csv")))
        .alias("file_name"),
    )


SPANS = FILES + """, spans as (
  select file_name, try_strptime(regexp_extract(file_name, '_(\\d{8})_to_', 1), '%Y%m%d') as span_start,
         try_strptime(regexp_extract(file_name, '_to_(\\d{8})\\.csv', 1), '%Y%m%d') as span_end
  from files where regexp_matches(file_name, '^caiso_dataset_(\\d{8})_to_(\\d{8})\\.csv$'))"""

RUN_FILES = """run_files as (
  select l_orderkey as file_id,
         case when l_orderkey % 17 = 0 then l_returnflag || '_' || strftime(l_shipdate, '%Y%m') || '_metrics.csv'
              else case l_linestatus when 'F' then 'Hinge-Regression' else 'tft ' || lower(l_returnflag) end || '_'
                   || strftime(l_shipdate, '%Y-%m') || '_'
                   || case when l_linenumber % 3 = 0 then 'metrics' when l_linenumber % 3 = 1 then 'predictions' else 'notes' end
                   || '.csv' end as file_name,
         l_linenumber as row_no,
         case when l_suppkey % 4 = 0 then ['region', 'time_utc', 'actual_load_mw']
              when l_linenumber % 3 = 0 then ['model', 'RMSE', 'MAE']
              else ['region', 'time_utc', 'actual_load_mw', 'predicted_load_mw'] end as header,
         cast(round(l_extendedprice * 100) as bigint) as amount
  from lineitem)"""


def run_files(spark: SparkSession, folder: str) -> DataFrame:
    n = F.col("l_linenumber")
    kind = F.when(n % 3 == 0, "metrics").when(n % 3 == 1, "predictions").otherwise("notes")
    model = F.when(F.col("l_linestatus") == "F", "Hinge-Regression").otherwise(F.concat(F.lit("tft "), F.lower("l_returnflag")))
    names = lambda *cols: F.array(*[F.lit(c) for c in cols])
    return table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("file_id"),
        F.when(
            F.col("l_orderkey") % 17 == 0,
            F.concat("l_returnflag", F.lit("_"), F.date_format("l_shipdate", "yyyyMM"), F.lit("_metrics.csv")),
        )
        .otherwise(F.concat(model, F.lit("_"), F.date_format("l_shipdate", "yyyy-MM"), F.lit("_"), kind, F.lit(".csv")))
        .alias("file_name"),
        n.alias("row_no"),
        F.when(F.col("l_suppkey") % 4 == 0, names("region", "time_utc", "actual_load_mw"))
        .when(n % 3 == 0, names("model", "RMSE", "MAE"))
        .otherwise(names("region", "time_utc", "actual_load_mw", "predicted_load_mw"))
        .alias("header"),
        cents("l_extendedprice").alias("amount"),
    )


# ---- F9: weather payloads -----------------------------------------------------------------


def payloads(spark: SparkSession, folder: str) -> DataFrame:
    """One payload per (region, day): at most 24 hours each."""
    hours = panel(spark, folder).select(
        "region",
        F.date_trunc("day", "time_utc").alias("day"),
        "time_utc",
        F.col("load_mw").alias("temperature_2m"),
        F.col("ord").cast("double").alias("cloud_cover"),
    )
    return pack_hourly_json(hours, ["region", "day"], ["temperature_2m", "cloud_cover"])


# ---- F11: demand with weather, for models -------------------------------------------------



def demand(spark: SparkSession, folder: str) -> DataFrame:
    """Six-hourly demand by region over several years with weather columns and calendar flags."""
    from tidewatt.functions.holidays import with_calendar_flags
    from tidewatt.operators.weather import with_degree_days

    at = F.timestamp_seconds(
        F.unix_timestamp(F.col("o_orderdate") + F.expr("INTERVAL 25 YEARS")) + (F.col("o_custkey") % 4) * 21600
    )
    k = F.col("o_custkey")
    rows = (
        table(spark, folder, "orders")
        .groupBy(F.col("o_orderpriority").alias("region"), at.alias("time_utc"))
        .agg(
            (F.sum(cents("o_totalprice")).cast("double") / 100).alias("load_mw"),
            F.avg((k % 60).cast("double")).alias("t"),
            F.avg((k % 37).cast("double")).alias("h"),
            F.max((k % 101).cast("double")).alias("c"),
            F.count("*").cast("double").alias("n"),
        )
        .select(
            "region",
            S.time_key(F.col("time_utc")).alias("time_key"),
            "time_utc",
            (F.col("t") + 40).alias("temperature_2m"),
            (F.col("t") * 0.9 + 42).alias("apparent_temperature"),
            (F.col("h") * 2 + 20).alias("relative_humidity_2m"),
            (F.col("h") % 5 / 10).alias("precipitation"),
            F.col("c").alias("cloud_cover"),
            (F.col("n") + F.col("h") / 4).alias("wind_speed_10m"),
            (F.greatest(F.sin(F.hour("time_utc") * 0.2618), F.lit(0.0)) * 600 + F.col("c")).alias("shortwave_radiation"),
            "load_mw",
        )
    )
    return P.with_week_lag(with_calendar_flags(with_degree_days(rows)))
