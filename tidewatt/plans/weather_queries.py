"""Station weights, weighted means and derived weather."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatt.functions import scalar as S
from tidewatt.operators import panel as P
from tidewatt.operators import weather as W
from tidewatt.operators.ordered import join_small
from tidewatt.plans import fixtures as X
from tidewatt.plans.registry import query
from tidewatt.sources import files as SF

RAW_STATIONS = X.STATIONS + """, raw as (
  select upper(region) as region, case when population_est % 7 = 0 then null else station_name end as station_name,
         cast(latitude as varchar) as latitude, cast(longitude as varchar) as longitude,
         case when population_est % 5 = 0 then 'unknown' else cast(population_est as varchar) end as population_weight
  from stations)"""


@query(
    "station_scan",
    f"""with {RAW_STATIONS} select lower(region) as region, station_name, cast(latitude as double) as latitude,
        cast(longitude as double) as longitude, try_cast(population_weight as double) as population_weight
        from raw where station_name is not null and try_cast(population_weight as double) is not null""",
)
def _(spark, sf):
    est = F.col("population_est")
    raw = X.stations(spark, sf).select(
        F.upper("region").alias("region"),
        F.when(est % 7 != 0, F.col("station_name")).alias("station_name"),
        F.col("latitude").cast("string").alias("latitude"),
        F.col("longitude").cast("string").alias("longitude"),
        F.when(est % 5 == 0, "unknown").otherwise(est.cast("string")).alias("population_weight"),
    )
    return SF.read_station_weights(raw)


NORMALIZED = """clipped as (select region, station_name, greatest(cast(population_est as double), 0.0) as w from stations),
normed as (select region, station_name, case when sum(w) over (partition by region) > 0 then w / sum(w) over (partition by region)
                  else 1.0 / count(*) over (partition by region) end as population_weight from clipped)"""


@query("weights_normalize", f"with {X.STATIONS}, {NORMALIZED} select region, station_name, round(population_weight, 9) as population_weight from normed")
def _(spark, sf):
    raw = X.stations(spark, sf).select("region", "station_name", F.col("population_est").cast("double").alias("population_weight"))
    return W.normalize_weights(raw).withColumn("population_weight", F.round("population_weight", 9))


@query(
    "weights_strict",
    f"""with {X.STATIONS} select region, station_name,
        round((population_est + 1000000.0) / sum(population_est + 1000000.0) over (partition by region), 9) as population_weight from stations""",
)
def _(spark, sf):
    raw = X.stations(spark, sf).select("region", "station_name", (F.col("population_est") + 1000000.0).alias("population_weight"))
    return W.normalize_weights_strict(raw).withColumn("population_weight", F.round("population_weight", 9))


@query(
    "topk_stations",
    f"""with {X.STATIONS}, k as (select region, station_name, greatest(cast(population_est as double), 0.0) as w from stations
          qualify row_number() over (partition by region order by population_est desc, station_name) <= 5)
        select region, station_name, round(case when sum(w) over (partition by region) > 0 then w / sum(w) over (partition by region)
          else 1.0 / count(*) over (partition by region) end, 9) as population_weight from k""",
)
def _(spark, sf):
    raw = X.stations(spark, sf).select("region", "station_name", F.col("population_est").cast("double").alias("population_weight"))
    return W.top_stations(raw, 5).withColumn("population_weight", F.round("population_weight", 9))


@query(
    "circle_ring",
    f"""with {X.STATIONS}, i as (select unnest(range(0, 49)) as point_no)
        select region, station_name, cast(point_no as int) as point_no,
        round(longitude + 25.0 / (111.0 * cos(radians(latitude)) + 1e-9) * cos(2 * pi() * ((point_no % 48) / 48.0)), 7) as lon,
        round(latitude + 25.0 / 111.0 * sin(2 * pi() * ((point_no % 48) / 48.0)), 7) as lat from stations, i""",
)
def _(spark, sf):
    ring = S.circle_ring(F.col("longitude"), F.col("latitude"), 25.0)
    return X.stations(spark, sf).select("region", "station_name", F.posexplode(ring).alias("point_no", "p")).select(
        "region", "station_name", "point_no", F.round(F.col("p")[0], 7).alias("lon"), F.round(F.col("p")[1], 7).alias("lat")
    )


# ---- weighted means -----------------------------------------------------------------------

WEIGHTED = f"""{X.STATION_WEATHER}, w as (select s.*, s.station_id / 10.0 as wt from station_weather s)"""


def weighted(spark, sf):
    """Station hours with weights station_id / 10, which sum to one per region."""
    weights = W.normalize_weights(X.station_weights(spark, sf), "raw_weight")
    return join_small(X.station_weather(spark, sf), weights, ["region", "station_id"])


VALUES = ["temperature_2m", "cloud_cover"]


def rounded(df):
    return df.withColumns({c: F.round(c, 7) for c in df.columns if c.startswith(("temperature", "cloud"))})


def mean_sql(template: str, keys: str = "region, time_utc") -> str:
    cols = ", ".join(f"round({template.format(v=v)}, 7) as {v}" for v in VALUES)
    return f"with {WEIGHTED} select {keys}, {cols} from w group by {keys}"


@query("wavg_strict", mean_sql("case when count({v}) = count(*) then sum(wt * {v}) end"))
def _(spark, sf):
    return rounded(W.weighted_mean_strict(weighted(spark, sf), VALUES, "raw_weight"))


@query("wavg_renorm", mean_sql("sum(wt * {v}) / nullif(sum(wt) filter ({v} is not null), 0)"))
def _(spark, sf):
    return rounded(W.weighted_mean_renormalized(weighted(spark, sf), VALUES, "raw_weight"))


@query("wavg_skipna", mean_sql("sum(coalesce(wt * {v}, 0.0))"))
def _(spark, sf):
    return rounded(W.weighted_mean_zero_fill(weighted(spark, sf), VALUES, "raw_weight"))


@query(
    "wavg_state",
    f"""with {X.STATION_WEATHER}, t as (select sum(station_id) as total from (select distinct region, station_id from station_weather))
        select time_utc, round(sum(coalesce(station_id / total * temperature_2m, 0.0)), 7) as temperature_2m,
        round(sum(coalesce(station_id / total * cloud_cover, 0.0)), 7) as cloud_cover
        from (select s.time_utc, s.temperature_2m, s.cloud_cover, s.station_id::double as station_id, t.total::double as total from station_weather s, t) group by time_utc""",
)
def _(spark, sf):
    """One mean over all regions: weights share the state's total."""
    weights = X.station_weights(spark, sf)
    total = weights.agg(F.sum("raw_weight")).scalar()
    shared = weights.withColumn("raw_weight", F.col("raw_weight") / total)
    joined = join_small(X.station_weather(spark, sf), shared, ["region", "station_id"])
    return rounded(W.weighted_mean_zero_fill(joined, VALUES, "raw_weight", ["time_utc"]))


# ---- derived weather ----------------------------------------------------------------------


@query("c_to_f", f"with {X.STATION_WEATHER} select region, station_id, time_utc, round(temperature_2m * 9.0 / 5.0 + 32.0, 8) as temp_f from station_weather")
def _(spark, sf):
    return X.station_weather(spark, sf).select(
        "region", "station_id", "time_utc", F.round(S.c_to_f(F.col("temperature_2m")), 8).alias("temp_f")
    )


@query(
    "degree_days",
    f"""with {X.STATION_WEATHER} select region, station_id, time_utc,
        case when temperature_2m is not null then round(greatest(temperature_2m - 65.0, 0.0), 8) end as cdd_65f,
        case when temperature_2m is not null then round(greatest(65.0 - temperature_2m, 0.0), 8) end as hdd_65f from station_weather""",
)
def _(spark, sf):
    out = W.with_degree_days(X.station_weather(spark, sf))
    return out.select(
        "region", "station_id", "time_utc", F.round("cdd_65f", 8).alias("cdd_65f"), F.round("hdd_65f", 8).alias("hdd_65f")
    )


@query(
    "degree_day_check",
    f"""with {X.STATION_WEATHER} select count(*) filter (temperature_2m is null or station_id = 3) as cdd_bad_rows,
        count(*) filter (temperature_2m is null) as hdd_bad_rows from station_weather""",
)
def _(spark, sf):
    stored = W.with_degree_days(X.station_weather(spark, sf)).withColumn(
        "cdd_65f", F.when(F.col("station_id") == 3, F.col("cdd_65f") + 0.5).otherwise(F.col("cdd_65f"))
    )
    return P.degree_day_check(stored)


@query(
    "weather_load_join",
    f"""with {WEIGHTED}, {X.PANEL}, m as (select region, time_utc, round(sum(coalesce(wt * temperature_2m, 0.0)), 7) as temperature_2m from w group by 1, 2)
        select m.region, m.time_utc, m.temperature_2m, p.load_mw from m left join panel p on p.region = m.region and p.time_utc = m.time_utc""",
)
def _(spark, sf):
    weather = rounded(W.weighted_mean_zero_fill(weighted(spark, sf), ["temperature_2m"], "raw_weight"))
    return W.join_weather_load(weather, X.panel(spark, sf))


#: The value that each station must have, station by station.
NEEDED = ["temperature_2m", "cloud_cover", "temperature_2m", "cloud_cover", "temperature_2m"]


@query(
    "common_times",
    f"with {X.STATION_WEATHER} "
    + " intersect ".join(f"select time_utc from station_weather where station_id = {n} and {v} is not null" for n, v in enumerate(NEEDED)),
)
def _(spark, sf):
    """Times at which all stations have their value."""
    grid = X.station_weather(spark, sf)
    return W.intersect_times(*[grid.where((F.col("station_id") == n) & F.col(v).isNotNull()) for n, v in enumerate(NEEDED)])


@query(
    "common_value_times",
    f"""with {X.STATION_WEATHER} select time_utc from station_weather group by time_utc
        having count(temperature_2m) > 0 and count(cloud_cover) > 0""",
)
def _(spark, sf):
    return W.common_times(X.station_weather(spark, sf), VALUES)


@query(
    "wide_city_features",
    f"with {X.STATION_WEATHER} select region, time_utc, "
    + ", ".join(f"round(max({v}) filter (station_id = {n}), 7) as {v}__s{n}" for v in VALUES for n in range(5))
    + " from station_weather group by 1, 2",
)
def _(spark, sf):
    named = X.station_weather(spark, sf).withColumn("station", F.concat(F.lit("s"), F.col("station_id").cast("string")))
    return rounded(W.wide_features(named, ["region", "time_utc"], "station", [f"s{n}" for n in range(5)], VALUES))
