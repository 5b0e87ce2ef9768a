from datetime import date, datetime

import pandas as pd
import pytest
from pandas.tseries.holiday import USFederalHolidayCalendar
from pyspark.sql import functions as F

from tidewatt.functions import holidays as H
from tidewatt.functions import scalar as S
from tidewatt.operators import panel as P
from tidewatt.operators import weather as W


def test_federal_rules_equal_pandas(spark):
    got = {r["day"] for r in H.holiday_table(spark, H.FEDERAL).where("day between '1990-01-01' and '2060-12-31'").collect()}
    want = {d.date() for d in USFederalHolidayCalendar().holidays("1990-01-01", "2060-12-31")}
    assert got == want


def test_state_rules(spark):
    days = {r["day"]: r["holiday"] for r in H.holiday_table(spark, H.STATE).where("year(day) in (2021, 2022)").collect()}
    assert days[date(2021, 12, 31)] == "New Year's Day"  # Saturday, observed on Friday
    assert days[date(2021, 7, 5)] == "Independence Day"  # Sunday, observed on Monday
    assert days[date(2021, 11, 26)] == "Day after Thanksgiving"
    assert date(2021, 6, 18) not in days and date(2021, 10, 11) not in days
    assert days[date(2021, 3, 31)] == "Cesar Chavez Day"


def test_flags_and_exact_bounds(spark):
    panel = spark.createDataFrame([(datetime(2024, 7, 4, 5),), (datetime(2024, 7, 6, 1),)], "time_utc timestamp")
    flags = [(r["is_weekend"], r["US_federal_holidays"], r["state_holidays"]) for r in H.with_calendar_flags(panel).orderBy("time_utc").collect()]
    assert flags == [(0, 1, 1), (1, 0, 0)]
    exact = H.with_holiday_flag(panel, H.FEDERAL, "flag", exact_bounds=True).orderBy("time_utc").first()
    assert exact["flag"] == 0  # the first day's midnight lies before the first row


@pytest.mark.parametrize(
    ("wall", "utc"),
    [
        ("2025-03-09 01:00:00", "2025-03-09 09:00:00"),
        ("2025-03-09 02:00:00", "2025-03-09 10:00:00"),  # skipped hour moves forward
        ("2025-03-09 03:00:00", "2025-03-09 10:00:00"),
        ("2025-11-02 01:00:00", "2025-11-02 08:00:00"),  # repeated hour is its first instance
        ("2025-11-02 02:00:00", "2025-11-02 10:00:00"),
        ("2024-02-29 00:00:00", "2024-02-29 08:00:00"),
    ],
)
def test_market_time(spark, wall, utc):
    df = spark.createDataFrame([(wall,)], "w string").select(S.market_to_utc(F.col("w").cast("timestamp")).alias("u"))
    assert str(df.first()["u"]) == utc


def test_time_key_round_trip_and_hours(spark):
    df = spark.createDataFrame([("2024-02-29:23",), ("bad",)], "k string")
    got = df.select(S.parse_time_key(F.col("k")).alias("t"), S.valid_hour_suffix(F.col("k")).alias("ok")).collect()
    assert got[0]["t"] == datetime(2024, 2, 29, 23) and got[1]["t"] is None
    assert [r["ok"] for r in got] == [True, False]


def test_degree_days_keep_null(spark):
    df = W.with_degree_days(spark.createDataFrame([(70.0,), (60.0,), (None,)], "temperature_2m double"))
    assert [(r["cdd_65f"], r["hdd_65f"]) for r in df.collect()] == [(5.0, 0.0), (0.0, 5.0), (None, None)]
    assert P.degree_day_check(df).first().asDict() == {"cdd_bad_rows": 1, "hdd_bad_rows": 1}


STATION = "region string, time_utc int, x double, w double"


def test_three_null_policies(spark):
    df = spark.createDataFrame([("a", 1, 10.0, 0.25), ("a", 1, None, 0.75), ("a", 2, None, 0.25), ("a", 2, None, 0.75)], STATION)
    value = lambda f: [r["x"] for r in f(df, ["x"], "w").orderBy("time_utc").collect()]
    assert value(W.weighted_mean_strict) == [None, None]
    assert value(W.weighted_mean_renormalized) == [10.0, None]
    assert value(W.weighted_mean_zero_fill) == [2.5, 0.0]


def test_weights(spark):
    df = spark.createDataFrame(
        [("a", "s1", 3.0), ("a", "s2", 1.0), ("a", "s3", -5.0), ("b", "s1", -1.0), ("b", "s2", 0.0)],
        "region string, station_name string, population_weight double",
    )
    got = {(r["region"], r["station_name"]): r["population_weight"] for r in W.normalize_weights(df).collect()}
    assert got == {("a", "s1"): 0.75, ("a", "s2"): 0.25, ("a", "s3"): 0.0, ("b", "s1"): 0.5, ("b", "s2"): 0.5}
    sums = W.top_stations(df, 2).groupBy("region").agg(F.sum("population_weight").alias("s")).collect()
    assert all(abs(r["s"] - 1) < 1e-12 for r in sums)
    with pytest.raises(ValueError, match="Non-positive"):
        W.normalize_weights_strict(df)


def test_region_without_load(spark):
    weather = spark.createDataFrame([("a", 1, 5.0), ("b", 1, 6.0)], "region string, time_utc int, t double")
    load = spark.createDataFrame([("a", 1, 9.0)], "region string, time_utc int, load_mw double")
    with pytest.raises(ValueError, match="b"):
        W.join_weather_load(weather, load)
    assert W.join_weather_load(weather, load, allow_missing=True).where("load_mw is null").count() == 1


def test_ring_is_closed(spark):
    ring = spark.range(1).select(S.circle_ring(F.lit(-120.0), F.lit(35.0), 10.0).alias("r")).first()["r"]
    assert len(ring) == 49 and ring[0] == ring[-1]
    assert ring[0][1] == 35.0 and ring[12][1] == pytest.approx(35.0 + 10 / 111)


def test_cyclic_and_calendar(spark):
    r = spark.createDataFrame([(datetime(2024, 12, 31, 18),)], "t timestamp").select(
        *[c.alias(n) for n, c in {**S.calendar_parts(F.col("t")), **S.cyclic_parts(F.col("t"))}.items()]
    ).first()
    want = pd.Timestamp("2024-12-31 18:00")
    assert (r["day_of_week"], r["day_of_year"], r["hour"]) == (want.dayofweek, want.dayofyear, 18)
    assert r["hour_sin"] == pytest.approx(-1.0)
