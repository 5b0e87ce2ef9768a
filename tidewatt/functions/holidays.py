"""Holiday calendars as a date table built from rules.

A rule is a fixed day of a month or the n-th weekday of a month; fixed days on
a Saturday are observed on Friday and on a Sunday on Monday.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatt.functions.scalar import is_weekend


@dataclass(frozen=True)
class Holiday:
    name: str
    month: int
    day: int = 0  # fixed day of the month, or 0 for a weekday rule
    weekday: str = ""  # three-letter weekday of a weekday rule
    nth: int = 0  # 1 = first, ..., -1 = last
    plus_days: int = 0
    since: int = 0  # first year


# US federal holidays.
FEDERAL = [
    Holiday("New Year's Day", 1, day=1),
    Holiday("Birthday of Martin Luther King, Jr.", 1, weekday="Mon", nth=3, since=1986),
    Holiday("Washington's Birthday", 2, weekday="Mon", nth=3),
    Holiday("Memorial Day", 5, weekday="Mon", nth=-1),
    Holiday("Juneteenth National Independence Day", 6, day=19, since=2021),
    Holiday("Independence Day", 7, day=4),
    Holiday("Labor Day", 9, weekday="Mon", nth=1),
    Holiday("Columbus Day", 10, weekday="Mon", nth=2),
    Holiday("Veterans Day", 11, day=11),
    Holiday("Thanksgiving Day", 11, weekday="Thu", nth=4),
    Holiday("Christmas Day", 12, day=25),
]

# California state holidays.
STATE = [
    Holiday("New Year's Day", 1, day=1),
    Holiday("Martin Luther King, Jr. Day", 1, weekday="Mon", nth=3),
    Holiday("Presidents Day", 2, weekday="Mon", nth=3),
    Holiday("Cesar Chavez Day", 3, day=31),
    Holiday("Memorial Day", 5, weekday="Mon", nth=-1),
    Holiday("Independence Day", 7, day=4),
    Holiday("Labor Day", 9, weekday="Mon", nth=1),
    Holiday("Veterans Day", 11, day=11),
    Holiday("Thanksgiving Day", 11, weekday="Thu", nth=4),
    Holiday("Day after Thanksgiving", 11, weekday="Thu", nth=4, plus_days=1),
    Holiday("Christmas Day", 12, day=25),
]


def observed(day: Column) -> Column:
    """Friday for a Saturday, Monday for a Sunday."""
    return (
        F.when(F.weekday(day) == 5, F.date_sub(day, 1)).when(F.weekday(day) == 6, F.date_add(day, 1)).otherwise(day)
    )


def rule_date(rule: Holiday, year: Column) -> Column:
    first = F.make_date(year, F.lit(rule.month), F.lit(1))
    if rule.day:
        day = observed(F.make_date(year, F.lit(rule.month), F.lit(rule.day)))
    elif rule.nth > 0:
        day = F.date_add(F.next_day(F.date_sub(first, 1), rule.weekday), 7 * (rule.nth - 1))
    else:
        day = F.date_sub(F.next_day(F.last_day(first), rule.weekday), 7)
    day = F.date_add(day, rule.plus_days) if rule.plus_days else day
    return F.when(year >= rule.since, day)


def holiday_dates(years: DataFrame, rules: list[Holiday]) -> DataFrame:
    """(day, holiday) of every rule in each year of `years` (column `year`)."""
    entries = F.array(
        *[F.struct(rule_date(r, F.col("year")).alias("day"), F.lit(r.name).alias("holiday")) for r in rules]
    )
    return years.select(F.explode(entries).alias("e")).select("e.day", "e.holiday").where("day is not null")


# The years a nanosecond timestamp can hold.
FIRST_YEAR, LAST_YEAR = 1677, 2262


def holiday_table(spark: SparkSession, rules: list[Holiday]) -> DataFrame:
    """(day, holiday) of every year: a few thousand rows, bounded by the calendar and not by the data."""
    years = spark.range(FIRST_YEAR, LAST_YEAR + 1, 1, 1).select(F.col("id").cast("int").alias("year"))
    return holiday_dates(years, rules)


def holidays_in_span(panel: DataFrame, rules: list[Holiday], ts: str = "time_utc", exact_bounds: bool = False) -> DataFrame:
    """Holidays inside the panel's span of days.

    With `exact_bounds` a holiday counts only if its midnight is inside the
    span, which loses a holiday on a first day that starts later.
    """
    bounds = panel.agg(F.min(ts).alias("lo"), F.max(ts).alias("hi"))
    lo = bounds.select("lo" if exact_bounds else F.date_trunc("day", "lo")).scalar()
    hi = bounds.select("hi").scalar()
    at = F.col("day").cast("timestamp")
    return holiday_table(panel.sparkSession, rules).where((at >= lo) & (at <= hi))


def with_holiday_flag(panel: DataFrame, rules: list[Holiday], name: str, ts: str = "time_utc", exact_bounds: bool = False) -> DataFrame:
    """0/1 flag whether the row's UTC day is a holiday, by a broadcast of the date table.

    Rows always lie inside their own span, so the panel's bounds matter only
    for `exact_bounds` and are not computed otherwise.
    """
    if exact_bounds:
        listed = holidays_in_span(panel, rules, ts, exact_bounds)
    else:
        listed = holiday_table(panel.sparkSession, rules)
    days = listed.select(F.col("day").alias("__day")).distinct()
    return (
        panel.join(F.broadcast(days), F.to_date(ts) == F.col("__day"), "left")
        .withColumn(name, F.col("__day").isNotNull().cast("int"))
        .drop("__day")
    )


def calendar_table(spark: SparkSession, calendars: dict[str, list[Holiday]]) -> DataFrame:
    """One row per day that is a holiday in some calendar, with a 0/1 flag for each."""
    listed = None
    for name, rules in calendars.items():
        days = holiday_table(spark, rules).select("day", F.lit(name).alias("calendar"))
        listed = days if listed is None else listed.unionByName(days)
    return listed.groupBy("day").agg(*[F.max((F.col("calendar") == n).cast("int")).alias(n) for n in calendars])


def with_calendar_flags(panel: DataFrame, ts: str = "time_utc") -> DataFrame:
    """The three calendar features: weekend, federal holiday, state holiday. One join for both calendars."""
    names = {"US_federal_holidays": FEDERAL, "state_holidays": STATE}
    table = calendar_table(panel.sparkSession, names).withColumnRenamed("day", "__day")
    flagged = panel.drop(*names).withColumn("is_weekend", is_weekend(F.col(ts)))
    joined = flagged.join(F.broadcast(table), F.to_date(ts) == F.col("__day"), "left").drop("__day")
    return joined.withColumns({n: F.coalesce(n, F.lit(0)) for n in names})
