"""Calendar flags and month splits on the many-year daily panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatt.functions import holidays as H
from tidewatt.functions import scalar as S
from tidewatt.operators import panel as P
from tidewatt.plans import fixtures as X
from tidewatt.plans.registry import query

MONTH = "2024-12"

SPLIT_SQL = f"""with {X.DAILY} select region, time_utc, load_mw, case when time_utc < timestamp '{{lo}}' then 'train' else 'valid' end as part,
  timestamp '{{end}}' as train_end from daily where time_utc < timestamp '{{hi}}'"""


@query("month_split", SPLIT_SQL.format(lo="2024-12-01", hi="2025-01-01", end="2024-11-30 23:59:59"))
def _(spark, sf):
    _, _, end = P.month_bounds(MONTH)
    train, valid = P.month_split(X.daily(spark, sf), MONTH)
    tagged = [d.withColumn("part", F.lit(n)) for d, n in ((train, "train"), (valid, "valid"))]
    return P.union_parts(*tagged).withColumn("train_end", P.utc_lit(end))


@query(
    "cutoff_split",
    f"""with {X.DAILY} select region, time_utc, load_mw,
        case when time_utc <= timestamp '2025-12-31 23:59:59' then 'train' else 'valid' end as part from daily""",
)
def _(spark, sf):
    train, valid = P.cutoff_split(X.daily(spark, sf), P.datetime(2025, 12, 31, 23, 59, 59))
    return P.union_parts(train.withColumn("part", F.lit("train")), valid.withColumn("part", F.lit("valid")))


@query("is_weekend", f"with {X.DAILY} select region, time_utc, cast(isodow(time_utc) >= 6 as int) as is_weekend from daily")
def _(spark, sf):
    return X.daily(spark, sf).select("region", "time_utc", S.is_weekend(F.col("time_utc")).alias("is_weekend"))


# The SQL twins find each rule's date by counting weekdays inside the month, independent of the Spark side.
YEARS = X.DAILY + """, bounds as (select date_trunc('day', min(time_utc)) as lo, max(time_utc) as hi from daily),
years as (select unnest(range((select year(lo) - 1 from bounds), (select year(hi) + 2 from bounds))) as y),
cal as (select unnest(generate_series(make_date((select min(y) from years), 1, 1), make_date((select max(y) from years), 12, 31), interval 1 day)) as d),
wd as (select d, year(d) as y, month(d) as m, day(d) as dd, isodow(d) as w, (day(d) - 1) // 7 + 1 as nth,
              day(d) + 7 > day(last_day(d)) as is_last from cal),
fixed as (select y, m, dd, case w when 6 then d - interval 1 day when 7 then d + interval 1 day else d end as hday from wd)"""


def _rules(fixed, weekdays):
    parts = [
        f"select hday, '{name}' as holiday from fixed where m = {m} and dd = {d} and y >= {since}" for name, m, d, since in fixed
    ] + [
        f"select d + interval {plus} day, '{name}' from wd where m = {m} and w = {w} and {where} and y >= {since}"
        for name, m, w, where, plus, since in weekdays
    ]
    return " union all ".join(parts)


FEDERAL_RULES = _rules(
    [("New Year''s Day", 1, 1, 0), ("Juneteenth National Independence Day", 6, 19, 2021), ("Independence Day", 7, 4, 0),
     ("Veterans Day", 11, 11, 0), ("Christmas Day", 12, 25, 0)],
    [("Birthday of Martin Luther King, Jr.", 1, 1, "nth = 3", 0, 1986), ("Washington''s Birthday", 2, 1, "nth = 3", 0, 0),
     ("Memorial Day", 5, 1, "is_last", 0, 0), ("Labor Day", 9, 1, "nth = 1", 0, 0), ("Columbus Day", 10, 1, "nth = 2", 0, 0),
     ("Thanksgiving Day", 11, 4, "nth = 4", 0, 0)],
)
STATE_RULES = _rules(
    [("New Year''s Day", 1, 1, 0), ("Cesar Chavez Day", 3, 31, 0), ("Independence Day", 7, 4, 0), ("Veterans Day", 11, 11, 0),
     ("Christmas Day", 12, 25, 0)],
    [("Martin Luther King, Jr. Day", 1, 1, "nth = 3", 0, 0), ("Presidents Day", 2, 1, "nth = 3", 0, 0),
     ("Memorial Day", 5, 1, "is_last", 0, 0), ("Labor Day", 9, 1, "nth = 1", 0, 0), ("Thanksgiving Day", 11, 4, "nth = 4", 0, 0),
     ("Day after Thanksgiving", 11, 4, "nth = 4", 1, 0)],
)


def holiday_sql(rules: str) -> str:
    return f"""with {YEARS}, rules as ({rules})
        select strftime(hday, '%Y-%m-%d') as day, holiday from rules, bounds where hday >= lo and hday <= hi"""


@query("federal_holidays", holiday_sql(FEDERAL_RULES))
def _(spark, sf):
    return H.holidays_in_span(X.daily(spark, sf), H.FEDERAL).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query("state_holidays", holiday_sql(STATE_RULES))
def _(spark, sf):
    return H.holidays_in_span(X.daily(spark, sf), H.STATE).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query(
    "holiday_flag",
    f"""with {YEARS}, fed as ({FEDERAL_RULES}), st as ({STATE_RULES})
        select region, time_utc, load_mw, cast(isodow(time_utc) >= 6 as int) as is_weekend,
        cast(date_trunc('day', time_utc) in (select hday from fed) as int) as US_federal_holidays,
        cast(date_trunc('day', time_utc) in (select hday from st) as int) as state_holidays from daily""",
)
def _(spark, sf):
    return H.with_calendar_flags(X.daily(spark, sf))
