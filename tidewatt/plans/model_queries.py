"""Model fits, their bases, backtest and next-day scoring."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidewatt.functions import scalar as S
from tidewatt.models import additive, backtest, linear, seasonal, trees
from tidewatt.models import basis as B
from tidewatt.models.features import month_data
from tidewatt.models.gram import gram_entries, grams_by
from tidewatt.operators import panel as P
from tidewatt.plans import fixtures as X
from tidewatt.plans.registry import query
from tidewatt.session import materialize, shared_dir

MONTH = "2025-06"
OUT = ["region", "time_utc", "load_mw", "predicted_load_mw"]

# ---- bases --------------------------------------------------------------------------------

BUMP = """case when t < 0 or t >= 4 then 0.0 when t < 1 then t * t * t / 6
  when t < 2 then (-3 * t * t * t + 12 * t * t - 12 * t + 4) / 6 when t < 3 then (3 * t * t * t - 24 * t * t + 60 * t - 44) / 6
  else (4 - t) * (4 - t) * (4 - t) / 6 end"""
SLOPE = """case when t < 0 or t >= 4 then 0.0 when t < 1 then t * t / 2 when t < 2 then (-9 * t * t + 24 * t - 12) / 6
  when t < 3 then (9 * t * t - 48 * t + 60) / 6 else -(4 - t) * (4 - t) / 2 end"""


@query(
    "spline_basis",
    f"""with {X.PANEL}, j as (select cast(unnest(range(0, 8)) as int) as basis_no),
        u as (select region, time_utc, basis_no, (load_mw - 5.0) / (120.0 / 5) as u from panel, j where load_mw is not null),
        c as (select *, least(greatest(u, 0.0), 5.0) as c from u), t as (select *, c - basis_no + 3 as t from c)
        select region, time_utc, basis_no, round({BUMP} + ({SLOPE}) * (u - c), 7) + 0.0 as basis from t""",
)
def _(spark, sf):
    """Eight splines over 5 to 125, so that loads fall inside and beyond the knots."""
    rows = X.panel(spark, sf).where("load_mw is not null")
    return rows.select(
        "region", "time_utc", F.posexplode(B.spline_basis(F.col("load_mw"), 5.0, 125.0, 8)).alias("basis_no", "b")
    ).select("region", "time_utc", "basis_no", (F.round("b", 7) + 0.0).alias("basis"))


@query(
    "cyclic_basis",
    f"""with {X.PANEL}, j as (select cast(unnest(range(0, 6)) as int) as basis_no),
        u as (select region, time_utc, basis_no, hour(time_utc) / 4.0 - basis_no as d from panel, j),
        t as (select *, case when d < 0 then d + 6 else d end as t from u)
        select region, time_utc, basis_no, round({BUMP}, 7) as basis
        from (select region, time_utc, basis_no, cast(t as double) as t from t)""",
)
def _(spark, sf):
    hour = F.hour("time_utc").cast("double")
    return X.panel(spark, sf).select(
        "region", "time_utc", F.posexplode(B.cyclic_basis(hour, 0.0, 24.0, 6)).alias("basis_no", "b")
    ).select("region", "time_utc", "basis_no", F.round("b", 7).alias("basis"))


@query(
    "fourier_features",
    f"with {X.PANEL} select region, time_utc, "
    + ", ".join(
        f"round({f}(epoch(time_utc) / 86400.0 * (2 * pi() / {p}) * {k}), 6) + 0.0 as {f}_{n}_{k}"
        for n, p in (("weekly", 7.0), ("daily", 1.0))
        for k in (1, 2)
        for f in ("sin", "cos")
    )
    + " from panel",
)
def _(spark, sf):
    out = X.panel(spark, sf).select("region", "time_utc")
    for name, period in (("weekly", 7.0), ("daily", 1.0)):
        values = B.fourier(seasonal.days(), period, 2)
        labels = [f"{f}_{name}_{k}" for k in (1, 2) for f in ("sin", "cos")]
        out = out.withColumns({c: F.round(values[i], 6) + 0.0 for i, c in enumerate(labels)})
    return out


@query(
    "normal_equations",
    f"""with {X.PANEL}, r as (select region, [1.0, hour(time_utc)::double, day(time_utc)::double, load_mw * 100] as x from panel where load_mw is not null),
        i as (select unnest([1, 2, 3, 4]) as i), j as (select unnest([1, 2, 3, 4]) as j)
        select region, cast(i - 1 as int) as row_no, cast(j - 1 as int) as col_no, sum(round(x[i]) * round(x[j])) as value
        from r, i, j group by 1, 2, 3""",
)
def _(spark, sf):
    """The distributed Gram matrix per region, on whole numbers so that the sums are exact."""
    whole = [F.lit(1.0), F.hour("time_utc").cast("double"), F.dayofmonth("time_utc").cast("double"), F.round(F.col("load_mw") * 100)]
    rows = X.panel(spark, sf).where("load_mw is not null").select("region", F.array(*whole).alias("x"), F.lit(0.0).alias("y"))
    return gram_entries(grams_by(rows, F.col("region"))).withColumnRenamed("key", "region")


# ---- fits ---------------------------------------------------------------------------------


def revised(spark, sf):
    """The feature table, written once: every fit takes several passes over it."""
    return materialize(X.demand(spark, sf), "demand")


def data(spark, sf):
    return month_data(revised(spark, sf), MONTH)


@query("fit_linear")
def _(spark, sf):
    d = data(spark, sf)
    return linear.fit_linear(d.train)(d.valid).select(*OUT)


@query("fit_ridge")
def _(spark, sf):
    d = data(spark, sf)
    return linear.fit_ridge(d.train, alpha=10.0)(d.valid).select(*OUT)


@query("fit_eps_insensitive")
def _(spark, sf):
    d = data(spark, sf)
    return linear.fit_eps_insensitive(d.train)(d.valid).select(*OUT)


@query("fit_gbt")
def _(spark, sf):
    d = data(spark, sf)
    return trees.fit_boosted(d.train)(d.valid).select(*OUT)


@query("fit_rf")
def _(spark, sf):
    d = data(spark, sf)
    return trees.fit_forest(d.train, max_depth=10)(d.valid).select(*OUT)


@query("fit_gbt_shallow")
def _(spark, sf):
    d = data(spark, sf)
    return trees.fit_boosted_shallow(d.train)(d.valid).select(*OUT)


@query("fit_additive")
def _(spark, sf):
    d = data(spark, sf)
    model, lagged = additive.fit_additive_split(d.train, d.valid)
    return model.predict(lagged).select(*OUT)


@query("partial_effect")
def _(spark, sf):
    d = data(spark, sf)
    model, _ = additive.fit_additive_split(d.train, d.valid)
    return model.partial_effect(spark, "temperature_2m")


@query("fit_additive_by_hour")
def _(spark, sf):
    d = data(spark, sf)
    return additive.fit_additive_by_hour(d.train, d.valid)


@query("fit_seasonal_by_region")
def _(spark, sf):
    d = data(spark, sf)
    return seasonal.fit_seasonal_by_region(d.train)(d.valid).select(*OUT)


@query("backtest_months")
def _(spark, sf):
    folder = f"{shared_dir(spark)}/backtest-{uuid.uuid4().hex}"
    metrics, _ = backtest.backtest(
        revised(spark, sf), {"ridge": {"alpha": 10.0}, "seasonal": {}}, ["2025-06", "2025-07"], folder
    )
    return metrics


@query("score_next_day")
def _(spark, sf):
    """The last day of the demand table stands in for the next day."""
    demand = revised(spark, sf)
    cut = P.datetime(2026, 6, 30, 23, 59, 59)
    history, ahead = P.cutoff_split(demand, cut)
    upcoming = ahead.withColumn("load_pred_mw", F.when(F.hour("time_utc") > 6, F.col("load_mw"))).drop("load_mw")
    return backtest.score_next_day(history, upcoming, "ridge")


@query(
    "next_day_sequences",
    f"""with {X.PANEL}, tail as (select region, time_utc, coalesce(load_mw, 0) as load_mw, 0 as nxt from panel where time_utc < timestamp '2024-01-20'
          qualify row_number() over (partition by region order by time_utc desc) <= 12),
        both_rows as (select * from tail union all select region, time_utc, coalesce(load_mw, 0), 1 from panel
          where time_utc >= timestamp '2024-01-20' and time_utc < timestamp '2024-01-21'),
        w as (select region, time_utc, nxt, count(*) over s as n, sum(cast(round(load_mw * 100) as bigint)) over s as load_sum
          from both_rows window s as (partition by region order by time_utc rows between 12 preceding and 1 preceding))
        select region, time_utc, cast(load_sum as bigint) as load_sum from w where n = 12 and nxt = 1""",
)
def _(spark, sf):
    panel = X.panel(spark, sf).drop("ord")
    history = panel.where("time_utc < timestamp'2024-01-20'")
    ahead = P.target_day(panel, P.date(2024, 1, 20))
    built = backtest.next_day_sequences(history, ahead, ["load_mw"], 12)
    total = F.aggregate("sequence", F.lit(0).cast("bigint"), lambda acc, x: acc + F.round(x[0] * 100).cast("bigint"))
    return built.select("region", "time_utc", total.alias("load_sum"))
