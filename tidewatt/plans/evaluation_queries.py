"""Forecast errors, metrics and model comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatt.functions import scalar as S
from tidewatt.operators import evaluate as E
from tidewatt.operators import ordered as O
from tidewatt.plans import fixtures as X
from tidewatt.plans.registry import query

ERR = "(predicted_load_mw - actual_load_mw)"
APE = f"case when actual_load_mw <> 0 then abs({ERR}) / abs(actual_load_mw) * 100.0 end"

# Loads are whole megawatts, so every mean but MAPE's is exact on both sides.
MAPE_DIGITS = 7
METRIC_SQL = {
    "MSE": f"avg({ERR} * {ERR})",
    "RMSE": f"sqrt(avg({ERR} * {ERR}))",
    "MAE": f"avg(abs({ERR}))",
    "MAPE": f"round(avg({APE}), {MAPE_DIGITS})",
    "BIAS": f"avg({ERR})",
    "MEAN_ACTUAL": "avg(actual_load_mw)",
    "MEAN_FORECAST": "avg(predicted_load_mw)",
}


def metric_sql(names=tuple(METRIC_SQL), suffix="", rename=None) -> str:
    return ", ".join(f"{METRIC_SQL[n]} as {(rename or {}).get(n, n + suffix)}" for n in names)


def rounded(df):
    return df.withColumns({c: F.round(c, MAPE_DIGITS) for c in df.columns if c.startswith("MAPE")})


def predictions(spark, sf):
    return E.clean_predictions(X.predictions(spark, sf))


@query(
    "predictions_frame",
    f"""with {X.PREDICTIONS} select model, region, time_utc, ord, strftime(time_utc, '%Y-%m-%d:%H') as time_key, actual_load_mw,
        predicted_load_mw, {ERR} as error, abs({ERR}) as absolute_error, {ERR} * {ERR} as squared_error,
        round({APE}, 7) as ape_percent from predictions""",
)
def _(spark, sf):
    out = E.predictions_frame(X.predictions(spark, sf)).withColumn("time_key", S.time_key(F.col("time_utc")))
    return out.withColumn("ape_percent", F.round("ape_percent", 7))


@query(
    "prediction_clean",
    f"""with {X.PREDICTIONS} select model, region, ord, time_utc, actual_load_mw, predicted_load_mw,
        case when ord % 3 = 0 then null when ord % 3 = 1 then 1.5::double else 2.0::double end as absolute_error
        from predictions
        where ord % 7 <> 0 and ord % 5 <> 0 and ord % 11 <> 0""",
)
def _(spark, sf):
    every = lambda n: F.col("ord") % n == 0
    raw = X.predictions(spark, sf).select(
        "model",
        "region",
        "ord",
        F.when(every(7), "soon").otherwise(F.col("time_utc").cast("string")).alias("time_utc"),
        F.when(every(5), "n/a").otherwise(F.col("actual_load_mw").cast("string")).alias("actual_load_mw"),
        F.when(~every(11), F.col("predicted_load_mw").cast("string")).alias("predicted_load_mw"),
        F.when(every(3), "bad").when(F.col("ord") % 3 == 1, "1.5").otherwise("2").alias("absolute_error"),
    )
    return E.clean_predictions(raw)


@query("forecast_metrics", f"with {X.PREDICTIONS} select {metric_sql()} from predictions")
def _(spark, sf):
    return rounded(E.metrics(predictions(spark, sf)))


@query(
    "metrics_by_month",
    f"""with {X.PREDICTIONS} select model, strftime(time_utc, '%Y-%m') as month, date_trunc('month', time_utc)::timestamp as month_ts,
        count(*) as rows, min(time_utc) as start_time, max(time_utc) as end_time,
        {metric_sql(rename={'MEAN_FORECAST': 'MEAN_PREDICTED'})} from predictions group by 1, 2, 3""",
)
def _(spark, sf):
    return rounded(E.metrics_by_month(predictions(spark, sf)))


NAMED = ("RMSE", "MAE", "MAPE", "BIAS")


@query(
    "metrics_by_model",
    f"""with {X.PREDICTIONS} select model, count(*) as rows, min(time_utc) as start_time, max(time_utc) as end_time,
        {metric_sql(NAMED, '_recomputed')}, {metric_sql(('MEAN_ACTUAL', 'MEAN_FORECAST'))} from predictions group by 1""",
)
def _(spark, sf):
    return rounded(E.metrics_by_model(predictions(spark, sf)))


WINDOW = X.PREDICTIONS + """, b as (select model, min(time_utc) as s, max(time_utc) as e from predictions group by 1),
 win as (select max(s) as common_start, min(e) as common_end from b),
 common as (select p.* from predictions p, win where time_utc >= common_start and time_utc <= common_end)"""


@query("common_window", f"with {WINDOW} select * from win where common_start <= common_end")
def _(spark, sf):
    return E.common_window(predictions(spark, sf))


@query(
    "metrics_overlap",
    f"""with {WINDOW} select model, count(*) as rows_in_common_window, min(time_utc) as common_start_time,
        max(time_utc) as common_end_time, {metric_sql(NAMED, '_overlap')} from common group by 1""",
)
def _(spark, sf):
    return rounded(E.metrics_on_overlap(predictions(spark, sf)))


@query(
    "first_week_view",
    f"""with {WINDOW} select model, region, ord, time_utc, actual_load_mw, predicted_load_mw from common
        where time_utc <= (select min(time_utc) from common) + interval 7 day""",
)
def _(spark, sf):
    return E.first_days(predictions(spark, sf)).select(
        "model", "region", "ord", "time_utc", "actual_load_mw", "predicted_load_mw"
    )


@query("mae_by_hour", f"with {X.PREDICTIONS} select model, cast(hour(time_utc) as int) as hour, avg(abs({ERR})) as mae, count(*) as rows from predictions group by 1, 2")
def _(spark, sf):
    return E.mae_by(predictions(spark, sf), F.hour("time_utc"), "hour")


@query("mae_by_day", f"with {X.PREDICTIONS} select model, strftime(time_utc, '%Y-%m-%d') as day, avg(abs({ERR})) as mae, count(*) as rows from predictions group by 1, 2")
def _(spark, sf):
    return E.mae_by(predictions(spark, sf), F.date_format("time_utc", "yyyy-MM-dd"), "day")


def histogram_sql(value: str) -> str:
    return f"""with {X.PREDICTIONS}, v as (select model, {value} as v from predictions),
        s as (select model, min(v) as lo, max(v) as hi from v group by 1),
        c as (select v.model, least(59, cast(floor((v - lo) / ((hi - lo) / 60)) as bigint)) as bin, count(*) as n from v join s on s.model = v.model group by 1, 2),
        g as (select model, lo, hi, unnest(range(0, 60)) as bin from s)
        select g.model, g.bin, lo + g.bin * ((hi - lo) / 60) as bin_start, coalesce(c.n, 0) as frequency
        from g left join c on c.model = g.model and c.bin = g.bin"""


@query("error_histogram", histogram_sql(ERR))
def _(spark, sf):
    error = F.col("predicted_load_mw") - F.col("actual_load_mw")
    return E.histogram(predictions(spark, sf), error)


@query("abs_error_histogram", histogram_sql(f"abs({ERR})"))
def _(spark, sf):
    return E.histogram(predictions(spark, sf), F.col("absolute_error"))


@query("ape_by_hour", f"with {X.PREDICTIONS} select cast(hour(time_utc) as int) as hour, round(avg({APE}), 7) as mape from predictions group by 1")
def _(spark, sf):
    return E.mape_by(predictions(spark, sf), F.hour("time_utc").alias("hour")).withColumn("mape", F.round("mape", 7))


@query("mape_by_region", f"with {X.PREDICTIONS} select region, round(avg({APE}), 7) as mape from predictions group by 1")
def _(spark, sf):
    return E.mape_by(predictions(spark, sf), F.col("region")).withColumn("mape", F.round("mape", 7))


SUMMARY = X.PREDICTIONS + f""", summary as (select model, strftime(time_utc, '%Y-%m') as month, round(avg({APE}), 7) as mape,
  cast(floor(avg(abs({ERR})) / 500) as bigint) as mae_class from predictions group by 1, 2)"""


def summary(spark, sf):
    named = predictions(spark, sf).withColumn("month", S.year_month(F.col("time_utc")))
    mape = F.round(F.avg(S.ape_percent(F.col("actual_load_mw"), F.col("predicted_load_mw"))), 7)
    return named.groupBy("model", "month").agg(
        mape.alias("mape"), F.floor(F.avg("absolute_error") / 500).alias("mae_class")
    )


@query(
    "model_rank",
    f"""with {SUMMARY} select model, month, mape, mae_class, cast(rank() over (partition by month order by mape) as int) as rank from summary where mape is not null""",
)
def _(spark, sf):
    return E.rank_in_month(summary(spark, sf), "mape")


@query(
    "model_rank_ties",
    f"""with {SUMMARY} select model, month, mae_class, cast(rank() over (partition by month order by mae_class) as int) as rank from summary""",
)
def _(spark, sf):
    return E.rank_in_month(summary(spark, sf), "mae_class").drop("mape")


#: Every month that the orders can fall into.
MONTHS = [f"{y}-{m:02d}" for y in range(1995, 2002) for m in range(1, 13)]


@query(
    "mape_matrix",
    f"with {SUMMARY} select model, "
    + ", ".join(f"max(mape) filter (month = '{m}') as \"{m}\"" for m in MONTHS)
    + ", round(avg(mape), 7) as mean from summary group by 1",
)
def _(spark, sf):
    return E.metric_matrix(summary(spark, sf), MONTHS, "mape").withColumn("mean", F.round("mean", 7)).orderBy("mean")


@query("leaderboard", f"with {SUMMARY} select model, month, mape, mae_class from summary where month = '1996-06'")
def _(spark, sf):
    return E.leaderboard(summary(spark, sf), "1996-06", "mape")


@query(
    "eval_vs_baseline",
    f"""with {X.PREDICTIONS}, b as (select case when ord % 24 < 7 then actual_load_mw end as actual_load_mw, predicted_load_mw from predictions)
        select {metric_sql()} from b where actual_load_mw is not null""",
)
def _(spark, sf):
    sparse = X.predictions(spark, sf).select(
        F.when(F.col("ord") % 24 < 7, F.col("actual_load_mw")).alias("load_pred_mw"), "predicted_load_mw"
    )
    return rounded(E.against_baseline(sparse))


@query(
    "blend_predictions",
    f"""with {X.PANEL} select region, time_utc, round(0.3 * (load_mw * 1.1) + 0.7 * (load_mw + 5), 7) as predicted_load_mw from panel""",
)
def _(spark, sf):
    panel = X.panel(spark, sf)
    a = panel.select("region", "time_utc", (F.col("load_mw") * 1.1).alias("predicted_load_mw"))
    b = panel.select("region", "time_utc", (F.col("load_mw") + 5).alias("predicted_load_mw"))
    return E.blend(a, b, 0.3).withColumn("predicted_load_mw", F.round("predicted_load_mw", 7))


@query(
    "scored_join_idx",
    f"""with {X.PANEL}, i as (select region, time_utc, load_mw, row_number() over (partition by region order by time_utc) - 1 as time_idx from panel)
        select region, time_idx, time_utc, load_mw as actual_load_mw, cast(time_idx * 2 as double) as predicted_load_mw from i
        where load_mw is not null""",
)
def _(spark, sf):
    panel = O.with_ordinal(X.panel(spark, sf).drop("ord"))
    scored = panel.select("region", "time_idx", (F.col("time_idx") * 2).cast("double").alias("predicted_load_mw"))
    return E.join_scored(scored, panel)
