"""Whole jobs, and hot groups."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tests.test_sources import write_panel_csv
from tidewatt import constants as K
from tidewatt.operators import diagnose as D
from tidewatt.operators import ordered as O
from tidewatt.operators import panel as P
from tidewatt.operators import weather as W
from tidewatt.plans.flagship import daily_actuals
from tidewatt.session import materialize, shared_dir


def test_daily_actuals_from_raw_files(spark, tmp_path):
    raw = tmp_path / "raw"
    raw.mkdir()
    first = datetime(2024, 6, 28)
    rows = [("pge", str(first + timedelta(hours=i)), "" if i == 200 else i) for i in range(24 * 10)]
    write_panel_csv(raw, "caiso_dataset_20240628_to_20240707.csv", rows)
    out = daily_actuals(spark, str(raw), str(tmp_path / "out"))
    assert set(K.REVISED_COLUMNS) <= set(out.columns)
    assert out.count() == 24 * 3 - 1  # 3 days have a lag, one hour lacks load
    day = out.where("time_utc = timestamp'2024-07-05 06:00:00'").first()
    assert (day["load_previous_week"], day["US_federal_holidays"], day["is_weekend"]) == (6.0, 0, 0)


def test_region_weather(spark):
    at = datetime(2024, 1, 1)
    row = lambda s, c: ("a", s, at, c, c, 50.0, 0.0, 0.0, 5.0, 0.0)
    schema = "region string, station_name string, time_utc timestamp, " + ", ".join(f"{v} double" for v in K.WEATHER_VARS)
    hours = spark.createDataFrame([row("s1", 10.0), row("s2", 20.0)], schema)
    weights = spark.createDataFrame([("a", "s1", 0.25), ("a", "s2", 0.75)], "region string, station_name string, population_weight double")
    r = W.with_degree_days(W.region_weather(hours, weights)).first()
    assert r["temperature_2m"] == pytest.approx(17.5 * 9 / 5 + 32) and r["relative_humidity_2m"] == pytest.approx(50.0)
    assert r["hdd_65f"] == pytest.approx(65 - 63.5) and r["cdd_65f"] == 0.0


@pytest.fixture(scope="module")
def hot(spark):
    """One region holds most rows, and one of its hours has thousands of copies."""
    hours = spark.range(30_000).select(
        F.when(F.col("id") % 10 < 8, "hot").otherwise(F.concat(F.lit("r"), (F.col("id") % 10).cast("string"))).alias("region"),
        F.timestamp_seconds(F.lit(1_700_000_000 // 3600 * 3600) + F.col("id") * 3600).alias("time_utc"),
        F.when(F.col("id") % 7 != 0, F.col("id").cast("double")).alias("load_mw"),
        F.col("id").alias("ord"),
    )
    copies = hours.where("ord = 11").drop("ord").crossJoin(spark.range(5_000).select((F.col("id") + 100_000).alias("ord")))
    return hours.unionByName(copies).cache()


def test_hot_region_dedup_and_windows(hot):
    panel = P.keep_last(hot, ["ord"])
    assert panel.count() == 30_000 and panel.where("ord = 104999").count() == 1
    w = Window.partitionBy("region").orderBy("time_utc")
    want = panel.select("ord", F.lag("load_mw", 24).over(w).alias("x"), F.avg("load_mw").over(w.rowsBetween(-24, -1)).alias("m"))
    got = O.trailing_mean(O.lag_rows(panel, "load_mw", 24, "x", block_rows=500), "load_mw", 24, "m", block_rows=500)
    assert got.select("ord", "x", "m").exceptAll(want).count() == 0 and got.count() == 30_000


def test_hot_region_blocks_and_bounds(hot):
    blocks = P.missing_blocks(P.keep_last(hot, ["ord"]))
    assert blocks.agg(F.sum("block_rows").alias("n")).first()["n"] == hot.where("load_mw is null").count()
    assert D.with_region_bounds(hot).where("region_start > time_utc or region_end < time_utc").count() == 0
    assert P.panel_audit(hot).where("region = 'hot'").first()["duplicate_timestamps"] == 5_000


def test_materialize_lands_in_the_shared_folder(spark):
    df = materialize(spark.range(5), "five")
    assert df.count() == 5 and all(shared_dir(spark) in f for f in df.inputFiles())


def wide_load(spark, first, n):
    return spark.createDataFrame([(first + timedelta(hours=i), float(i), 2.0 * i) for i in range(n)], "time_utc timestamp, pge double, sce double")


def station_rows(spark, first, n, regions=("pge", "sce")):
    schema = "region string, station_name string, time_utc timestamp, " + ", ".join(f"{v} double" for v in K.WEATHER_VARS)
    rows = [(r, s, first + timedelta(hours=i), c, c, 50.0, 0.0, 0.0, 5.0, 0.0) for r in regions for s, c in (("s1", 10.0), ("s2", 20.0)) for i in range(n)]
    weights = [(r, s, w) for r in regions for s, w in (("s1", 1.0), ("s2", 3.0))]
    return spark.createDataFrame(rows, schema), spark.createDataFrame(weights, "region string, station_name string, population_weight double")


def test_build_panel(spark):
    from datetime import date

    from tidewatt.plans.flagship import build_panel

    hours, weights = station_rows(spark, datetime(2024, 1, 1), 30)
    load = wide_load(spark, datetime(2024, 1, 1), 24)
    panel = build_panel(hours, weights, load, date(2024, 1, 1), date(2024, 1, 2), ["pge", "sce"])
    assert panel.columns == K.PANEL_COLUMNS and panel.count() == 96
    assert panel.where("temperature_2m is not null").count() == 60 and panel.where("load_mw is not null").count() == 48
    assert panel.first()["temperature_2m"] == pytest.approx(63.5)
    with pytest.raises(ValueError, match="vea"):
        build_panel(hours, weights, load, date(2024, 1, 1), date(2024, 1, 1), ["pge", "vea"]).count()
    assert build_panel(hours, weights, load, date(2024, 1, 1), date(2024, 1, 1), ["vea"], allow_missing=True).count() == 24
    with pytest.raises(ValueError, match="nowhere"):
        build_panel(hours, weights, load, date(2024, 1, 1), date(2024, 1, 1), ["nowhere"])


def test_next_day_features_file(spark):
    from datetime import date

    from tidewatt.plans.flagship import next_day_features

    hours, weights = station_rows(spark, datetime(2024, 1, 8), 24)
    weather = W.region_weather(hours, weights.withColumn("population_weight", F.col("population_weight") / 4))
    ahead = W.load_long(wide_load(spark, datetime(2024, 1, 8, 17), 7), ["pge", "sce"])
    history = W.load_long(wide_load(spark, datetime(2024, 1, 1), 24), ["pge"])
    out = next_day_features(weather, ahead, history, date(2024, 1, 8))
    assert out.columns == K.NEXT_DAY_COLUMNS and out.count() == 48
    assert out.where("load_pred_mw is not null").count() == 14
    assert out.where("load_previous_week is not null").count() == 24
    assert next_day_features(weather, ahead, None, date(2024, 1, 8)).where("load_previous_week is not null").count() == 0
    with pytest.raises(ValueError, match="Incomplete day"):
        next_day_features(weather.where("hour(time_utc) < 23"), ahead, None, date(2024, 1, 8))


def test_compare_run_directories(spark, tmp_path):
    from tidewatt.plans.flagship import compare_model_runs, compare_monthly_runs

    monthly, single = tmp_path / "monthly", tmp_path / "single"
    monthly.mkdir()
    single.mkdir()
    head = "region,time_key,time_utc,actual_load_mw,predicted_load_mw\n"
    for model, shift in (("ridge", 5), ("gam", 1)):
        lines = "".join(f"pge,2025-01-01:{h:02d},2025-01-01 {h:02d}:00:00,100,{100 + shift}\n" for h in range(3))
        (monthly / f"{model}_2025-01_predictions.csv").write_text(head + lines)
        (monthly / f"{model}_2025-01_metrics.csv").write_text(f"model,RMSE,MAE\n{model},{shift}.0,{shift}.0\n")
        (single / f"{model}_predictions.csv").write_text(head + lines)
        (single / f"{model}.csv").write_text(f"model,RMSE\nThe {model},{shift}.0\n")
    (single / "other.csv").write_text("a,b\n1,2\n")
    out = compare_monthly_runs(spark, str(monthly))
    assert {(r["model"], float(r["RMSE"])) for r in out["summary"].collect()} == {("ridge", 5.0), ("gam", 1.0)}
    assert {(r["model"], r["RMSE"]) for r in out["recomputed"].collect()} == {("ridge", 5.0), ("gam", 1.0)}
    assert {(r["model"], r["rank"]) for r in out["ranks"].collect()} == {("ridge", 2), ("gam", 1)}
    out = compare_model_runs(spark, str(single))
    assert {r["model"] for r in out["summary"].collect()} == {"the_ridge", "the_gam"}
    assert {(r["model"], r["MAE_overlap"], r["rows_in_common_window"]) for r in out["overlap"].collect()} == {("ridge", 5.0, 3), ("gam", 1.0, 3)}
    assert out["by_hour"].count() == 6 and out["first_week"].count() == 6
    with pytest.raises(ValueError, match="No recognized"):
        compare_model_runs(spark, str(tmp_path / "single" / "other.csv"))
