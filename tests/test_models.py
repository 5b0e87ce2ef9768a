from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import hours
from tidewatt import constants as K
from tidewatt.models import additive, backtest, linear, seasonal, trees
from tidewatt.models import basis as B
from tidewatt.models import features as FT
from tidewatt.models import preprocess as PP
from tidewatt.models.gram import gram, grams_by, solve_by
from tidewatt.operators import evaluate as E
from tidewatt.operators import panel as P
from tidewatt.operators import quantiles as Q

SCHEMA = ", ".join(
    f"{c} {'string' if c in ('region', 'time_key') else 'timestamp' if c == 'time_utc' else 'double'}" for c in K.REVISED_COLUMNS
)


def revised_rows(start, n, regions=("caiso", "pge"), seed=1):
    rng = np.random.default_rng(seed)
    out = []
    for k, region in enumerate(regions):
        for i in range(n):
            t = datetime.fromisoformat(start) + timedelta(hours=i)
            temp = float(60 + 15 * np.sin(2 * np.pi * t.hour / 24) + rng.normal())
            weather = [temp, temp - 2, float(rng.uniform(20, 80)), 0.0, float(rng.uniform(0, 100)), 5.0, 100.0]
            load = 2000.0 + 500 * k + 20 * temp + 100 * np.cos(2 * np.pi * t.hour / 24) + rng.normal() * 5
            out.append(
                (region, t.strftime("%Y-%m-%d:%H"), t, *map(float, weather), max(temp - 65, 0.0), max(65 - temp, 0.0), float(load),
                 float(t.weekday() >= 5), 0.0, 0.0, float(load + rng.normal() * 20))
            )
    return out


@pytest.fixture(scope="module")
def revised(spark):
    return spark.createDataFrame(revised_rows("2025-01-01", 24 * 40), SCHEMA).cache()


def test_gram_equals_numpy(spark):
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(500, 4)), rng.normal(size=500)
    df = spark.createDataFrame([(int(i % 3), list(map(float, r)), float(v)) for i, (r, v) in enumerate(zip(x, y))], "k int, x array<double>, y double").repartition(90)
    g = gram(df)
    assert np.allclose(g.xtx, x.T @ x) and np.allclose(g.xty, x.T @ y) and g.n == 500
    betas = {r["key"]: r["beta"] for r in solve_by(grams_by(df, F.col("k")), np.zeros((4, 4))).collect()}
    for k in range(3):
        pick = np.arange(500) % 3 == k
        assert np.allclose(betas[str(k)], np.linalg.lstsq(x[pick], y[pick], rcond=None)[0])


def test_ridge_equals_closed_form(spark, revised):
    train = FT.with_calendar(revised)
    ready = FT.fit_features(train)(train)
    rows = ready.select("features", "load_mw").collect()
    x = np.array([r["features"].toArray() for r in rows])
    y = np.array([r["load_mw"] for r in rows])
    xc = x - x.mean(axis=0)
    w = np.linalg.solve(xc.T @ xc + 10.0 * np.eye(x.shape[1]), xc.T @ (y - y.mean()))
    want = y.mean() + xc @ w
    got = linear.fit_ridge(train, alpha=10.0)(train).select("region", "time_utc", "predicted_load_mw").collect()
    by_key = {(r["region"], r["time_utc"]): r["predicted_load_mw"] for r in got}
    keys = [(r["region"], r["time_utc"]) for r in ready.select("region", "time_utc").collect()]
    assert np.allclose([by_key[k] for k in keys], want, rtol=1e-8)


def test_linear_equals_least_squares(spark, revised):
    train = FT.with_calendar(revised)
    rows = FT.fit_features(train)(train).select("region", "time_utc", "features", "load_mw").collect()
    x = np.column_stack([np.ones(len(rows)), np.array([r["features"].toArray() for r in rows])])
    want = x @ np.linalg.lstsq(x, np.array([r["load_mw"] for r in rows]), rcond=None)[0]
    scored = linear.fit_linear(train)(train).select("region", "time_utc", "predicted_load_mw").collect()
    got = {(r["region"], r["time_utc"]): r["predicted_load_mw"] for r in scored}
    assert np.allclose([got[r["region"], r["time_utc"]] for r in rows], want, rtol=1e-6)


def test_eps_insensitive_resists_outliers(spark):
    rows = [r[:12] + (50_000.0,) + r[13:] if i % 50 == 0 else r for i, r in enumerate(revised_rows("2025-01-01", 24 * 20))]
    df = FT.with_calendar(spark.createDataFrame(rows, SCHEMA))
    robust = linear.fit_eps_insensitive(df, c=1000.0, max_iter=30)(df)
    plain = linear.fit_linear(df)(df)
    error = lambda d: d.where("load_mw < 40000").agg(F.avg(F.abs(F.col("load_mw") - F.col("predicted_load_mw"))).alias("e")).first()["e"]
    assert error(robust) < 30 < error(plain)


def test_features_ignore_unknown_region_and_fill_absent_columns(spark, revised):
    transform = FT.fit_features(FT.with_calendar(revised))
    other = FT.with_calendar(revised.limit(2).withColumn("region", F.lit("new"))).drop("temperature_2m")
    rows = transform(other).collect()
    assert all(list(r["features"].toArray()[-2:]) == [0.0, 0.0] for r in rows) and "load_mw" in transform(other).columns


@pytest.mark.parametrize("x", [-3.0, 0.0, 0.4, 5.0, 10.0, 12.5])
def test_bases_sum_to_one(spark, x):
    df = spark.createDataFrame([(x,)], "x double")
    r = df.select(
        B.spline_basis(F.col("x"), 0.0, 10.0, 9).alias("s"), B.cyclic_basis(F.col("x"), 0.0, 10.0, 7).alias("c"),
        B.cyclic_basis(F.col("x") + 10, 0.0, 10.0, 7).alias("c2"), B.one_hot(F.col("x"), 6).alias("h"),
    ).first()
    assert len(r["s"]) == 9 and sum(r["s"]) == pytest.approx(1.0)
    assert len(r["c"]) == 7 and sum(r["c"]) == pytest.approx(1.0) and r["c"] == pytest.approx(r["c2"])
    assert sum(r["h"]) == (1.0 if x in (0.0, 5.0) else 0.0) and len(r["h"]) == 6


def test_rows_of_a_task_equal_the_expressions(spark):
    from tidewatt.models import rows as R

    xs = np.array([-3.0, 0.0, 0.4, 1.0, 2.5, 6.999, 7.0, 9.5, 23.99])
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(xs)], "i int, x double").orderBy("i")
    x = F.col("x")
    for column, array in (
        (B.spline_basis(x, 0.0, 7.0, 9), R.spline(xs, 0.0, 7.0, 9)),
        (B.spline_basis(x, 2.0, 2.0, 6), R.spline(xs, 2.0, 2.0, 6)),
        (B.cyclic_basis(x, 0.0, 24.0, 6), R.cyclic(xs, 0.0, 24.0, 6)),
        (B.one_hot(x, 4), R.one_hot(xs, 4)),
        (B.fourier(x, 7.0, 3), R.fourier(xs, 7.0, 3)),
        (B.hinges(x / 24, 5), R.hinges(xs / 24, 5)),
    ):
        assert np.allclose(np.array([r["v"] for r in df.select("i", column.alias("v")).orderBy("i").collect()]), array, atol=1e-12)
    assert np.isnan(R.spline(np.array([np.nan]), 0.0, 1.0, 5)).all() and len(R.complete(np.array([[1.0], [np.nan]]), np.zeros(2))[0]) == 1


def test_splines_continue_as_straight_lines(spark):
    weights = np.random.default_rng(3).normal(size=9)
    df = spark.createDataFrame([(v,) for v in (10.0, 11.0, 12.0, 13.0)], "x double").select(B.spline_basis(F.col("x"), 0.0, 10.0, 9).alias("s"))
    y = [float(np.dot(r["s"], weights)) for r in df.collect()]
    assert y[1] - y[0] == pytest.approx(y[2] - y[1]) == pytest.approx(y[3] - y[2])


def test_additive_model_recovers_the_shape(spark, revised):
    data = FT.month_data(revised, "2025-02")
    model, lagged = additive.fit_additive_split(data.train, data.valid)
    assert model.train_rows == 2 * (31 * 24 - 24)  # the first 24 rows of each region have no lag
    m = E.metrics(model.predict(lagged).withColumnRenamed("load_mw", "actual_load_mw")).first()
    assert m["MAPE"] < 3.0
    band = model.partial_effect(spark, "temperature_2m", points=11).collect()
    assert len(band) == 11 and all(r["lower"] <= r["effect"] <= r["upper"] for r in band)


def test_unseen_region_is_an_error(spark, revised):
    data = FT.month_data(revised, "2025-02")
    with pytest.raises(ValueError, match="caiso"):
        FT.require_known_regions(data.train.where("region = 'pge'"), data.valid)


def test_hourly_additive_and_seasonal(spark, revised):
    data = FT.month_data(revised, "2025-02")
    hourly = additive.fit_additive_by_hour(data.train, data.valid, n_splines=6)
    assert hourly.count() == data.valid.count()
    assert E.metrics(hourly).first()["MAPE"] < 5.0
    scored = seasonal.fit_seasonal_by_region(data.train)(data.valid)
    assert scored.where("predicted_load_mw < 0 or predicted_load_mw is null").count() == 0
    assert E.metrics(scored.withColumnRenamed("load_mw", "actual_load_mw")).first()["MAPE"] < 5.0


def test_trees_beat_the_mean(revised):
    data = FT.month_data(revised, "2025-02")
    std = data.valid.agg(F.stddev_pop("load_mw").alias("s")).first()["s"]
    for fit in (lambda d: trees.fit_forest(d, n_estimators=5, max_depth=6), lambda d: trees.fit_boosted(d, n_estimators=5, learning_rate=0.5)):
        scored = fit(data.train)(data.valid).withColumnRenamed("load_mw", "actual_load_mw")
        assert E.metrics(scored).first()["RMSE"] < std


@pytest.mark.parametrize("values", [[1.0, 1.0, 1.0, 9.0], list(map(float, range(101))), [5.0], [2.0] * 500 + [3.0] * 499 + [-1.0]])
@pytest.mark.parametrize("q", [0.0, 0.25, 0.5, 0.99, 1.0])
def test_exact_quantile(spark, values, q):
    df = spark.createDataFrame([(v,) for v in values] + [(None,), (float("nan"),)], "v double")
    for small in (3, 10_000):
        assert Q.exact_quantile(df, "v", q, accuracy=50, small=small) == pytest.approx(np.quantile(values, q))


def test_medians_short_and_long_paths_agree(spark):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([("a" if i % 3 else "b", float(v)) for i, v in enumerate(rng.normal(size=400))], "region string, v double")
    assert Q.exact_medians(df, ["v"], small=10)["v"] == pytest.approx(Q.exact_medians(df, ["v"])["v"])
    a, b = Q.exact_medians_by(df, "region", ["v"]), Q.exact_medians_by(df, "region", ["v"], small=150)
    assert all(a[k]["v"] == pytest.approx(b[k]["v"]) for k in "ab")
    assert Q.exact_quantile(df.where("false"), "v") is None


@pytest.mark.parametrize("small", [5, 1_000_000])
def test_quantiles_of_many_columns_and_groups(spark, small):
    rng = np.random.default_rng(6)
    made = []
    for i in range(1200):
        x = float(rng.normal())
        made.append((f"g{i % 7}" if i % 11 else None, x, None if i % 3 else round(x, 1), 5.0, float("nan") if i % 2 else x * 1e9, None))
    df = spark.createDataFrame(made, "g string, a double, b double, c double, d double, e double").repartition(4)
    for q in (0.0, 0.3, 0.5, 1.0):
        got = {r["g"]: tuple(r)[1:] for r in Q.exact_quantiles(df, list("abcde"), q, ["g"], accuracy=60, small=small).collect()}
        assert None not in got and len(got) == 7
        for g, values in got.items():
            own = [r for r in made if r[0] == g]
            for k, v in enumerate(values, 1):
                present = [r[k] for r in own if r[k] is not None and r[k] == r[k]]
                assert v == pytest.approx(np.quantile(present, q)) if present else v is None


def test_twenty_medians_cost_the_jobs_of_two(spark):
    df = spark.range(300).select("id", *[(F.col("id") * 37 % (7 + k) * 1.0).alias(f"c{k}") for k in range(20)])
    tracker = spark.sparkContext.statusTracker()

    def jobs(columns):
        group = f"medians-{len(columns)}"
        spark.sparkContext.setJobGroup(group, group)
        out = Q.exact_medians(df, columns)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return len(tracker.getJobIdsForGroup(group)), out

    two, twenty = jobs(["c0", "c1"]), jobs([f"c{k}" for k in range(20)])
    assert twenty[0] <= two[0] and all(twenty[1][c] == np.median([i * 37 % (7 + int(c[1:])) for i in range(300)]) for c in twenty[1])


def test_imputer_and_scaler(spark):
    df = spark.createDataFrame([(1.0, "x"), (None, "y"), (3.0, "y"), (8.0, None), (None, "x")], "v double, c string")
    rows = PP.fit_imputer(df, ["v"], ["c"])(df).collect()
    assert [r["v"] for r in rows] == [1.0, 3.0, 3.0, 8.0, 3.0] and rows[3]["c"] == "x"  # tie goes to the smallest
    flat = spark.createDataFrame([(2.0, 1.0), (2.0, 3.0)], "flat double, v double")
    assert [tuple(r) for r in PP.fit_scaler(flat, ["flat", "v"])(flat).collect()] == [(0.0, -1.0), (0.0, 1.0)]
    scale = PP.fit_target_scale(flat, "v")
    assert flat.select(scale.invert(scale.apply(F.col("v"))).alias("v")).collect()[1]["v"] == 3.0
    with pytest.raises(ValueError, match="levels"):
        PP.level_counts(spark.range(20).withColumn("c", F.col("id").cast("string")), "c", limit=5)


# ---- the next-day job ---------------------------------------------------------------------


@pytest.fixture(scope="module")
def next_day(spark):
    history = spark.createDataFrame(revised_rows("2026-04-20", 48), SCHEMA).cache()
    ahead = (
        spark.createDataFrame(revised_rows("2026-04-27", 24, seed=2), SCHEMA)
        .withColumnRenamed("load_mw", "load_pred_mw")
        .drop(*K.FEATURE_COLUMNS)
    )
    return history, ahead.cache()


def with_features(ahead, history):
    from tidewatt.functions.holidays import with_calendar_flags

    return P.with_week_lag(with_calendar_flags(ahead), history)


def test_next_day_features(spark, next_day):
    history, ahead = next_day
    out = with_features(ahead, history)
    assert set(K.FEATURE_COLUMNS) <= set(out.columns)
    assert out.where("load_previous_week is null").count() == 0
    assert with_features(ahead, history.limit(0)).where("load_previous_week is not null").count() == 0


def test_next_day_ridge(next_day):
    history, ahead = next_day
    out = backtest.score_next_day(history, with_features(ahead, history), "ridge")
    assert out.columns == ["region", "time_key", "time_utc", "load_pred_mw", "predicted_load_mw"]
    assert out.where("predicted_load_mw is not null").count() == 48


def test_next_day_sequences_cover_exactly_the_day(next_day):
    history, ahead = next_day
    assert backtest.next_day_sequences(history, ahead, ["temperature_2m"], 24).count() == 48
    with pytest.raises(ValueError, match="No sequences were created"):
        backtest.next_day_sequences(history, ahead, ["temperature_2m"], 100)


def test_next_day_missing_feature_is_zero(next_day):
    history, ahead = next_day
    out = backtest.score_next_day(history, with_features(ahead, history).drop("temperature_2m"), "ridge")
    assert out.where("predicted_load_mw is not null").count() == 48


def test_next_day_without_usable_rows(next_day):
    history, ahead = next_day
    with pytest.raises(ValueError, match="next-day rows"):
        backtest.score_next_day(history, with_features(ahead, history.limit(0)), "ridge")
    with pytest.raises(ValueError, match="Unsupported model"):
        backtest.build_model("lstm")


BASELINE = "region string, time_utc timestamp, load_pred_mw double, predicted_load_mw double"


def test_baseline_evaluation(spark):
    rows = [("caiso", datetime(2026, 4, 27, i), 2000.0 + i, 2005.0 + i) for i in range(10)]
    r = E.against_baseline(spark.createDataFrame(rows, BASELINE)).first()
    assert r["RMSE"] == pytest.approx(5.0) and r["BIAS"] == 5.0 and r["MSE"] == pytest.approx(r["RMSE"] ** 2)
    sparse = spark.createDataFrame([("a", None, 2000.0, 2005.0), ("a", None, None, 1.0)], BASELINE)
    assert E.against_baseline(sparse).first()["RMSE"] == pytest.approx(5.0)
    with pytest.raises(ValueError, match="load_pred_mw"):
        E.against_baseline(sparse.drop("load_pred_mw", "predicted_load_mw"))
    with pytest.raises(ValueError, match="No rows"):
        E.against_baseline(sparse.where("load_pred_mw is null"))


def test_metrics_of_zero_actuals(spark):
    df = spark.createDataFrame([(0.0, 1.0), (0.0, 3.0)], "actual_load_mw double, predicted_load_mw double")
    r = E.metrics(df).first()
    assert r["MAPE"] is None and r["MAE"] == 2.0


def test_histogram_and_rank(spark):
    df = spark.createDataFrame([("a", 0.0), ("a", 60.0), ("a", 59.99), ("b", 5.0), ("b", 5.0)], "model string, v double")
    rows = E.histogram(df, F.col("v")).where("frequency > 0").orderBy("model", "bin").collect()
    assert [(r["model"], r["bin"], r["frequency"]) for r in rows] == [("a", 0, 1), ("a", 59, 2), ("b", 30, 2)]
    ranks = E.rank_in_month(spark.createDataFrame([("a", "m", 1), ("b", "m", 1), ("c", "m", 2), ("d", "m", None)], "model string, month string, x int"), "x")
    assert [(r["model"], r["rank"]) for r in ranks.orderBy("model").collect()] == [("a", 1), ("b", 1), ("c", 3)]


@pytest.fixture(scope="module")
def with_gaps(spark, revised):
    """The panel with gaps in the weather, one region from its second week on, and a column that is constant."""
    hole = lambda c, k, m: F.when(F.hash("time_utc", "region", F.lit(c)) % k != m, F.col(c))
    late = revised.where("region = 'pge' and time_utc >= timestamp'2025-01-09'").withColumn("region", F.lit("sce")).withColumn("load_mw", F.col("load_mw") * 1.3 + 50)
    both = revised.unionByName(late)
    return both.withColumns({c: hole(c, k, 0) for c, k in (("temperature_2m", 9), ("cloud_cover", 5), ("relative_humidity_2m", 7), ("load_previous_week", 31))}).cache()


def test_sweep_equals_single_runs(with_gaps):
    from tidewatt.models.sweep import SWEPT, sweep

    days, months = with_gaps.withColumn("time_utc", F.col("time_utc") + F.expr("INTERVAL 17 DAYS")), ["2025-02"]
    models = {"linear": {}, "ridge": {"alpha": 10.0}, "additive": {"n_splines": 9}, "seasonal": {"changepoint_scale": 0.1}}
    assert set(models) == set(SWEPT)
    predictions, trained, failures = sweep(days, models, months)
    assert not failures and {r["train_rows_used"] for r in trained.collect()} == {P.usable_rows(days.where("time_utc < timestamp'2025-02-01'")).count()}
    rows = predictions.collect()
    for name, params in models.items():
        single, _ = backtest.run_month(days, name, months[0], **params)
        want = {(r["region"], r["time_utc"]): r["predicted_load_mw"] for r in single.collect()}
        got = {(r["region"], r["time_utc"]): r["predicted_load_mw"] for r in rows if r["model"] == name}
        assert got.keys() == want.keys() and len(got) > 100
        assert max(abs(got[k] / want[k] - 1) for k in want) < (1e-6 if name == "linear" else 1e-8)


def test_sweep_of_many_months_scans_the_rows_once(spark, with_gaps):
    from tidewatt.models import sweep as W

    rows = with_gaps.crossJoin(spark.range(4).select((F.col("id") * 40).cast("int").alias("shift")))  # 160 days in a row
    rows = rows.withColumn("time_utc", F.timestamp_seconds(F.unix_timestamp("time_utc") + F.col("shift") * 86400)).drop("shift")
    months = ["2025-03", "2025-02", "2025-05", "2024-06"]
    models = {"ridge": {}, "additive": {"n_splines": 8}, "seasonal": {}}
    predictions, trained, failures = W.sweep(rows, models, months, {("ridge", "2025-03")})
    assert {(n, m) for n, m, _ in failures} == {(n, "2024-06") for n in models}
    got = {(r["model"], r["month"]): r for r in predictions.groupBy("model", "month").agg(F.count("*").alias("n"), F.sum("squared_error").alias("e")).collect()}
    assert set(got) == {(n, m) for n in models for m in months[:3]} - {("ridge", "2025-03")}
    for name, month in (("ridge", "2025-05"), ("additive", "2025-03"), ("seasonal", "2025-05")):
        single, metrics = backtest.run_month(rows, name, month, **models[name])
        row = metrics.first()
        assert got[name, month]["n"] == row["validation_rows_scored"]
        assert got[name, month]["e"] / got[name, month]["n"] == pytest.approx(row["MSE"], rel=1e-7)
    # Scoring reads the prepared rows once, whatever the months and models.
    plan = predictions._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") == 1 and plan.count("MapInArrow") == 1
    with pytest.raises(ValueError, match="no setting"):
        W.sweep(rows, {"ridge": {"beta": 1}}, months)


def test_any_error_of_a_pair_leaves_the_others(spark, revised, tmp_path, monkeypatch):
    def broken(**kw):
        raise RuntimeError("no memory")

    monkeypatch.setitem(backtest.MODELS, "boosted", broken)
    table, failures = backtest.backtest(revised, {"boosted": {}, "ridge": {}}, ["2025-02"], str(tmp_path))
    assert [(n, m) for n, m, _ in failures] == [("boosted", "2025-02")] and {r["model"] for r in table.collect()} == {"ridge"}


def test_backtest_skips_finished(spark, revised, tmp_path):
    folder = str(tmp_path / "runs")
    table, failures = backtest.backtest(revised, {"linear": {}, "ridge": {}}, ["2025-02"], folder)
    assert table.count() == 2 and not failures
    assert table.first()["validation_rows_scored"] == 2 * 9 * 24
    before = {f.name for f in (tmp_path / "runs" / "metrics").rglob("*.parquet")}
    again, failures = backtest.backtest(revised, {"linear": {}, "ridge": {}}, ["2025-02", "2030-01"], folder)
    assert again.count() == 2 and [f[:2] for f in failures] == [("linear", "2030-01"), ("ridge", "2030-01")]
    assert before == {f.name for f in (tmp_path / "runs" / "metrics").rglob("*.parquet")}
    predictions = spark.read.parquet(f"{folder}/predictions")
    assert predictions.where("model = 'ridge' and ape_percent >= 0").count() == 2 * 9 * 24


def test_eps_insensitive_is_at_its_optimum(spark):
    rng = np.random.default_rng(7)
    df = FT.with_calendar(spark.createDataFrame(revised_rows("2025-01-01", 24 * 6), SCHEMA))
    names = ["temperature_2m", "load_previous_week", "hour_sin"]
    small = df.select("region", "time_utc", "load_mw", *names)
    c, epsilon = 50.0, 5.0
    ready = FT.fit_features(small)(small).select("region", "time_utc", "features", "load_mw").collect()
    x = np.column_stack([np.array([r["features"].toArray() for r in ready]), np.ones(len(ready))])
    y = np.array([r["load_mw"] for r in ready])
    scored = linear.fit_eps_insensitive(small, c=c, epsilon=epsilon, max_iter=40)(small)
    got = {(r["region"], r["time_utc"]): r["predicted_load_mw"] for r in scored.collect()}
    fitted = np.array([got[r["region"], r["time_utc"]] for r in ready])
    w = np.linalg.lstsq(x, fitted, rcond=None)[0]
    cost = lambda v: 0.5 * v @ v + c * np.maximum(np.abs(y - x @ v) - epsilon, 0).sum()
    # The one-hot and intercept columns are collinear, so compare against the cheapest equal fit.
    base = min(cost(w), cost(np.linalg.pinv(x) @ fitted))
    for scale in (0.01, 0.1, 1.0, 10.0):
        for _ in range(50):
            assert cost(w + rng.normal(size=len(w)) * scale) > base * 0.995
