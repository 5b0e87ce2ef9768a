from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tests.conftest import hours
from tidewatt.operators import ordered as O
from tidewatt.operators import panel as P
from tidewatt.operators import reconcile as R


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


def test_spine_has_24_hours_a_day(spark, panel_of):
    assert P.hour_spine(spark, date(2024, 2, 28), date(2024, 3, 1)).count() == 72
    panel = panel_of(hours("2024-03-01T05:00", 3) + hours("2024-03-02T01:00", 1, "pge"))
    spine = P.region_spine(panel)
    assert spine.count() == 24 * 2 * 2
    assert P.reindex(panel, spine).where("load_mw is not null").count() == 4


def test_week_lag_is_by_clock_and_fans_out(panel_of):
    panel = panel_of(hours("2024-01-01T00:00", 170, skip={1}) + [("caiso", datetime(2024, 1, 1, 0), 99.0)])
    lagged = P.with_week_lag(panel)
    at = {t: [] for t in (168, 169)}
    for r in lagged.collect():
        n = int((r["time_utc"] - datetime(2024, 1, 1)).total_seconds() // 3600)
        if n in at:
            at[n].append(r["load_previous_week"])
    assert sorted(at[168]) == [0.0, 99.0]  # two rows a week earlier
    assert at[169] == [None]  # the hour itself is missing, row lag does not step in
    assert P.lag_validate(P.with_week_lag(panel_of(hours("2024-01-01T00:00", 200)))).first()["incorrect_rows"] == 0


def test_lag_validation_counts_null_as_wrong(panel_of):
    lagged = P.with_week_lag(panel_of(hours("2024-01-01T00:00", 171)))
    broken = lagged.withColumn(
        "load_previous_week", F.when(F.hour("time_utc") == 1, F.col("load_previous_week")).when(F.hour("time_utc") == 2, 7.5)
    )
    r = P.lag_validate(broken).first()
    assert (r["total_rows"], r["rows_with_history"], r["correct_rows"], r["incorrect_rows"]) == (171, 3, 1, 2)
    assert P.lag_bad_rows(broken).count() == 2


def test_empty_history_leaves_lag_null(spark, panel_of):
    panel = panel_of(hours("2024-01-08T00:00", 24))
    for lagged in (P.with_week_lag(panel, panel_of([])), P.without_history(panel)):
        assert lagged.where("load_previous_week is not null").count() == 0
        assert lagged.count() == 24


def test_dedup_keeps_last_and_is_idempotent(panel_of):
    data = [("a", datetime(2024, 1, 1), float(i), i) for i in range(50)] + [("b", datetime(2024, 1, 1), 1.0, 0)]
    parts = panel_of(data, "region string, time_utc timestamp, load_mw double, ord int")
    once = P.keep_last(parts, ["ord"])
    assert rows(once, "region", "load_mw") == [("a", 49.0), ("b", 1.0)]
    assert rows(P.keep_last(once, ["ord"]), "region", "load_mw") == rows(once, "region", "load_mw")
    assert P.dedup_report(parts).first().asDict() == {"rows_before": 51, "rows_after": 2, "rows_removed": 49}


def test_audit_counts_gaps_and_duplicates(panel_of):
    panel = panel_of(hours("2024-01-31T20:00", 30, skip={5, 6, 7, 20}) + [("caiso", datetime(2024, 1, 31, 20), 5.0)])
    r = P.panel_audit(panel).first()
    assert (r["actual_rows"], r["expected_hourly_rows"], r["duplicate_timestamps"]) == (27, 30, 1)
    assert (r["num_gaps_gt_1h"], r["largest_gap_hours"]) == (2, 4.0)


def test_single_row_region_has_no_gap(panel_of):
    r = P.panel_audit(panel_of([("x", datetime(2024, 1, 1, 3), None)])).first()
    assert (r["num_gaps_gt_1h"], r["largest_gap_hours"], r["load_present_rows"], r["first_load_present_utc"]) == (0, 0.0, 0, None)


def test_missing_blocks_span_months(panel_of):
    missing = set(range(2, 5)) | set(range(20, 60))
    panel = panel_of(hours("2024-01-31T00:00", 100, load=lambda i: None if i in missing else 1.0))
    got = rows(P.missing_blocks(panel), "block_start", "block_rows")
    assert got == [(datetime(2024, 1, 31, 2), 3), (datetime(2024, 1, 31, 20), 40)]
    assert P.first_blocks(P.missing_blocks(panel), 1).first()["more_blocks"] == 1


@pytest.mark.parametrize("block", [3, 7, 1000])
def test_lookback_equals_plain_window(panel_of, block):
    data = hours("2024-01-20T00:00", 400, "a", skip=set(range(50, 330))) + hours("2024-01-30T00:00", 5, "b")
    panel = panel_of([(r, t, None if i % 11 == 0 else v) for i, (r, t, v) in enumerate(data)])
    w = Window.partitionBy("region").orderBy("time_utc")
    want = panel.select(
        "region", "time_utc", F.lag("load_mw", 6).over(w).alias("x"), F.avg("load_mw").over(w.rowsBetween(-6, -1)).alias("m"),
        (F.row_number().over(w) - 1).alias("n"),
    )
    got = O.with_ordinal(
        O.trailing_mean(O.lag_rows(panel, "load_mw", 6, "x", block_rows=block), "load_mw", 6, "m", block_rows=block), name="n"
    )
    cols = ("region", "time_utc", "x", "m", "n")
    assert rows(got, *cols) == rows(want, *cols)


def test_sequences_drop_short_groups(panel_of):
    panel = panel_of(hours("2024-01-01T00:00", 10, "a") + hours("2024-01-01T00:00", 4, "b"))
    got = O.lookback_sequences(panel, ["load_mw"], 4, block_rows=4)
    assert got.where("region = 'b'").count() == 0
    first = got.orderBy("time_utc").first()
    assert [x[0] for x in first["sequence"]] == [0.0, 1.0, 2.0, 3.0] and got.count() == 6
    with pytest.raises(ValueError, match="No sequences were created"):
        O.require_sequences(O.lookback_sequences(panel, ["load_mw"], 100))


def test_join_small_falls_back_to_a_plain_join(spark):
    left = spark.range(100).withColumn("k", F.col("id") % 10)
    small = spark.range(10).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    a, b = O.join_small(left, small, ["k"]), O.join_small(left, small, ["k"], limit=3)
    assert rows(a, "id", "v") == rows(b, "id", "v") and a.count() == 100


def test_group_stats_keep_rows_with_null_key(spark):
    df = spark.createDataFrame([("a", 1.0), (None, 2.0), ("a", 3.0)], "region string, v double")
    assert O.attach_group_stats(df, ["region"], top=F.max("v")).count() == 3


def test_month_bounds():
    assert P.month_bounds("2024-12") == (datetime(2024, 12, 1), datetime(2025, 1, 1), datetime(2024, 11, 30, 23, 59, 59))
    assert P.month_bounds("2024-02")[1] == datetime(2024, 3, 1)
    for bad in ("2024-13", "2024", "x-1", "2024-00"):
        with pytest.raises(ValueError):
            P.month_bounds(bad)


def test_unknown_region_and_missing_columns_are_errors(panel_of):
    panel = panel_of(hours("2024-01-01T00:00", 2))
    with pytest.raises(ValueError, match="nowhere"):
        P.keep_regions(panel, ["caiso", "nowhere"])
    with pytest.raises(ValueError, match=r"\['a', 'b'\]"):
        P.require_columns(panel, ["region", "b", "a"])
    assert P.preferred_order(panel, ["load_mw", "absent", "region"]).columns == ["load_mw", "region", "time_utc"]


def test_target_day_defaults_to_tomorrow(spark, panel_of):
    tomorrow = spark.sql("select cast(date_add(current_date(), 1) as timestamp) as t").first()["t"]
    panel = panel_of([("a", tomorrow + timedelta(hours=h), 1.0) for h in (-1, 0, 23, 24)])
    assert P.target_day(panel).count() == 2


def test_complete_day(spark, panel_of):
    panel = panel_of(hours("2024-01-01T00:00", 24, "a") + hours("2024-01-01T00:00", 23, "b"))
    expected = spark.createDataFrame([("a",), ("b",)], "region string")
    with pytest.raises(ValueError, match="b=23"):
        P.require_complete_day(panel, expected)
    P.require_complete_day(panel.where("region = 'a'"), expected.where("region = 'a'"))


def test_coalesce_order_and_strategy(spark):
    parts = spark.createDataFrame(
        [(1, 0, None, 1.0), (1, 1, 5.0, 2.0), (2, 1, 7.0, None)], "time_utc int, part int, a double, b double"
    )
    assert rows(R.coalesce_parts(parts, ["a", "b"], "part"), "time_utc", "a", "b") == [(1, 5.0, 1.0), (2, 7.0, None)]
    assert rows(R.coalesce_parts(parts, ["a", "b"], "part", prefer="last"), "time_utc", "a", "b") == [(1, 5.0, 2.0), (2, 7.0, None)]
    a = spark.createDataFrame([(1, 1.0, None), (2, None, None)], "time_utc int, pge double, sce double")
    b = spark.createDataFrame([(2, 4.0, 9.0), (3, 5.0, 6.0)], "time_utc int, pge double, sce double")
    got, report = R.choose_source(lambda: a, lambda: b, ["pge", "sce"], "a_then_b")
    assert rows(got, "time_utc", "pge", "sce") == [(1, 1.0, None), (2, 4.0, 9.0), (3, 5.0, 6.0)]
    assert report == {"missing_before": 3, "missing_after": 1, "filled": 2}

    def broken():
        raise RuntimeError("source is down")

    assert R.choose_source(broken, lambda: b, ["pge"], "a_then_b")[0].count() == 2
    full = b.where("time_utc = 3")
    assert R.choose_source(broken, lambda: full, ["pge"], "b_then_a")[1]["filled"] == 0  # fallback never read
    assert R.missing_cells(a, ["pge", "absent"]) == 3
    with pytest.raises(ValueError):
        R.choose_source(lambda: a, lambda: b, ["pge"], "both")


def test_total_is_not_invented_when_reported(spark):
    wide = spark.createDataFrame([(1, 2.0, None), (2, None, None)], "time_utc int, pge double, sce double")
    assert rows(R.with_total(wide), "time_utc", "caiso") == [(1, 2.0), (2, None)]
    assert R.with_total(wide.withColumn("caiso", F.lit(0.0))).where("caiso <> 0").count() == 0
