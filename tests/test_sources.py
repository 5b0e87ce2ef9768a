import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidewatt import constants as K
from tidewatt.functions import scalar as S
from tidewatt.operators import evaluate as E
from tidewatt.operators import panel as P
from tidewatt.sources import area_load as A
from tidewatt.sources import files as SF
from tidewatt.sources import links as L
from tidewatt.sources import sheets as SH
from tidewatt.sources.weather_json import explode_hourly_json

HEAD = "region,time_key,time_utc,temperature_2m,apparent_temperature,relative_humidity_2m,precipitation,cloud_cover,wind_speed_10m,shortwave_radiation,cdd_65f,hdd_65f,load_mw"


def write_panel_csv(folder, name, rows):
    lines = [HEAD] + [f"{r},{t[:10]}:{t[11:13]},{t},1,1,1,0,0,5,0,0,0,{v}" for r, t, v in rows]
    (folder / name).write_text("\n".join(lines) + "\n")


def test_read_and_merge_panels(spark, tmp_path):
    write_panel_csv(tmp_path, "caiso_dataset_20240101_to_20240102.csv", [("pge", "2024-01-01 00:00:00", "5"), ("pge", "2024-01-01 01:00:00", "")])
    write_panel_csv(
        tmp_path,
        "caiso_dataset_20240101_to_20240105.csv",
        [("pge", "2024-01-01 00:00:00", "7"), ("sce", "2024-01-01 00:00:00", "1"), ("pge", "2024-01-01 00:00:00", "8")],
    )
    (tmp_path / "caiso_dataset_2024_to_20240105.csv").write_text("junk\n")
    merged = SF.merge_panels(SF.read_panel(spark, str(tmp_path)))
    got = {(r["region"], r["time_utc"].hour): r["load_mw"] for r in merged.collect()}
    assert got == {("pge", 0): 8.0, ("pge", 1): None, ("sce", 0): 1.0}  # last file, last row in it
    names = SF.with_file_span(SF.list_files(spark, str(tmp_path)))
    assert SF.infer_span(names).first()["file_name"] == "caiso_dataset_20240101_to_20240105.csv"


def test_bad_time_and_reversed_span_are_errors(spark, tmp_path):
    write_panel_csv(tmp_path, "caiso_dataset_20240101_to_20240102.csv", [("pge", "not a time", "5")])
    with pytest.raises(Exception, match="invalid time_utc"):
        SF.read_panel(spark, str(tmp_path)).collect()
    assert SF.read_panel(spark, str(tmp_path), strict=False).count() == 0
    reversed_name = spark.createDataFrame([("caiso_dataset_20240105_to_20240101.csv",)], "file_name string")
    with pytest.raises(Exception, match="no valid span"):
        SF.with_file_span(reversed_name).collect()
    assert SF.with_file_span(reversed_name, "flag").first()["span_ok"] == 0


@pytest.mark.parametrize(
    ("name", "want"),
    [
        ("hinge_regression_2025-12_metrics.csv", ("hinge_regression", "2025-12", "metrics")),
        ("My Model-x_2025-01_predictions.csv", ("my_model_x", "2025-01", "predictions")),
        ("a_2024-01_b_2025-02_metrics.csv", ("a_2024_01_b", "2025-02", "metrics")),
        ("tft_2025-1_metrics.csv", (None, None, None)),
    ],
)
def test_run_names(spark, name, want):
    r = spark.createDataFrame([(name,)], "n string").select(*[c.alias(k) for k, c in SF.parse_run_name(F.col("n")).items()]).first()
    assert (r["model"], r["month"], r["kind"]) == want


def test_load_runs(spark, tmp_path):
    (tmp_path / "ridge_2025-01_metrics.csv").write_text("model,RMSE,MAE\nx,5.0,4.0\ny,9.0,9.0\n")
    (tmp_path / "ridge_2025-01_predictions.csv").write_text(
        "region,time_key,time_utc,actual_load_mw,predicted_load_mw\npge,2025-01-01:00,2025-01-01 00:00:00,10,12\npge,2025-01-01:01,2025-01-01 01:00:00,n/a,12\n"
    )
    (tmp_path / "gam_2025-01_predictions.csv").write_text("region,time_utc\npge,2025-01-01 00:00:00\n")
    (tmp_path / "notes.csv").write_text("hello\n")
    metrics, predictions = SF.load_runs(spark, str(tmp_path))
    assert metrics.count() == 2 and {r["model"] for r in predictions.collect()} == {"ridge"}
    table = E.metrics_table(metrics).collect()
    assert [(r["model"], r["month"], float(r["RMSE"])) for r in table] == [("ridge", "2025-01", 5.0)]
    clean = E.clean_predictions(predictions)
    assert clean.count() == 1 and E.metrics_by_month(clean).first()["MAE"] == 2.0


def test_weather_payload(spark):
    body = {"hourly": {"time": ["2024-01-01T00:00", "2024-01-01T01:00"], "temperature_2m": [1.5, None]}}
    df = spark.createDataFrame([("a", json.dumps(body))], "station string, payload string")
    rows = explode_hourly_json(df, variables=["temperature_2m", "cloud_cover"]).orderBy("time_utc").collect()
    assert [(r["time_utc"].hour, r["temperature_2m"], r["cloud_cover"]) for r in rows] == [(0, 1.5, None), (1, None, None)]
    with pytest.raises(Exception, match="payload lacks cloud_cover"):
        explode_hourly_json(df, variables=["temperature_2m", "cloud_cover"], missing="error").collect()


CELLS = "workbook string, sheet string, row_idx int, cells array<string>"


def test_sheets(spark):
    rows = [("w", "a", i, ["Title", None, ""]) for i in range(3)]
    rows += [("w", "a", 3, ["OPR_DT", "Hour Ending", "PG&E TAC"])]
    rows += [("w", "a", 4, ["45658", "1", "100"]), ("w", "a", 5, ["1/1/2025", "2", "bad"]), ("w", "a", 6, ["2025-01-01", "1", "999"])]
    rows += [("w", "a", 7, ["Sum", "1", "5"])]
    rows += [("w", "late", 80, ["date", "hr", "sce"]), ("w", "late", 81, ["2025-01-01", "1", "3"])]
    rows += [("w", "noload", 0, ["date", "he", "foo"]), ("w", "noload", 1, ["2025-01-01", "1", "3"])]
    rows += [("w", "empty", 0, ["date", "he", "sce"])]
    cells = spark.createDataFrame(rows, CELLS)
    got = {r["time_utc"]: r["pge"] for r in SH.parse_sheets(cells).where("sheet = 'a'").collect()}
    assert got == {datetime(2025, 1, 1, 8): 100.0, datetime(2025, 1, 1, 9): None}  # first row of an hour stays
    audit = {r["sheet"]: (r["status"], r["reason"], r["rows"]) for r in SH.sheet_audit(cells).collect()}
    assert audit == {
        "a": ("parsed", "ok", 3),
        "late": ("skipped", "no_header_row_found", 0),
        "noload": ("skipped", "no_recognized_load_columns", 0),
        "empty": ("skipped", "empty_after_date_hr_cleaning", 0),
    }
    book = SH.workbook_audit(SH.sheet_audit(cells)).first()
    assert (book["num_sheets"], book["num_parsed_sheets"], book["best_sheet"]) == (4, 1, "a")


def test_month_coverage_edges(spark):
    spans = spark.createDataFrame(
        [("f", datetime(2024, 1, 31, 23), datetime(2024, 3, 1, 0)), ("g", datetime(2024, 5, 31, 23, 30), datetime(2024, 5, 31, 23, 40))],
        "file string, span_start timestamp, span_end timestamp",
    )
    got = {r["month_start"].month: r["file"] for r in SH.month_coverage(spans, SH.month_starts(spans)).collect()}
    assert got == {1: "f", 2: "f", 3: "f", 4: None, 5: None}  # g starts after the month's last hour


@pytest.mark.parametrize(
    ("name", "region"),
    [
        ("PGE-TAC", "pge"), (" pg&e_tac ", "pge"), ("SDG&E/TAC north", "sdge"), ("SCE", "sce"), ("VEA", "vea"), ("mwd tac", "mwd"),
        ("CAISO Total", "caiso"), ("System", "caiso"), ("iso", "caiso"), ("systems", None), ("CA ISO-TAC", None), ("BANC", None),
    ],
)
def test_area_names(spark, name, region):
    assert spark.createDataFrame([(name,)], "n string").select(S.area_to_region(F.col("n")).alias("r")).first()["r"] == region


def test_area_feed_columns(spark):
    raw = spark.createDataFrame([("PGE", "2025-07-01 00:00:00", 5.0)], "`Load Zone` string, `Interval Start-Local` string, `Actual` double")
    assert A.standardize_area_long(raw).first()["time_utc"] == datetime(2025, 7, 1, 7)
    with pytest.raises(ValueError, match="area column"):
        A.standardize_area_long(raw.drop("Load Zone"))
    with pytest.raises(ValueError, match="value column"):
        A.standardize_area_long(raw.withColumn("Other", F.lit(1)))
    with pytest.raises(ValueError, match="interval start"):
        A.standardize_area_long(raw.drop("Interval Start-Local"))
    ahead = spark.createDataFrame([("CA ISO-TAC", "2025-07-01T00:00:00-00:00", "x"), ("BANC", "2025-07-01T00:00:00-00:00", "1")], "TAC_AREA_NAME string, INTERVAL_START_GMT string, MW string")
    assert [(r["region"], r["load_mw"]) for r in A.standardize_day_ahead(ahead).collect()] == [("caiso", None)]
    with pytest.raises(ValueError, match="MW"):
        A.standardize_day_ahead(ahead.drop("MW"))


def test_links(spark):
    html = """<a HREF = "/a/x.xlsx">1</a><a href='rel.XLSX'>2</a><a href="/a/x.xlsx">again</a><a href="https://o.org/y.xlsx">3</a><a href="/z.pdf">4</a><a href="//cdn.org/w.xlsx">5</a>"""
    pages = spark.createDataFrame([("https://site.org/lib/index", html)], "url string, html string")
    got = [r["link"] for r in L.extract_links(pages).orderBy("link_no").collect()]
    assert got == ["https://site.org/a/x.xlsx", "https://o.org/y.xlsx", "https://cdn.org/w.xlsx", "https://site.org/rel.XLSX"]
    years = spark.createDataFrame([("load-2024.xlsx",), ("load-2019-2021.xlsx",), ("load.xlsx",)], "l string")
    assert [r["l"] for r in years.where(L.link_relevant(F.col("l"), 2020, 2022)).collect()] == ["load-2019-2021.xlsx", "load.xlsx"]


def test_header_and_number_coercion(spark):
    r = spark.createDataFrame([("  PG&E__-/TAC \t x ", "NaN", "45658.5")], "h string, n string, d string").select(
        S.norm_header(F.col("h")).alias("h"), S.norm_snake(F.col("h")).alias("s"), S.coerce_numeric(F.col("n")).alias("n"), S.coerce_date(F.col("d")).alias("d")
    ).first()
    assert (r["h"], r["s"], r["n"], r["d"]) == ("pg&e tac x", "pg&e_tac_x", None, datetime(2025, 1, 1, 12))


def test_sinks(spark, tmp_path):
    panel = spark.createDataFrame([("pge", datetime(2024, 1, 31, 23), 1.0), ("pge", datetime(2024, 2, 1), 2.0)], "region string, time_utc timestamp, load_mw double")
    SF.write_panel(panel, str(tmp_path / "p"))
    back = spark.read.parquet(str(tmp_path / "p"))
    assert back.count() == 2 and back.where("month = '2024-02'").first()["load_mw"] == 2.0
    SF.write_panel(panel, str(tmp_path / "c"), fmt="csv")
    text = spark.read.option("header", True).csv(str(tmp_path / "c")).orderBy("time_utc").first()
    assert (text["time_utc"], text["time_key"]) == ("2024-01-31 23:00:00", "2024-01-31:23")
    stations = SF.fallback_stations(spark)
    assert stations.count() == 30 and P.require_columns(stations, ["latitude"]) is stations


def test_runs_with_different_headers_keep_their_columns(spark, tmp_path):
    head = "predict_month,train_rows_used,validation_rows_scored,model,RMSE,MAE,MAPE,BIAS\n"
    for model, names in (("a", "actual_load_mw,predicted_load_mw"), ("b", "predicted_load_mw,actual_load_mw")):
        values = "200,100" if model == "a" else "100,200"
        (tmp_path / f"{model}_2025-01_predictions.csv").write_text(f"region,time_key,time_utc,{names}\npge,2025-01-01:00,2025-01-01 00:00:00,{values}\n")
        (tmp_path / f"{model}_2025-01_metrics.csv").write_text(head + f"2025-01,1,1,{model},1,1,1,1\n")
    _, predictions = SF.load_runs(spark, str(tmp_path))
    assert {(r["actual_load_mw"], r["predicted_load_mw"]) for r in predictions.collect()} == {("200", "100")}


def test_files_of_several_headers_are_opened_once(spark, tmp_path):
    (tmp_path / "a.csv").write_text("region,time_utc,load_mw\npge,2024-01-01 00:00:00,1\n")
    (tmp_path / "b.csv").write_text('time_utc,"load, of all",region\n2024-01-01 01:00:00,"2,5",pge\n')
    (tmp_path / "c.csv").write_text("region,time_utc,load_mw\nsce,2024-01-01 00:00:00,3\n")
    headers = SF.read_headers(spark, str(tmp_path))
    assert {tuple(r["header"]) for r in headers.collect()} == {("region", "time_utc", "load_mw"), ("time_utc", "load, of all", "region")}
    rows = SF.read_by_header(spark, str(tmp_path), headers)
    got = {(r["file_name"], r["region"], r["load_mw"], r["load, of all"]) for r in rows.collect()}
    assert got == {("a.csv", "pge", "1", None), ("c.csv", "sce", "3", None), ("b.csv", "pge", None, "2,5")}

    def leaves(plan):
        kids = plan.children()
        return [plan] if kids.isEmpty() else [x for i in range(kids.size()) for x in leaves(kids.apply(i))]

    spark.conf.set("spark.sql.adaptive.enabled", "false")
    plan = SF.read_by_header(spark, str(tmp_path), headers)._jdf.queryExecution().executedPlan()
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    plan.executeCollect()
    scans = [x for x in leaves(plan) if x.metrics().contains("numFiles")]
    assert sorted(x.metrics().apply("numFiles").value() for x in scans) == [1, 2]


def test_panel_files_of_other_columns(spark, tmp_path):
    (tmp_path / f"{K.DATASET_PREFIX}_20250101_to_20250102.csv").write_text("region,time_utc,load_mw\npge,2025-01-01 00:00:00,5\n")
    (tmp_path / f"{K.DATASET_PREFIX}_20250103_to_20250104.csv").write_text("time_utc,region,extra\n2025-01-03 00:00:00,sce,x\n")
    rows = {r["region"]: r for r in SF.read_panel(spark, str(tmp_path)).collect()}
    assert rows["pge"]["load_mw"] == 5.0 and rows["pge"]["extra"] is None
    assert rows["sce"]["extra"] == "x" and rows["sce"]["load_mw"] is None


def test_local_starts_with_offsets_and_the_repeated_hour(spark):
    rows = [("PGE", "2025-01-15 00:00:00-08:00", 1.0), ("PGE", "2025-11-02 01:00:00", 2.0), ("PGE", "2025-11-02 01:00:00", 3.0), ("PGE", "2025-11-02 02:00:00", 4.0)]
    raw = spark.createDataFrame(rows, "`Load Zone` string, `Interval Start-Local` string, load double").coalesce(1).withColumnRenamed("Load Zone", "tac_area_name")
    got = sorted((r["load_mw"], r["time_utc"].isoformat()) for r in A.standardize_area_long(raw).collect())
    assert got == [(1.0, "2025-01-15T08:00:00"), (2.0, "2025-11-02T08:00:00"), (3.0, "2025-11-02T09:00:00"), (4.0, "2025-11-02T10:00:00")]


def test_total_is_summed_only_where_the_feed_has_none(spark):
    rows = [("PGE-TAC", "2025-01-15 00:00:00", 1, 10.0), ("SCE-TAC", "2025-01-15 00:00:00", 2, 1.0)]
    schema = "tac_area_name string, interval_start_utc string, seq int, load double"
    feed = spark.createDataFrame(rows, schema)
    assert A.area_feed_to_wide(feed, "seq").first()["caiso"] == 11.0
    told = spark.createDataFrame([*rows, ("Total", "2025-01-15 00:00:00", 3, 99.0)], schema)
    assert A.area_feed_to_wide(told, "seq").first()["caiso"] == 99.0


def test_metrics_keep_the_month_of_their_run(spark):
    rows = [("m", "2025-01", "2025-01-31 23:00:00", 1.0, 2.0), ("m", "2025-01", "2025-02-01 00:00:00", 1.0, 2.0)]
    df = spark.createDataFrame(rows, "model string, month string, time_utc string, actual_load_mw double, predicted_load_mw double")
    assert [r["month"] for r in E.metrics_by_month(E.clean_predictions(df)).collect()] == ["2025-01"]


def test_sheet_ties_go_by_place_in_the_workbook(spark):
    def sheet(book, book_no, name, no, load):
        head, row = ["date", "hr", "pge"], ["2025-01-01", "1", load]
        return [(book, book_no, name, no, i, c) for i, c in enumerate((head, row))]

    rows = sheet("z", 0, "b", 0, "1") + sheet("z", 0, "a", 1, "2") + sheet("y", 1, "s", 0, "3")
    cells = spark.createDataFrame(rows, "workbook string, workbook_no int, sheet string, sheet_no int, row_idx int, cells array<string>")
    assert SH.merge_workbooks(cells).first()["pge"] == 1.0
    assert SH.merge_workbooks(cells.drop("sheet_no", "workbook_no")).first()["pge"] == 3.0


def test_dataset_is_found_again_by_its_span(spark, tmp_path):
    panel = spark.createDataFrame([("pge", datetime(2025, 1, 1), 5.0), ("pge", datetime(2025, 1, 3, 4), 6.0)], "region string, time_utc timestamp, load_mw double")
    path = SF.write_dataset(panel, str(tmp_path))
    assert path.endswith(f"{K.DATASET_PREFIX}_20250101_to_20250103.csv")
    back = SF.read_dataset(spark, path).collect()
    assert sorted((r["time_utc"], r["load_mw"], str(r["end_date"])) for r in back) == [(datetime(2025, 1, 1), 5.0, "2025-01-03"), (datetime(2025, 1, 3, 4), 6.0, "2025-01-03")]
