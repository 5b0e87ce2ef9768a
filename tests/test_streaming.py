from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidewatt.functions.holidays import with_calendar_flags
from tidewatt.operators import panel as P
from tidewatt.sources import files as SF
from tidewatt.streaming import incremental as I
from tests.test_sources import write_panel_csv

ORDER = ["start_date", "end_date", "file_name", "row_no"]


def to_panel(batch):
    numbered = SF.with_file_span(batch).withColumn("row_no", F.monotonically_increasing_id())
    return SF.parse_panel(numbered).drop("block_start")


def rows(n, start, value):
    first = datetime.fromisoformat(start)
    return [(r, str(first + timedelta(hours=i)), value + i) for r in ("pge", "sce") for i in range(n)]


def run(spark, source, target):
    schema = spark.createDataFrame([], SF.PANEL_TEXT_SCHEMA).schema
    I.run_updates(spark, str(source), schema, to_panel, str(target), ORDER, features=str(target / "features"), fmt="csv", files_per_batch=1, header="true")
    return I.read_table(spark, str(target / "panel")), I.read_table(spark, str(target / "features"))


def keys(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


def test_daily_files_equal_one_merge(spark, tmp_path):
    source, target = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    write_panel_csv(source, "caiso_dataset_20240101_to_20240108.csv", rows(24 * 8, "2024-01-01", 0))
    run(spark, source, target)
    write_panel_csv(source, "caiso_dataset_20240108_to_20240109.csv", rows(30, "2024-01-08", 1000))
    write_panel_csv(source, "caiso_dataset_20240101_to_20240110.csv", rows(3, "2024-01-01", 5000))
    panel, features = run(spark, source, target)
    whole = SF.merge_panels(SF.read_panel(spark, str(source)))
    cols = ("region", "time_utc", "load_mw")
    assert keys(panel, *cols) == keys(whole, *cols)
    assert panel.count() == 2 * (24 * 7 + 30)
    want = P.with_week_lag(with_calendar_flags(whole))
    cols = ("region", "time_utc", "load_previous_week", "is_weekend", "US_federal_holidays")
    assert keys(features, *cols) == keys(want, *cols)


def small_batch(spark, *more):
    data = [("a", datetime(2024, 1, 1, h), float(h), 0) for h in range(5)] + [("a", datetime(2024, 1, 1, 0), 9.0, 1), *more]
    return spark.createDataFrame(data, "region string, time_utc timestamp, load_mw double, ord int")


def test_replayed_batch_changes_nothing(spark, tmp_path):
    batch, folder = small_batch(spark), str(tmp_path / "t")
    I.merge_batch(batch, folder, ["ord"])
    first = keys(I.read_table(spark, folder), "time_utc", "load_mw")
    I.merge_batch(batch, folder, ["ord"])
    assert keys(I.read_table(spark, folder), "time_utc", "load_mw") == first and len(first) == 5
    assert I.superseded(spark, folder).count() == 1


def test_a_batch_reads_its_own_days_alone(spark, tmp_path):
    folder = str(tmp_path / "t")
    I.merge_batch(small_batch(spark, *[("a", datetime(2024, 2, d), 1.0, 0) for d in range(1, 20)]), folder, ["ord"])
    I.merge_batch(small_batch(spark, ("a", datetime(2024, 2, 3), 7.0, 2)).where("ord = 2"), folder, ["ord"])
    days = spark.createDataFrame([("2024-02-03",), ("2024-02-04",)], "day string")
    held = I.touched(spark, folder, days)
    assert keys(held, "time_utc", "load_mw") == [(datetime(2024, 2, 3), 7.0), (datetime(2024, 2, 4), 1.0)]
    length = "spark.sql.maxMetadataStringLength"
    before = spark.conf.get(length)
    spark.conf.set(length, "10000")
    plan = I.touched(spark, folder, days)._jdf.queryExecution().executedPlan().toString()
    spark.conf.set(length, before)
    filters = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "2024-02-03" in filters and "2024-02-04" in filters and "2024-01-01" not in filters and "2024-02-05" not in filters
    assert I.read_table(spark, folder).count() == 5 + 19 and "Join" not in plan


def test_a_version_without_its_manifest_is_not_seen(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "t")
    assert I.read_table(spark, folder) is None
    I.merge_batch(small_batch(spark), folder, ["ord"])
    before = keys(I.read_table(spark, folder), "time_utc", "load_mw")

    def lost(*_):
        raise RuntimeError("driver lost")

    monkeypatch.setattr(I, "manifest", lambda s, f, known=I.manifest: lost() if spark.read.parquet(f"{f}/data").select("version").distinct().count() > 1 else known(s, f))
    try:
        I.merge_batch(small_batch(spark, ("a", datetime(2024, 1, 1, 3), 50.0, 5)), folder, ["ord"])
    except RuntimeError:
        pass
    monkeypatch.undo()
    assert keys(I.read_table(spark, folder), "time_utc", "load_mw") == before


def test_many_days_are_joined(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "t")
    I.merge_batch(small_batch(spark, *[("a", datetime(2024, 2, d), 1.0, 0) for d in range(1, 9)]), folder, ["ord"])
    monkeypatch.setattr(I, "MOST_DAYS", 2)
    days = spark.createDataFrame([("2024-02-01",), ("2024-02-02",), ("2024-02-03",)], "day string")
    assert I.touched(spark, folder, days).count() == 3
