"""File discovery by name, CSV scans of panels and run directories, and the sinks."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tidewatt import constants as K
from tidewatt.functions import scalar as S
from tidewatt.operators.ordered import join_small, pick_one
from tidewatt.operators.panel import keep_last, require_columns

PANEL_TEXT_SCHEMA = "region string, time_key string, time_utc string, " + ", ".join(
    f"{c} string" for c in [*K.WEATHER_VARS, "cdd_65f", "hdd_65f", "load_mw"]
)

# The dataset name pattern as a file glob, so that other files are never opened.
DATASET_GLOB = f"{K.DATASET_PREFIX}_{'[0-9]' * 8}_to_{'[0-9]' * 8}.csv"


# ---- file names ---------------------------------------------------------------------------


def with_file_span(files: DataFrame, on_reversed: str = "error") -> DataFrame:
    """Start and end day of dataset files named by span; other names are skipped.

    A span that ends before it starts is an error, or with `on_reversed='flag'`
    stays in with `span_ok` 0.
    """
    name = F.col("file_name")
    matched = (
        files.where(name.rlike(K.DATASET_PATTERN))
        .withColumn("start_date", F.to_date(F.try_to_timestamp(F.regexp_extract(name, K.DATASET_PATTERN, 1), F.lit("yyyyMMdd"))))
        .withColumn("end_date", F.to_date(F.try_to_timestamp(F.regexp_extract(name, K.DATASET_PATTERN, 2), F.lit("yyyyMMdd"))))
    )
    ok = F.coalesce(F.col("end_date") >= F.col("start_date"), F.lit(False))
    if on_reversed == "flag":
        return matched.withColumn("span_ok", ok.cast("int"))
    reason = F.concat(name, F.lit(" has no valid span"))
    return matched.withColumn("start_date", F.when(ok, F.col("start_date")).otherwise(F.raise_error(reason).cast("date")))


def infer_span(files: DataFrame, prefix: str = K.DATASET_PREFIX) -> DataFrame:
    """Overall span of a set of dataset files and the name it gives the merged file."""
    day = lambda c: F.date_format(c, "yyyyMMdd")
    return files.agg(F.min("start_date").alias("start_date"), F.max("end_date").alias("end_date")).withColumn(
        "file_name",
        F.concat(F.lit(prefix + "_"), day("start_date"), F.lit("_to_"), day("end_date"), F.lit(".csv")),
    )


def parse_run_name(name: Column) -> dict[str, Column]:
    """model, month and kind of `{model}_YYYY-MM_{metrics,predictions}.csv`; null for other names."""
    hit = name.rlike(K.RUN_PATTERN)
    part = lambda i: F.when(hit, F.regexp_extract(name, K.RUN_PATTERN, i))
    return {"model": S.norm_model_name(part(1)), "month": part(2), "kind": part(3)}


def with_run_name(files: DataFrame) -> DataFrame:
    return files.withColumns(parse_run_name(F.col("file_name"))).where("kind is not null")


def model_from_stem(name: Column) -> Column:
    """Model name from a file name: `.csv`, then `_metrics`, then `_predictions` stripped."""
    stem = F.regexp_replace(F.lower(name), r"\.csv$", "")
    return S.norm_model_name(F.regexp_replace(F.regexp_replace(stem, "_metrics$", ""), "_predictions$", ""))


# ---- run directories ----------------------------------------------------------------------


def header_kind(header: Column) -> Column:
    """metrics, predictions or null by the columns a file holds (an array of names)."""
    has = lambda c: F.array_contains(header, c)
    any_metric = has(K.METRIC_COLUMNS[0])
    for m in K.METRIC_COLUMNS[1:]:
        any_metric = any_metric | has(m)
    all_predictions = has(K.PREDICTION_COLUMNS[0])
    for c in K.PREDICTION_COLUMNS[1:]:
        all_predictions = all_predictions & has(c)
    return F.when(has("model") & any_metric, "metrics").when(all_predictions, "predictions")


def classify_run_files(files: DataFrame) -> DataFrame:
    """Files (file_name, header) that count as runs: named well and holding the right columns.

    For one (model, month, kind) the last file by name wins.
    """
    named = with_run_name(files)
    good = named.where((F.col("kind") == "metrics") | (header_kind(F.col("header")) == "predictions"))
    return pick_one(good, ["model", "month", "kind"], [F.col("file_name").desc()])


def classify_model_files(files: DataFrame) -> DataFrame:
    """Files (file_name, header) recognised by their columns alone, under the model their name implies.

    For one (model, kind) the last file by name wins; unrecognised files drop.
    """
    known = files.withColumn("kind", header_kind(F.col("header"))).where("kind is not null")
    named = known.withColumn("model", model_from_stem(F.col("file_name")))
    return pick_one(named, ["model", "kind"], [F.col("file_name").desc()])


def list_files(spark: SparkSession, folder: str, glob: str = "*.csv") -> DataFrame:
    """Names and paths under a folder, from the file listing only."""
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", glob)
        .load(folder)
        .select(F.col("path"), F.element_at(F.split("path", "/"), -1).alias("file_name"))
    )


#: A comma with an even number of quotes behind it: one that parts two fields.
BETWEEN_FIELDS = ',(?=(?:[^"]*"[^"]*")*[^"]*$)'


def read_headers(spark: SparkSession, folder: str | Sequence[str], glob: str = "*.csv") -> DataFrame:
    """First line of each CSV file as an array of column names. One row per file."""
    lines = (
        spark.read.option("pathGlobFilter", glob)
        .text(folder)
        .select("value", F.col("_metadata.file_name").alias("file_name"), F.col("_metadata.file_block_start").alias("at"))
        .where("at = 0")
    )
    # Only the leading rows of each file's first block reach this point in order.
    first = lines.withColumn("line_no", F.monotonically_increasing_id())
    return pick_one(first, ["file_name"], [F.col("line_no")]).select(
        "file_name", F.transform(F.split("value", BETWEEN_FIELDS), lambda c: F.trim(F.replace(c, F.lit('"'), F.lit("")))).alias("header")
    )


RUN_COLUMNS = {
    "metrics": ["predict_month", "train_rows_used", "validation_rows_scored", *K.METRIC_COLUMNS, "MEAN_ACTUAL", "MEAN_FORECAST"],
    "predictions": ["region", "time_key", "time_utc", "actual_load_mw", "predicted_load_mw"],
}


def read_by_header(spark: SparkSession, paths: str | Sequence[str], files: DataFrame, glob: str = "*.csv") -> DataFrame:
    """Rows of the files that `files` (file_name, header, ...) names, as text, every file under its own header.

    Files of one header are read together by a scan that names them, so every file is opened once. A column that only
    some files have is null in the others. Adds the columns of `files` but the header, and each row's place: `file_path`,
    `block_start` (splits of a file order by their start) and `row_no` (rows inside a split).
    """
    # One row a file, as the driver's own listing of the folder has.
    shapes: dict[tuple[str, ...], list[str]] = {}
    for r in files.select("header", "file_name").distinct().toLocalIterator():
        shapes.setdefault(tuple(r["header"]), []).append(r["file_name"])
    own = [c for c in files.columns if c != "header"]
    parts = []
    for header, names in sorted(shapes.items()):
        named = StructType([StructField(c, StringType()) for c in header])
        raw = spark.read.option("header", True).option("pathGlobFilter", glob).schema(named).csv(paths)
        raw = raw.where(F.col("_metadata.file_name").isin(names))
        raw = raw.select(
            *[F.col(f"`{c}`") for c in header if c not in own],
            F.col("_metadata.file_name").alias("file_name"),
            F.col("_metadata.file_path").alias("file_path"),
            F.col("_metadata.file_block_start").alias("block_start"),
        ).withColumn("row_no", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
        alike = files.where(F.col("header") == F.array(*[F.lit(c) for c in header])).drop("header")
        parts.append(join_small(raw, alike, ["file_name"]))
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts)


def _read_runs(spark: SparkSession, folder: str, picked: DataFrame, kind: str, glob: str) -> DataFrame:
    """Rows of the picked files as text, with their place in the file. The picked list has one row per file."""
    own = [c for c in picked.columns if c != "header"]
    renamed = picked.withColumnsRenamed({c: f"__{c}" for c in own if c != "file_name"})
    raw = read_by_header(spark, folder, renamed, glob).withColumn("row_no", F.struct("block_start", "row_no"))
    held = [F.col(c) for c in RUN_COLUMNS[kind] if c in raw.columns]
    if "model" in raw.columns:
        held.append(F.col("model").alias("row_model"))
    return raw.select("file_name", *[F.col(f"__{c}").alias(c) for c in own if c != "file_name"], "row_no", *held)


def load_runs(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(metrics, predictions) of a directory of monthly runs; badly named or shaped files are left out."""
    chosen = classify_run_files(read_headers(spark, folder))
    out = []
    for kind in ("metrics", "predictions"):
        picked = chosen.where(F.col("kind") == kind).select("file_name", "header", "model", "month")
        if picked.isEmpty():
            raise ValueError(f"No {kind} files were found in {folder}")
        out.append(_read_runs(spark, folder, picked, kind, f"*_{kind}.csv"))
    return out[0], out[1]


def load_model_runs(spark: SparkSession, folder: str) -> tuple[DataFrame | None, DataFrame | None]:
    """(metrics, predictions) of a directory with one run per model, told apart by their columns.

    A metrics file belongs to the model its first row names, a predictions
    file to the one its name implies; either side may be absent, but not both.
    """
    chosen = classify_model_files(read_headers(spark, folder))
    sides: dict[str, DataFrame | None] = {}
    for kind in ("metrics", "predictions"):
        picked = chosen.where(F.col("kind") == kind).select("file_name", "header", "model")
        sides[kind] = None if picked.isEmpty() else _read_runs(spark, folder, picked, kind, "*.csv")
    if sides["metrics"] is None and sides["predictions"] is None:
        raise ValueError("No recognized metrics or predictions files were found")
    if sides["metrics"] is not None:
        first = pick_one(sides["metrics"], ["file_name"], [F.col("row_no")])
        named = first.withColumn("model", F.coalesce(S.norm_model_name(F.col("row_model")), F.col("model")))
        sides["metrics"] = pick_one(named, ["model"], [F.col("file_name").desc()])
    return sides["metrics"], sides["predictions"]


# ---- panel scans --------------------------------------------------------------------------


def parse_panel(raw: DataFrame, strict: bool = True) -> DataFrame:
    """Text columns to the panel's types. An unreadable time is an error, or dropped if not strict."""
    require_columns(raw, ["region", "time_utc"])
    numbers = {c: S.coerce_numeric(F.col(c)) for c in raw.columns if c in {*K.WEATHER_VARS, "cdd_65f", "hdd_65f", "load_mw", "load_pred_mw", "load_previous_week"}}
    parsed = F.try_to_timestamp(F.col("time_utc"))
    if strict:
        message = F.concat(F.lit("invalid time_utc: "), F.coalesce(F.col("time_utc"), F.lit("null")))
        parsed = F.coalesce(parsed, F.raise_error(message).cast("timestamp"))
    out = raw.withColumns({**numbers, "time_utc": parsed})
    return out if strict else out.where("time_utc is not null")


def bad_times(raw: DataFrame) -> DataFrame:
    return raw.agg(
        F.count("*").alias("rows"), F.count_if(F.try_to_timestamp(F.col("time_utc")).isNull()).alias("bad_time_rows")
    )


def read_panel(spark: SparkSession, paths: str | Sequence[str], glob: str = DATASET_GLOB, strict: bool = True) -> DataFrame:
    """Panel CSV files of any columns (region and time_utc among them), with the file's span and the row's place in it
    as ordering columns."""
    raw = read_by_header(spark, paths, read_headers(spark, paths, glob), glob)
    return parse_panel(with_file_span(raw), strict)


FILE_ORDER = ["start_date", "end_date", "file_path", "block_start", "row_no"]


def merge_panels(panel: DataFrame) -> DataFrame:
    """One row per (region, hour); a later file, and a later row in it, wins."""
    return keep_last(panel, FILE_ORDER).drop(*FILE_ORDER, "file_name")


def read_station_weights(raw: DataFrame) -> DataFrame:
    """Station weights with lower-case regions; rows lacking a name, place or weight drop."""
    require_columns(raw, ["region", "station_name", "latitude", "longitude", "population_weight"])
    numbers = ["latitude", "longitude", "population_weight"]
    return (
        raw.withColumns({c: S.coerce_numeric(F.col(c)) for c in numbers})
        .withColumn("region", F.lower("region"))
        .dropna(subset=["region", "station_name", *numbers])
    )


def fallback_stations(spark: SparkSession) -> DataFrame:
    """The fixed station list, uniform weights before normalisation."""
    rows = [(r, n, la, lo) for r, stations in K.FALLBACK_STATIONS.items() for n, la, lo in stations]
    return spark.createDataFrame(rows, "region string, station_name string, latitude double, longitude double").withColumn(
        "population_weight", F.lit(1.0)
    )


# ---- sinks --------------------------------------------------------------------------------


def panel_text(panel: DataFrame) -> DataFrame:
    """The panel as written: the time as text, after its key."""
    ts = F.col("time_utc")
    return panel.withColumn("time_key", S.time_key(ts)).withColumn("time_utc", F.date_format(ts, K.TIME_TEXT_FORMAT))


def write_panel(panel: DataFrame, folder: str, fmt: str = "parquet") -> None:
    """Write by month. The rebalance hint sizes the files: big months split, small ones share a task."""
    if fmt == "csv":
        panel_text(panel).write.mode("overwrite").option("header", True).csv(folder)
        return
    (
        panel.withColumn("month", S.year_month(F.col("time_utc")))
        .hint("rebalance", "month")
        .sortWithinPartitions("month", "region", "time_utc")
        .write.mode("overwrite")
        .partitionBy("month")
        .parquet(folder)
    )


def write_dataset(panel: DataFrame, folder: str, prefix: str = K.DATASET_PREFIX) -> str:
    """The panel as CSV in a folder named by its span, `prefix_YYYYMMDD_to_YYYYMMDD.csv`; returns the folder.

    `read_dataset` reads it back with its span.
    """
    first, last = panel.agg(*[F.date_format(f("time_utc"), "yyyyMMdd") for f in (F.min, F.max)]).first()
    if first is None:
        raise ValueError("No rows to write: the span is empty")
    path = f"{folder.rstrip('/')}/{prefix}_{first}_to_{last}.csv"
    panel_text(panel).write.mode("overwrite").option("header", True).csv(path)
    return path


def read_dataset(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """A folder that `write_dataset` wrote, with the span of its name as ordering columns."""
    files = read_headers(spark, path)
    raw = read_by_header(spark, path, files)
    named = raw.withColumn("file_name", F.lit(path.rstrip("/").rsplit("/", 1)[-1]))
    return parse_panel(with_file_span(named), strict)


def write_run(predictions: DataFrame, metrics: DataFrame, folder: str, model: str, month: str) -> None:
    """Predictions and metrics of one run, each under its (model, month) partition."""
    tag = {"model": F.lit(model), "month": F.lit(month)}
    for name, df in (("predictions", predictions), ("metrics", metrics)):
        df.drop("model", "month").withColumns(tag).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic"
        ).partitionBy("model", "month").parquet(f"{folder}/{name}")


def write_runs(df: DataFrame, folder: str, name: str) -> None:
    """Rows of many runs at once, each under its (model, month) partition of `folder`/`name`."""
    df.hint("rebalance", F.col("model"), F.col("month")).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy("model", "month").parquet(f"{folder}/{name}")


def write_table(df: DataFrame, folder: str) -> None:
    df.write.mode("overwrite").parquet(folder)
