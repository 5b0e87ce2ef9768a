"""Daily update as a stream of files: later files win, and only touched days are read and written.

A table is a folder of data versions and a manifest that names, day by day, the version that holds it. A batch writes
the days it touches as a new version, then the next manifest, one file that appears whole or not at all: a reader meets
the table before the batch or after it, never in between, and a lost driver leaves the manifest as it was.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.utils import AnalysisException

from tidewatt.functions.holidays import with_calendar_flags
from tidewatt.operators import panel as P
from tidewatt.session import NO_TABLE

DAY, VERSION = "day", "version"
#: Days that a batch names one by one; a batch of more is read by its first and last day, and joined.
MOST_DAYS = 2_000


def with_day(df: DataFrame) -> DataFrame:
    return df.withColumn(DAY, F.date_format("time_utc", "yyyy-MM-dd"))


def manifest(spark: SparkSession, folder: str) -> DataFrame | None:
    """(number, day, version) of the newest manifest; None before the first batch."""
    try:
        kept = spark.read.schema("day string, version string, number long").parquet(f"{folder}/manifest")
    except AnalysisException as error:
        if error.getCondition() not in NO_TABLE:
            raise
        return None
    newest = kept.agg(F.max("number")).first()[0]
    return None if newest is None else kept.where(F.col("number") == newest)


def read_table(spark: SparkSession, folder: str, days: Sequence[str] | None = None) -> DataFrame | None:
    """The table's rows, of the named days alone if given; None before the first batch.

    Version and day are partitions and the wanted ones are named in the filter, so no other file is opened. The
    manifest has one row a day, which the calendar bounds.
    """
    listed = manifest(spark, folder)
    if listed is None:
        return None
    if days is not None:
        listed = listed.where(F.col(DAY).isin(list(days)))
    current = [f"{r[VERSION]}|{r[DAY]}" for r in listed.select(VERSION, DAY).collect()]
    data = spark.read.parquet(f"{folder}/data")
    place = F.concat(F.col(VERSION).cast("string"), F.lit("|"), F.col(DAY).cast("string"))
    return data.where(place.isin(current)).withColumn(DAY, F.col(DAY).cast("string")).drop(VERSION)


def superseded(spark: SparkSession, folder: str) -> DataFrame:
    """(version, day) of the data that no manifest row names any more: what may be deleted once no reader is left."""
    written = spark.read.parquet(f"{folder}/data").select(F.col(VERSION).cast("string"), F.col(DAY).cast("string")).distinct()
    listed = manifest(spark, folder)
    return written if listed is None else written.join(listed.select(VERSION, DAY), [VERSION, DAY], "left_anti")


def day_names(days: DataFrame) -> list[str] | None:
    """The days by name, or None if there are more than MOST_DAYS."""
    names = [r[0] for r in days.select(DAY).distinct().limit(MOST_DAYS + 1).collect()]
    return sorted(n for n in names if n is not None) if len(names) <= MOST_DAYS else None


def touched(spark: SparkSession, folder: str, days: DataFrame) -> DataFrame | None:
    """Rows of the table in `days`, whose partitions alone are read."""
    names = day_names(days)
    if names is not None:
        return read_table(spark, folder, names)
    table = read_table(spark, folder)
    return None if table is None else table.join(days.select(DAY).distinct(), DAY, "left_semi")


def replace_days(rows: DataFrame, folder: str) -> None:
    """Put `rows` in place of the days that they fall into."""
    spark = rows.sparkSession
    version = f"v{uuid.uuid4().hex}"
    (
        rows.withColumn(VERSION, F.lit(version))
        .hint("rebalance", DAY)
        .write.mode("append")
        .partitionBy(VERSION, DAY)
        .parquet(f"{folder}/data")
    )
    written = spark.read.parquet(f"{folder}/data").where(F.col(VERSION) == version)
    own = written.select(F.col(DAY).cast("string").alias(DAY), F.lit(version).alias(VERSION)).distinct()
    listed, number = manifest(spark, folder), 0
    if listed is not None:
        number = listed.first()["number"] + 1
        own = own.unionByName(listed.select(DAY, VERSION).join(own, DAY, "left_anti"))
    own.withColumn("number", F.lit(number).cast("long")).coalesce(1).write.mode("append").parquet(f"{folder}/manifest")


def merge_batch(batch: DataFrame, folder: str, order: Sequence[str]) -> DataFrame:
    """Merge one batch into the table; returns the days it touched.

    Merging the same batch twice gives the same table, so a replayed batch is
    harmless.
    """
    spark = batch.sparkSession
    # Used for the days and for the merge; kept so that the files are read once.
    incoming = with_day(P.keep_last(batch, order)).persist()
    try:
        days = spark.createDataFrame(incoming.select(DAY).distinct().collect(), f"{DAY} string")  # bounded by the calendar
        if days.isEmpty():
            return days
        held = touched(spark, folder, days)
        replace_days(incoming if held is None else P.keep_last(P.union_parts(held, incoming), order), folder)
    finally:
        incoming.unpersist()
    return days


def refresh_features(days: DataFrame, panel_folder: str, folder: str) -> None:
    """Recompute calendar and lag features of the touched days and of those a week later.

    A changed hour changes its own row and the lag of the row 7 days on, so
    nothing else has to move.
    """
    spark = days.sparkSession
    if days.isEmpty():
        return
    shift = lambda df, n: df.select(F.date_format(F.date_add(F.to_date(DAY), n), "yyyy-MM-dd").alias(DAY))
    affected = days.unionByName(shift(days, 7)).distinct()
    rows, history = touched(spark, panel_folder, affected), touched(spark, panel_folder, shift(affected, -7))
    replace_days(with_calendar_flags(P.with_week_lag(rows, history)), folder)


def run_updates(
    spark: SparkSession,
    source: str,
    schema: StructType,
    to_panel: Callable[[DataFrame], DataFrame],
    target: str,
    order: Sequence[str],
    features: str | None = None,
    fmt: str = "parquet",
    files_per_batch: int | None = None,
    **options,
) -> None:
    """Take up all new files of `source` and merge them into the panel table at `target`.

    Runs as a stream with its progress under `target`, so each call picks up
    only files it has not seen. With `features` the feature table follows.
    """
    reader = spark.readStream.format(fmt).schema(schema).options(**options)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)

    def take(batch: DataFrame, batch_id: int) -> None:
        days = merge_batch(to_panel(batch), f"{target}/panel", order)
        if features:
            refresh_features(days, f"{target}/panel", features)

    stream = (
        reader.load(source)
        .select("*", F.col("_metadata.file_name").alias("file_name"), F.col("_metadata.file_block_start").alias("block_start"))
        .writeStream.foreachBatch(take)
        .option("checkpointLocation", f"{target}/progress")
        .trigger(availableNow=True)
        .start()
    )
    stream.awaitTermination()
