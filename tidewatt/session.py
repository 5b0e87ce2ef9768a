"""Session set-up shared by jobs, tests and the bench."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: What a read says of a table that isn't there yet: no folder, or a folder without a file.
NO_TABLE = ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")


def build_session(app: str = "tidewatt", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators rely on; `conf` overrides any of them.

    On a cluster leave `master` unset, so that spark-submit decides it.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
    }
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def utc(spark: SparkSession) -> SparkSession:
    """Pin the session to UTC: every naive time in the panel means UTC."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by `spark.checkpoint.dir`.

    Only a local-mode session may fall back to a folder of this machine: on a
    cluster the executors could not see it, so that case is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if spark.sparkContext.master.startswith("local"):
        folder = tempfile.mkdtemp(prefix="tidewatt-", dir=os.environ.get("TMPDIR"))
        spark.conf.set("spark.checkpoint.dir", folder)
        return folder
    raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """`df` written once to the shared folder and read back.

    Later passes read files and not the plan, so losing an executor costs a
    read and not a recomputation, and every pass prunes its columns.
    """
    folder = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
