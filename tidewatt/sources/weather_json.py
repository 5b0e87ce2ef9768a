"""Column-array weather payloads to one row per hour."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatt import constants as K


def explode_hourly_json(
    df: DataFrame, payload: str = "payload", variables: Sequence[str] = tuple(K.WEATHER_VARS), missing: str = "null"
) -> DataFrame:
    """One row per hour of each payload `{"hourly": {"time": [...], "<variable>": [...]}}`.

    A variable the payload lacks is null, or with `missing='error'` an error.
    """
    fields = ", ".join(f"{v}: array<double>" for v in variables)
    parsed = df.withColumn("__h", F.from_json(payload, f"hourly struct<time: array<string>, {fields}>")["hourly"])
    if missing == "error":
        for v in variables:
            text = F.lit(f"payload lacks {v}")
            parsed = parsed.where(F.when(F.col("__h")[v].isNull(), F.raise_error(text).cast("boolean")).otherwise(F.lit(True)))
    rows = parsed.select(
        *[c for c in df.columns if c != payload], "__h", F.posexplode("__h.time").alias("__i", "__t")
    )
    return rows.select(
        *[c for c in df.columns if c != payload],
        F.try_to_timestamp(F.col("__t")).alias("time_utc"),
        *[F.get(F.col("__h")[v], F.col("__i")).alias(v) for v in variables],
    )


def pack_hourly_json(df: DataFrame, keys: Sequence[str], variables: Sequence[str], payload: str = "payload") -> DataFrame:
    """The reverse: hours of each key packed into one payload. Keys must bound the hours, e.g. by day."""
    row = F.struct("time_utc", *variables)
    ordered = df.groupBy(*keys).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    time = F.transform("rows", lambda r: F.date_format(r["time_utc"], "yyyy-MM-dd'T'HH:mm"))
    columns = [F.col("rows").getField(v).alias(v) for v in variables]
    hourly = F.struct(time.alias("time"), *columns)
    return ordered.select(
        *keys, F.to_json(F.struct(hourly.alias("hourly")), {"ignoreNullFields": "false"}).alias(payload)
    )
