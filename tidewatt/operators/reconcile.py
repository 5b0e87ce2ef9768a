"""Several load sources into one: ordered coalesce, fallback fill, source strategy."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatt import constants as K


def coalesce_parts(
    parts: DataFrame, values: Sequence[str], order: str, keys: Sequence[str] = ("time_utc",), prefer: str = "first"
) -> DataFrame:
    """Per key and column the first (or last) non-null value in part order.

    One aggregate over the stacked parts replaces a chain of full joins, and
    it combines map-side. min_by and max_by pass over rows whose order is null,
    which is how the null values drop out.
    """
    if prefer not in ("first", "last"):
        raise ValueError("prefer must be 'first' or 'last'")
    pick = F.min_by if prefer == "first" else F.max_by
    return parts.groupBy(*keys).agg(
        *[pick(v, F.when(F.col(v).isNotNull(), F.col(order))).alias(v) for v in values]
    )


def fill_from(primary: DataFrame, fallback: DataFrame, values: Sequence[str], keys: Sequence[str] = ("time_utc",)) -> DataFrame:
    """Primary values, holes filled from the fallback; keys of either side are kept."""
    renamed = fallback.select(*keys, *[F.col(v).alias(f"__f_{v}") for v in values if v in fallback.columns])
    joined = primary.join(renamed, list(keys), "full")
    out = []
    for v in values:
        sides = [c for c in (v, f"__f_{v}") if c in joined.columns]
        if sides:
            out.append(F.coalesce(*sides).alias(v))
    return joined.select(*keys, *out)


def missing_cells(wide: DataFrame, columns: Sequence[str]) -> int:
    """Requested cells without a value; an absent column misses all its rows."""
    present = [c for c in columns if c in wide.columns]
    row = wide.agg(F.count("*").alias("n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in present]).first()
    return sum(row[c] for c in present) + row["n"] * (len(columns) - len(present))


STRATEGIES = ("a", "b", "a_then_b", "b_then_a")


def choose_source(
    a, b, columns: Sequence[str], strategy: str, keys: Sequence[str] = ("time_utc",)
) -> tuple[DataFrame, dict[str, int | str]]:
    """Load by source strategy. `a` and `b` are functions that return a source's frame.

    The second source is read only when the first misses requested cells or
    fails. Returns the frame and the counts before, after and filled, or why
    the first source failed.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"Unknown strategy {strategy!r}: expected one of {list(STRATEGIES)}")
    first, second = (a, b) if strategy.startswith("a") else (b, a)
    if "then" not in strategy:
        return first(), {}
    try:
        primary = first()
        before = missing_cells(primary, columns)
    except Exception as error:  # whatever a source raises, the other one is there for it
        return second(), {"first_failed": f"{type(error).__name__}: {error}"}
    if before == 0:
        return primary, {"missing_before": 0, "missing_after": 0, "filled": 0}
    combined = fill_from(primary, second(), K.REGIONS if set(columns) <= set(K.REGIONS) else columns, keys)
    after = missing_cells(combined, columns)
    return combined, {"missing_before": before, "missing_after": after, "filled": before - after}


def source_fill_report(requested: DataFrame, primary: DataFrame, combined: DataFrame, value: str, keys: Sequence[str]) -> DataFrame:
    """Requested cells missing before and after the fallback, per region, as one lazy plan."""

    def cells(frame: DataFrame, name: str) -> DataFrame:
        return frame.select(*keys, F.col(value).alias(name))

    joined = requested.join(cells(primary, "__before"), list(keys), "left").join(cells(combined, "__after"), list(keys), "left")
    before, after = F.count_if(F.col("__before").isNull()), F.count_if(F.col("__after").isNull())
    return joined.groupBy("region").agg(
        F.count("*").alias("requested"),
        before.alias("missing_before"),
        after.alias("missing_after"),
        (before - after).alias("filled"),
    )


def pivot_last(long: DataFrame, value: str, order: str, regions: Sequence[str] = tuple(K.REGIONS)) -> DataFrame:
    """(time, region, value) rows to one column per region, the last value winning."""
    return long.groupBy("time_utc").agg(
        *[
            F.max_by(
                value, F.when((F.col("region") == r) & F.col(value).isNotNull(), F.col(order))
            ).alias(r)
            for r in regions
        ]
    )


def pivot_mean(long: DataFrame, value: str, regions: Sequence[str] = tuple(K.REGIONS)) -> DataFrame:
    return long.groupBy("time_utc").agg(*[F.avg(F.when(F.col("region") == r, F.col(value))).alias(r) for r in regions])


def with_total(wide: DataFrame, areas: Sequence[str] = tuple(K.AREA_REGIONS), total: str = K.TOTAL_REGION) -> DataFrame:
    """The total as the sum of the areas, null only where all are null.

    Added only when no row has a total, as a feed that reports it is to be
    believed.
    """
    present = [a for a in areas if a in wide.columns]
    reported = total in wide.columns and not wide.where(F.col(total).isNotNull()).isEmpty()
    if reported or not present:
        return wide
    summed = reduce(lambda x, y: x + y, [F.coalesce(F.col(a), F.lit(0.0)) for a in present])
    return wide.withColumn(total, F.when(F.coalesce(*present).isNotNull(), summed))
