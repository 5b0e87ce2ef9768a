"""Preprocessing fitted on the training rows only."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatt.operators.quantiles import exact_medians

Transform = Callable[[DataFrame], DataFrame]
MAX_LEVELS = 10_000


def level_counts(df: DataFrame, column: str, limit: int = MAX_LEVELS) -> dict[str, int]:
    """Rows per value of a category; too many values is an error and not a driver problem."""
    rows = df.where(F.col(column).isNotNull()).groupBy(column).count().limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{column} has more than {limit} levels")
    return {r[column]: r["count"] for r in rows}


def levels(df: DataFrame, column: str) -> list[str]:
    return sorted(level_counts(df, column))


def most_frequent(counts: dict[str, int]) -> str | None:
    """The value with most rows; ties go to the smallest."""
    return min(counts, key=lambda v: (-counts[v], v)) if counts else None


@contextmanager
def cached(df: DataFrame):
    """`df` kept for the several passes of a fit, and let go afterwards."""
    if df.is_cached:
        yield df
        return
    kept = df.persist()
    try:
        yield kept
    finally:
        kept.unpersist()


def region_codes(df: DataFrame, column: str = "region", name: str = "region_code") -> DataFrame:
    """0-based code of each region in sorted order."""
    codes = [(v, i) for i, v in enumerate(levels(df, column))]
    return df.sparkSession.createDataFrame(codes, f"{column} string, {name} int")


def with_region_code(df: DataFrame, known: Sequence[str], column: str = "region", name: str = "region_code") -> DataFrame:
    table = F.create_map(*[F.lit(x) for i, v in enumerate(known) for x in (v, i)])
    return df.withColumn(name, F.element_at(table, F.col(column)))


def fit_imputer(train: DataFrame, numeric: Sequence[str], categorical: Sequence[str] = ()) -> Transform:
    """Exact medians for numbers, most frequent value (ties: smallest) for categories."""
    fill: dict = exact_medians(train, numeric)
    for c in categorical:
        fill[c] = most_frequent(level_counts(train, c))
    fill = {c: v for c, v in fill.items() if v is not None}
    return lambda df: df.na.fill({c: v for c, v in fill.items() if c in df.columns})


@dataclass(frozen=True)
class Scaler:
    """Mean and population deviation of each column."""

    stats: dict[str, tuple[float, float]]

    def __call__(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: (F.col(c) - mean) / (std or 1.0) for c, (mean, std) in self.stats.items()})

    def varying(self) -> list[str]:
        """Columns that are not constant. A constant one is all zeros once scaled and carries no weight."""
        return [c for c, (_, std) in self.stats.items() if std > 0]


def fit_scaler(train: DataFrame, numeric: Sequence[str]) -> Scaler:
    """Centre and divide by the population deviation; a constant column is only centred."""
    row = train.agg(
        *[F.avg(c).alias(f"m_{c}") for c in numeric], *[F.stddev_pop(c).alias(f"s_{c}") for c in numeric]
    ).first()
    return Scaler({c: (row[f"m_{c}"] or 0.0, row[f"s_{c}"] or 0.0) for c in numeric})


def fit_onehot(train: DataFrame, column: str, known: Sequence[str] | None = None) -> Transform:
    """One indicator per training level; an unknown level is all zeros."""
    known = levels(train, column) if known is None else known
    return lambda df: df.withColumns(
        {f"{column}_{v}": F.coalesce((F.col(column) == v).cast("int"), F.lit(0)) for v in known}
    )


@dataclass(frozen=True)
class TargetScale:
    mean: float
    std: float

    def apply(self, y: Column) -> Column:
        return (y - self.mean) / self.std

    def invert(self, y: Column) -> Column:
        return y * self.std + self.mean


def fit_target_scale(train: DataFrame, target: str) -> TargetScale:
    row = train.agg(F.avg(target).alias("m"), F.stddev_pop(target).alias("s")).first()
    return TargetScale(row["m"], row["s"] or 1.0)
