"""Model features and the split of a month's training and validation rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from tidewatt import constants as K
from tidewatt.functions import scalar as S
from tidewatt.models.preprocess import fit_imputer, fit_onehot, fit_scaler, level_counts, levels, most_frequent
from tidewatt.operators import panel as P
from tidewatt.operators.ordered import over_lookback


def with_calendar(df: DataFrame) -> DataFrame:
    ts = F.col("time_utc")
    return df.withColumns({**S.calendar_parts(ts), **S.cyclic_parts(ts)})


@dataclass(frozen=True)
class MonthData:
    """Usable training and validation rows of one month, with calendar features."""

    month: str
    train: DataFrame
    valid: DataFrame


def month_data(revised: DataFrame, month: str, check: bool = True) -> MonthData:
    """Rows before the month to train on, rows inside it to score; rows lacking load or lag drop."""
    P.require_columns(revised, K.REVISED_COLUMNS)
    train, valid = (P.usable_rows(part) for part in P.month_split(with_calendar(revised), month))
    if check:
        for name, part in (("training", train), ("validation", valid)):
            if part.isEmpty():
                raise ValueError(f"No usable {name} rows for month {month}")
    return MonthData(month, train, valid)


def with_row_lags(train: DataFrame, valid: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Row lag 24 and trailing 24-row mean over the rows of both splits together; rows without the lag drop."""
    both = P.union_parts(train.withColumn("__valid", F.lit(0)), valid.withColumn("__valid", F.lit(1)))
    lagged = over_lookback(
        both,
        24,
        lambda w: {
            "load_lag_24h": F.lag("load_mw", 24).over(w),
            "load_24h_avg": F.avg("load_mw").over(w.rowsBetween(-24, -1)),
        },
    ).dropna(subset=["load_lag_24h"])
    return tuple(lagged.where(F.col("__valid") == n).drop("__valid") for n in (0, 1))


def require_known_regions(train: DataFrame, valid: DataFrame) -> list[str]:
    """The training regions in order; validation regions outside them are an error."""
    known = levels(train, "region")
    unseen = sorted(set(levels(valid, "region")) - set(known))
    if unseen:
        raise ValueError(f"Validation data contains regions not seen in training: {unseen}")
    return known


def numeric_features(df: DataFrame) -> list[str]:
    """Every numeric column except target and time."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    return [c for c in P.feature_columns(df) if isinstance(kinds[c], NumericType)]


def fit_features(train: DataFrame, numeric: Sequence[str] | None = None) -> Callable[[DataFrame], DataFrame]:
    """Impute, scale and one-hot on the training rows; the result maps rows to a `features` vector.

    Columns a frame lacks at scoring time count as zero. Columns that are
    constant over the training rows stay out of the vector: no model here
    gives them weight, and they would make the normal equations singular.
    """
    columns = list(numeric or numeric_features(train))
    typed = train.withColumns({c: F.col(c).cast("double") for c in columns})
    numbers = fit_imputer(typed, columns)
    scale = fit_scaler(numbers(typed), columns)
    counts = level_counts(train, "region")
    known, usual = sorted(counts), most_frequent(counts)
    onehot = fit_onehot(train, "region", known)
    impute = lambda df: numbers(df.na.fill({"region": usual}) if usual is not None else df)
    assembler = VectorAssembler(
        inputCols=[f"__f_{c}" for c in scale.varying()] + [f"region_{v}" for v in known], outputCol="features"
    )

    def transform(df: DataFrame) -> DataFrame:
        source = {c: (F.col(c) if c in df.columns else F.lit(0)).cast("double") for c in columns}
        originals = [F.col(f"__o_{c}").alias(c) for c in columns if c in df.columns]
        kept = df.withColumns({f"__o_{c}": F.col(c) for c in columns if c in df.columns})
        ready = onehot(scale(impute(kept.withColumns(source))))
        renamed = ready.withColumnsRenamed({c: f"__f_{c}" for c in columns})
        rest = [c for c in df.columns if c not in columns]
        return assembler.transform(renamed).select(*rest, *originals, "features")

    return transform
