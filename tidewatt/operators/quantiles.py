"""Exact quantiles of many columns and groups at once, in a number of passes that does not grow with either.

One pass sketches every column of every group, which brackets the wanted ranks. One pass counts the values below and
inside each bracket. One pass counts the distinct values inside, where the ranks are then read off. A bracket that
still holds more than `small` values is narrowed first, all such brackets in the same two passes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatt.operators.ordered import join_small
from tidewatt.session import materialize

#: Values that a group may order at once; a bracket with more is narrowed.
SMALL = 1_000_000
ACCURACY = 10_000
#: Steps of the grid by which a bracket is narrowed.
GRID = 256
GROUP = "__g"


def _counted(rows: DataFrame, state: DataFrame, keys: list[str], n: int) -> DataFrame:
    """`state` (keys, and n{i}, lo{i}, hi{i} of each column) with under{i} and inside{i}."""
    met = join_small(rows, state, keys)
    counts = []
    for i in range(n):
        v, lo, hi = F.col(f"v{i}"), F.col(f"lo{i}"), F.col(f"hi{i}")
        counts += [F.count_if(v < lo).alias(f"under{i}"), F.count_if((v >= lo) & (v <= hi)).alias(f"inside{i}")]
        counts += [F.first(c).alias(c) for c in (f"n{i}", f"lo{i}", f"hi{i}")]
    return materialize(met.groupBy(*keys).agg(*counts), "brackets")


def _ranks(i: int, probability: float) -> tuple[Column, Column]:
    """The two 0-based ranks around the wanted place."""
    place = (F.col(f"n{i}") - 1) * probability
    return F.floor(place), F.ceil(place)


def _held(i: int, probability: float) -> tuple[Column, Column]:
    """Whether the bracket reaches down to the lower rank, and up to the upper one; without values there is none to reach."""
    low, high = _ranks(i, probability)
    none = F.col(f"n{i}") == 0
    return none | (F.col(f"under{i}") <= low), none | (high < F.col(f"under{i}") + F.col(f"inside{i}"))


def _narrowed(rows: DataFrame, state: DataFrame, keys: list[str], n: int, probability: float, accuracy: int, small: int) -> DataFrame:
    """Brackets with more than `small` values cut to the steps of a grid around the ranks; a side that a sketch missed
    is opened again."""
    met = join_small(rows, state, keys)
    shares = [k / GRID for k in range(GRID + 1)]
    wide = lambda i: (F.col(f"inside{i}") > small) & (F.col(f"lo{i}") < F.col(f"hi{i}"))
    grids = []
    for i in range(n):
        v = F.when(wide(i) & (F.col(f"v{i}") >= F.col(f"lo{i}")) & (F.col(f"v{i}") <= F.col(f"hi{i}")), F.col(f"v{i}"))
        grids.append(F.percentile_approx(v, shares, accuracy).alias(f"grid{i}"))
    found = join_small(state, met.groupBy(*keys).agg(*grids), keys)
    out = {}
    for i in range(n):
        low, high = _ranks(i, probability)
        under, inside, grid = F.col(f"under{i}"), F.col(f"inside{i}"), F.col(f"grid{i}")
        step = lambda rank, off: F.element_at(grid, F.least(F.greatest(F.floor((rank - under) * GRID / inside) + off, F.lit(1)), F.lit(GRID + 1)).cast("int"))  # noqa: B023, E731
        down, up = _held(i, probability)
        out[f"lo{i}"] = F.when(~down, F.lit(float("-inf"))).when(wide(i), step(low, 0)).otherwise(F.col(f"lo{i}"))
        out[f"hi{i}"] = F.when(~up, F.lit(float("inf"))).when(wide(i), step(high, 3)).otherwise(F.col(f"hi{i}"))
    kept = [*keys, *[f"n{i}" for i in range(n)]]
    return found.select(*kept, *[c.alias(name) for name, c in out.items()])


def exact_quantiles(
    df: DataFrame, columns: Sequence[str], probability: float = 0.5, by: Sequence[str] = (), accuracy: int = ACCURACY, small: int = SMALL
) -> DataFrame:
    """`by` and the exact linearly interpolated quantile of each column, one row a group (one row in all without `by`,
    none if `df` is empty). Nulls and NaN are left out, rows with a null in `by` too; a column without values gives null."""
    keys, n = [*by] or [GROUP], len(columns)
    number = lambda c: F.col(c).cast("double")
    values = [F.when(~F.isnan(number(c)), number(c)).alias(f"v{i}") for i, c in enumerate(columns)]
    rows = df.select(*(by or [F.lit(0).alias(GROUP)]), *values)
    margin = 2.0 / accuracy
    ends = [max(0.0, probability - margin), min(1.0, probability + margin)]
    sketch = rows.groupBy(*keys).agg(*[a for i in range(n) for a in (F.count(f"v{i}").alias(f"n{i}"), F.percentile_approx(f"v{i}", ends, accuracy).alias(f"q{i}"))])
    state = sketch.select(*keys, *[c for i in range(n) for c in (f"n{i}", F.col(f"q{i}")[0].alias(f"lo{i}"), F.col(f"q{i}")[1].alias(f"hi{i}"))])
    state = _counted(rows, materialize(state, "sketch"), keys, n)
    before = None
    while True:
        missed = [~(down & up) for down, up in (_held(i, probability) for i in range(n))]
        loose = [(F.col(f"inside{i}") > small) & (F.col(f"lo{i}") < F.col(f"hi{i}")) for i in range(n)]
        cells = lambda flags: F.sum(sum((F.coalesce(f, F.lit(False)).cast("long") for f in flags), F.lit(0)))
        held = F.sum(sum((F.when(f, F.col(f"inside{i}")).otherwise(0) for i, f in enumerate(loose)), F.lit(0)))
        misses, wide, inside = state.agg(cells(missed), cells(loose), held).first()
        # A bracket of few distinct values does not narrow any more, nor has it to.
        if not misses and (not wide or (before is not None and 2 * inside > before)):
            break
        before = inside
        state = _counted(rows, materialize(_narrowed(rows, state, keys, n, probability, accuracy, small), "sketch"), keys, n)

    met = join_small(rows, state.select(*keys, *[f"{c}{i}" for i in range(n) for c in ("lo", "hi")]), keys)
    inside = [F.when((F.col(f"v{i}") >= F.col(f"lo{i}")) & (F.col(f"v{i}") <= F.col(f"hi{i}")), F.struct(F.lit(i).alias("i"), F.col(f"v{i}").alias("v"))) for i in range(n)]
    rest = met.select(*keys, F.explode(F.array_compact(F.array(*inside))).alias("c")).groupBy(*keys, "c.i", "c.v").agg(F.count(F.lit(1)).alias("same"))
    seen = F.sum("same").over(Window.partitionBy(*keys, "i").orderBy("v"))
    ladder = rest.withColumn("upto", seen)
    whole = join_small(ladder, state, keys)
    at = lambda i, rank: F.min(F.when((F.col("i") == i) & (F.col("upto") + F.col(f"under{i}") > rank), F.col("v")))
    ends = [a.alias(f"{e}{i}") for i in range(n) for e, a in zip("ab", (at(i, r) for r in _ranks(i, probability)))]
    found = join_small(state, whole.groupBy(*keys).agg(*ends), keys, "left")
    place = lambda i: (F.col(f"n{i}") - 1) * probability
    between = lambda i: F.col(f"a{i}") + (F.col(f"b{i}") - F.col(f"a{i}")) * (place(i) - F.floor(place(i)))
    return found.select(*by, *[between(i).alias(c) for i, c in enumerate(columns)])


def exact_quantile(df: DataFrame, column: str, probability: float = 0.5, accuracy: int = ACCURACY, small: int = SMALL):
    """Exact linearly interpolated quantile of one column; None when it is empty."""
    row = exact_quantiles(df, [column], probability, (), accuracy, small).first()
    return None if row is None else row[0]


def exact_medians(df: DataFrame, columns: Sequence[str], small: int = SMALL) -> dict[str, float | None]:
    """Exact median of each column."""
    row = exact_quantiles(df, columns, small=small).first() if columns else None
    return {c: None if row is None else row[i] for i, c in enumerate(columns)}


def exact_medians_by(df: DataFrame, key: str, columns: Sequence[str], small: int = SMALL) -> dict[str, dict[str, float | None]]:
    """Exact medians per value of `key` as a dict, for callers that know their keys to be few."""
    rows = exact_quantiles(df, columns, by=[key], small=small).toLocalIterator()
    return {r[0]: dict(zip(columns, r[1:])) for r in rows}
