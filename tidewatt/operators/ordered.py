"""Ordered work inside a few big groups, without one task per group.

A panel has few regions, so `Window.partitionBy("region")` gives a handful of
tasks however large the data grows. The helpers here split each group into
chunks of the time axis, do the ordered work per (group, chunk), and join a
summary with one row per chunk back in. Results equal the plain window's.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 8192


def month_chunk(ts: str = "time_utc") -> Column:
    return F.date_trunc("month", F.col(ts))


def day_chunk(ts: str = "time_utc") -> Column:
    return F.date_trunc("day", F.col(ts))


SMALL_SIDE_ROWS = 100_000


def small_table(small: DataFrame, limit: int = SMALL_SIDE_ROWS) -> DataFrame:
    """`small` fetched into a local table marked for broadcast if it has at most `limit` rows, else unchanged."""
    fetched = small.limit(limit + 1).toArrow()
    if fetched.num_rows > limit:
        return small
    return F.broadcast(small.sparkSession.createDataFrame(fetched.to_pylist(), small.schema))


def join_small(
    left: DataFrame, small: DataFrame, keys: Sequence[str], how: str = "inner", limit: int = SMALL_SIDE_ROWS
) -> DataFrame:
    """Join with a side that is expected, but not known, to be small.

    The planner cannot see that a few groups remain of a huge table and would
    shuffle the big side by a handful of hot keys. So the side is fetched up to
    `limit` rows: within it, it becomes a local table that broadcasts; beyond
    it, the plain join stays, with adaptive skew handling.
    """
    return left.join(small_table(small, limit), list(keys), how)


def attach_group_stats(df: DataFrame, keys: Sequence[str], **aggs: Column) -> DataFrame:
    """Group aggregates (combined map-side) joined back onto the rows."""
    stats = df.groupBy(*keys).agg(*[expr.alias(name) for name, expr in aggs.items()])
    return join_small(df, stats, keys, "left")


def with_running_counts(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    chunk: Column,
    counts: dict[str, Column],
) -> DataFrame:
    """Running counts (current row included) of conditions over each whole group.

    `chunk` must not decrease along `order` within a group.
    """
    chunked = df.withColumn("__chunk", chunk)
    within = Window.partitionBy(*keys, "__chunk").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    per_chunk = chunked.groupBy(*keys, "__chunk").agg(
        *[F.count_if(cond).alias(f"__n_{name}") for name, cond in counts.items()]
    )
    before = Window.partitionBy(*keys).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_chunk.select(
        *keys,
        "__chunk",
        *[F.coalesce(F.sum(f"__n_{name}").over(before), F.lit(0)).alias(f"__o_{name}") for name in counts],
    )
    local = chunked.select(
        "*", *[F.count_if(cond).over(within).alias(f"__l_{name}") for name, cond in counts.items()]
    )
    # `local` is already hashed by (keys, chunk); only the offsets move.
    joined = local.join(offsets, [*keys, "__chunk"], "left")
    total = lambda name: F.col(f"__l_{name}") + F.coalesce(f"__o_{name}", F.lit(0))
    return joined.select(*df.columns, *[total(name).alias(name) for name in counts])


def with_ordinal(
    df: DataFrame,
    keys: Sequence[str] = ("region",),
    order: Sequence[Column] | None = None,
    chunk: Column | None = None,
    name: str = "time_idx",
) -> DataFrame:
    """0-based position of each row in its group."""
    order = order or [F.col("time_utc")]
    counted = with_running_counts(df, keys, order, month_chunk() if chunk is None else chunk, {name: F.lit(True)})
    return counted.withColumn(name, F.col(name) - 1)


def with_lookback_blocks(
    df: DataFrame, ordinal: str, lookback: int, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Blocks of consecutive rows, each led by the last `lookback` rows before it.

    Adds `__block` and `__own`; a window over (group, `__block`) then sees every
    row it needs, and `__own` rows are the block's real ones. A row is copied
    at most once while `lookback` stays under `block_rows`.
    """
    rows = max(block_rows, lookback)
    own = F.floor(F.col(ordinal) / rows)
    last = F.floor((F.col(ordinal) + lookback) / rows)
    return df.withColumn("__block", F.explode(F.sequence(own, last))).withColumn(
        "__own", F.col("__block") == own
    )


def over_lookback(
    df: DataFrame,
    lookback: int,
    exprs,
    keys: Sequence[str] = ("region",),
    order: Sequence[Column] | None = None,
    chunk: Column | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Columns computed over windows that reach back at most `lookback` rows.

    `exprs` maps a window spec (ordered, unframed) to {name: column}.
    """
    numbered = with_ordinal(df, keys, order, chunk, name="__ord")
    blocks = with_lookback_blocks(numbered, "__ord", lookback, block_rows)
    window = Window.partitionBy(*keys, "__block").orderBy("__ord")
    columns = exprs(window)
    computed = blocks.select("*", *[c.alias(n) for n, c in columns.items()])
    return computed.where("__own").select(*df.columns, *columns)


def lag_rows(df: DataFrame, value: str, rows: int, name: str, **kw) -> DataFrame:
    """The value `rows` rows earlier in the group (row lag, not time lag)."""
    return over_lookback(df, rows, lambda w: {name: F.lag(value, rows).over(w)}, **kw)


def trailing_mean(df: DataFrame, value: str, rows: int, name: str, **kw) -> DataFrame:
    """Mean of the previous `rows` rows, current row excluded, nulls skipped."""
    return over_lookback(df, rows, lambda w: {name: F.avg(value).over(w.rowsBetween(-rows, -1))}, **kw)


def lookback_sequences(df: DataFrame, features: Sequence[str], lookback: int, **kw) -> DataFrame:
    """Each row with the feature vectors of the `lookback` rows before it.

    The first `lookback` rows of a group have no full history and drop out, so
    groups of `lookback` rows or fewer vanish.
    """
    if lookback < 1:
        raise ValueError("lookback must be at least 1")
    vector = F.array(*[F.col(c).cast("double") for c in features])
    built = over_lookback(
        df,
        lookback,
        lambda w: {"sequence": F.collect_list(vector).over(w.rowsBetween(-lookback, -1))},
        **kw,
    )
    return built.where(F.size("sequence") == lookback)


def require_sequences(sequences: DataFrame) -> DataFrame:
    """Error when no sequence could be built."""
    if sequences.isEmpty():
        raise ValueError("No sequences were created: reduce the lookback or supply more rows per region")
    return sequences


def tail_rows(df: DataFrame, n: int, keys: Sequence[str] = ("region",), ts: str = "time_utc") -> DataFrame:
    """Last n rows of each group. The rank limit runs before the shuffle as well."""
    w = Window.partitionBy(*keys).orderBy(F.col(ts).desc())
    return df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= n).drop("__rn")


def top_rows(df: DataFrame, n: int, keys: Sequence[str], order: Sequence[Column], rank: str | None = None) -> DataFrame:
    """First n rows of each group in `order`; `rank` keeps the position as a column."""
    name = rank or "__rn"
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    kept = ranked.where(F.col(name) <= n)
    return kept if rank else kept.drop(name)


def pick_one(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key: the first in `order`."""
    return top_rows(df, 1, keys, order)
