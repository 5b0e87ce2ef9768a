"""Many months and models of a backtest from one pass over the rows.

Expanding windows overlap: month m trains on every row before it. So the rows are cut into segments between the scored
months, each task sums Gram matrices by segment, and a window's Gram is the sum of the segments before it. What a window
alone decides (medians for gaps, scales, knots) is applied to the summed matrices where it is linear in the columns; a
design that depends on the window otherwise is built once for each of its settings, in the same pass.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatt import constants as K
from tidewatt.functions import scalar as S
from tidewatt.models import basis as B
from tidewatt.models import rows as R
from tidewatt.models.features import numeric_features, with_calendar
from tidewatt.models.gram import PARTIAL, added_up, smallest_solution
from tidewatt.models.seasonal import HINGES, SEASONS, days, design_rows
from tidewatt.operators import evaluate as E
from tidewatt.operators import panel as P
from tidewatt.operators.ordered import over_lookback
from tidewatt.operators.quantiles import exact_quantiles
from tidewatt.session import materialize

SWEPT = ("linear", "ridge", "additive", "seasonal")
#: Each model's own settings and their usual values.
SETTINGS = {
    "linear": {},
    "ridge": {"alpha": 10.0},
    "additive": {"n_splines": 25, "lam": 0.6},
    "seasonal": {"changepoint_scale": 0.05, "seasonality_scale": 10.0},
}
#: Most (month, region) pairs that the driver plans with.
MOST_CELLS = 1_000_000


def month_number(month: str) -> int:
    start = P.month_bounds(month)[0]
    return start.year * 12 + start.month - 1


@dataclass
class Window:
    """What training before one month settles, and its fits."""

    month: str
    number: int
    train_rows: int = 0
    regions: list[str] = field(default_factory=list)
    usual: str | None = None
    medians: dict[str, float] = field(default_factory=dict)
    lagged_regions: list[str] = field(default_factory=list)
    lagged_medians: dict[str, float] = field(default_factory=dict)
    edges: dict[str, tuple[float, float]] = field(default_factory=dict)
    by_region: dict[str, dict] = field(default_factory=dict)
    fits: dict[str, object] = field(default_factory=dict)


@dataclass
class Plan:
    """What the tasks need: columns of the shipped rows, levels, windows, and the design of each model."""

    columns: list[str]
    numeric: list[str]
    levels: list[str]
    windows: list[Window]
    models: dict[str, dict]
    #: About the mean of each number and of the load: sums of squares are taken around them.
    centres: dict[str, float]

    def segment(self, months: np.ndarray) -> np.ndarray:
        """Scored months up to each row's own: the row trains the windows from that number on."""
        return np.searchsorted([w.number for w in self.windows], months, side="right")

    def settings(self) -> dict[tuple, list[int]]:
        """Windows by the knots of their additive design."""
        out: dict[tuple, list[int]] = {}
        for k, w in enumerate(self.windows):
            if w.edges:
                out.setdefault(tuple(sorted(w.edges.items())), []).append(k)
        return out


# ---- design rows ---------------------------------------------------------------------------


def least_squares_rows(plan: Plan, x: dict[str, np.ndarray]) -> np.ndarray:
    """Numbers less their centres with gaps as zero, gap marks, one column a region, one for a missing region, ones and
    the load less its centre."""
    v = np.stack([x[c] - plan.centres[c] for c in plan.numeric], axis=1)
    gaps = np.isnan(v)
    region = R.one_hot(x["region"], len(plan.levels))
    load = x["load_mw"] - plan.centres["load_mw"]
    return np.hstack([np.where(gaps, 0.0, v), gaps, region, (x["region"] < 0)[:, None], np.ones((len(v), 1)), load[:, None]])


def centred_medians(plan: Plan, w: Window) -> np.ndarray:
    return np.array([w.medians[c] - plan.centres[c] if c in w.medians else 0.0 for c in plan.numeric])


def additive_blocks(plan: Plan, edges: dict, n_splines: int) -> list[tuple[str, int, Callable, str]]:
    """(column, size, rows, kind) of each term behind the intercept."""
    out = [(c, n_splines, lambda x, e=edges[c]: R.spline(x, *e, n_splines), "smooth") for c in K.ADDITIVE_SPLINES]
    out += [(c, n, lambda x, n=n, lo=lo, hi=hi: R.cyclic(x, lo, hi, n), "cyclic") for c, (n, lo, hi) in K.ADDITIVE_CYCLIC.items()]
    out += [(c, 1, lambda x: x[:, None], "plain") for c in K.ADDITIVE_LINEAR]
    return out + [("region", len(plan.levels), lambda x: R.one_hot(x, len(plan.levels)), "factor"), ("day_of_week", 7, lambda x: R.one_hot(x, 7), "factor")]


def additive_rows(plan: Plan, edges: dict, n_splines: int, x: dict[str, np.ndarray]) -> np.ndarray:
    """Ones, each term's columns with gaps as zero, and a gap mark a term: a gap's own columns are added afterwards."""
    parts, marks = [np.ones((len(x["load_mw"]), 1))], []
    for column, _, rows, _ in additive_blocks(plan, edges, n_splines):
        gap = np.isnan(x[column])
        parts.append(np.where(gap[:, None], 0.0, rows(np.where(gap, 0.0, x[column]))))
        marks.append(gap[:, None])
    return np.hstack([*parts, *marks])


def additive_filled(plan: Plan, w: Window, n_splines: int) -> np.ndarray:
    """The map from `additive_rows` to the window's design, in which a gap is the median."""
    blocks = additive_blocks(plan, w.edges, n_splines)
    size = 1 + sum(b[1] for b in blocks)
    out = np.vstack([np.eye(size), np.zeros((len(blocks), size))])
    start = 1
    for i, (column, width, rows, _) in enumerate(blocks):
        if column in w.lagged_medians:
            out[size + i, start : start + width] = rows(np.array([w.lagged_medians[column]]))[0]
        start += width
    return out


def additive_penalty(plan: Plan, edges: dict, n_splines: int, lam: float) -> np.ndarray:
    blocks = additive_blocks(plan, edges, n_splines)
    out, start = np.eye(1 + sum(b[1] for b in blocks)) * 1e-6, 1
    for _, n, _, kind in blocks:
        own = np.eye(n) if kind in ("plain", "factor") else B.difference_penalty(n, cyclic=kind == "cyclic")
        out[start : start + n, start : start + n] += lam * own
        start += n
    return out


def seasonal_names(plan: Plan) -> list[str]:
    return [c for c in K.SEASONAL_REGRESSORS if c in plan.columns]


def seasonal_rows(plan: Plan, own: dict, x: dict[str, np.ndarray]) -> np.ndarray:
    """Design rows of one region in one window."""
    t = (x["__day"] - own["d0"]) / max(own["d1"] - own["d0"], 1e-9)
    parts = [x["__day"], t]
    for c in seasonal_names(plan):
        v = np.where(np.isnan(x[c]), own["medians"].get(c, 0.0), x[c])
        parts.append((v - own["mean"][c]) / own["std"][c] if own["std"][c] > 0 else np.zeros(len(v)))
    return design_rows(np.stack(parts, axis=1))


# ---- the pass that sums --------------------------------------------------------------------


def squares(z: np.ndarray) -> np.ndarray:
    return (z.T @ z).ravel()


def segment_sums(plan: Plan):
    """What a task does: Gram matrices of its rows by model, setting and segment."""

    def run(batches):
        from pyspark import TaskContext

        task, sums = TaskContext.get().partitionId(), {}

        def add(key: str, z: np.ndarray) -> None:
            sums[key] = sums.get(key, 0.0) + squares(z)

        last, names = len(plan.windows), plan.columns
        for batch in batches:
            x = {c: batch.column(i).to_numpy(zero_copy_only=False).astype(float) for i, c in enumerate(names)}
            segment = plan.segment(x["__month"])
            for s in np.unique(segment[segment < last]).tolist():
                part = {c: v[segment == s] for c, v in x.items()}
                if "linear" in plan.models or "ridge" in plan.models:
                    add(f"ls:{s}", least_squares_rows(plan, part))
                if "additive" in plan.models and (has := ~np.isnan(part["load_lag_24h"])).any():
                    lagged = {c: v[has] for c, v in part.items()}
                    for e, (edges, users) in enumerate(plan.settings().items()):
                        if max(users) >= s:
                            z = additive_rows(plan, dict(edges), plan.models["additive"]["n_splines"], lagged)
                            add(f"add:{e}:{s}", np.hstack([z, np.log1p(lagged["load_mw"])[:, None]]))
                if "seasonal" in plan.models:
                    for r in np.unique(part["region"][part["region"] >= 0]).tolist():
                        own = {c: v[part["region"] == r] for c, v in part.items()}
                        for k in range(s, last):
                            at = plan.windows[k].by_region[plan.levels[int(r)]]
                            if at["scale"] > 0:
                                add(f"sea:{k}:{int(r)}", np.hstack([seasonal_rows(plan, at, own), own["load_mw"][:, None] / at["scale"]]))
        yield pa.RecordBatch.from_pydict(
            {
                "key": pa.array(list(sums), pa.string()),
                "task": pa.array([task] * len(sums), pa.int32()),
                "stats": pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64())),
            }
        )

    return run


def prefix(sums: dict[str, np.ndarray], name: str, upto: int) -> np.ndarray | None:
    """The sum of a model's segments up to and including one."""
    parts = [sums[f"{name}:{s}"] for s in range(upto + 1) if f"{name}:{s}" in sums]
    if not parts:
        return None
    total = np.sum(parts, axis=0)
    size = round(np.sqrt(len(total)))
    return total.reshape(size, size)


# ---- the fits -----------------------------------------------------------------------------


def solve_least_squares(plan: Plan, w: Window, z: np.ndarray, alpha: float) -> dict:
    """Weights on the centred numbers and regions, from the window's sums of `least_squares_rows`."""
    p, levels = len(plan.numeric), len(plan.levels)
    to_x = np.zeros((z.shape[0], p + levels))
    to_x[:p, :p] = np.eye(p)
    to_x[p : 2 * p, :p] = np.diag(centred_medians(plan, w))
    to_x[2 * p : 2 * p + levels, p:] = np.eye(levels)
    if w.usual is not None:
        to_x[2 * p + levels, p + plan.levels.index(w.usual)] = 1.0
    one, load = z.shape[0] - 2, z.shape[0] - 1
    n = z[one, one]
    mean = to_x.T @ z[:, one] / n
    spread = to_x.T @ z @ to_x - n * np.outer(mean, mean)
    with_load = to_x.T @ z[:, load] - mean * z[one, load]
    deviation = np.sqrt(np.maximum(np.diag(spread) / n, 0.0))
    # A constant number carries no weight; what its sums show as spread is rounding, about 1e-8 of its mean.
    centre = np.array([abs(plan.centres[c]) for c in plan.numeric] + [0.0] * levels)
    moves = deviation > 1e-6 * np.abs(mean) + 1e-12 * centre
    scale = np.concatenate([np.where(moves[:p], deviation[:p], 1.0), np.ones(levels)])
    used = np.flatnonzero(np.concatenate([moves[:p], np.ones(levels, bool)]))
    inner = (spread / np.outer(scale, scale))[np.ix_(used, used)]
    right = (with_load / scale)[used]
    weights = np.zeros(p + levels)
    weights[used] = np.linalg.solve(inner + alpha * np.eye(len(used)), right) if alpha else smallest_solution(inner, right)
    weights /= scale
    return {"weights": weights, "intercept": plan.centres["load_mw"] + z[one, load] / n - mean @ weights}


def settle(plan: Plan, sums: dict[str, np.ndarray]) -> None:
    """Every window's fits, from the summed segments."""
    users = [(e, ks) for e, ks in enumerate(plan.settings().values())]
    for k, w in enumerate(plan.windows):
        least = prefix(sums, "ls", k)
        for name in ("linear", "ridge"):
            if name in plan.models and least is not None:
                w.fits[name] = solve_least_squares(plan, w, least, plan.models[name].get("alpha", 0.0))
        if "additive" in plan.models and w.edges:
            own = plan.models["additive"]
            z = prefix(sums, f"add:{next(e for e, ks in users if k in ks)}", k)
            fill = additive_filled(plan, w, own["n_splines"])
            xtx, xty = fill.T @ z[:-1, :-1] @ fill, fill.T @ z[:-1, -1]
            w.fits["additive"] = np.linalg.solve(xtx + additive_penalty(plan, w.edges, **own), xty)
        if "seasonal" in plan.models:
            own = plan.models["seasonal"]
            count = 2 * sum(order for _, _, order in SEASONS) + len(seasonal_names(plan))
            ridge = [np.full(2, 1e-6), np.full(HINGES, own["changepoint_scale"] ** -2), np.full(count, own["seasonality_scale"] ** -2)]
            betas = {}
            for r, region in enumerate(plan.levels):
                total = sums.get(f"sea:{k}:{r}")
                if total is not None:
                    z = total.reshape(round(np.sqrt(len(total))), -1)
                    betas[region] = np.linalg.lstsq(z[:-1, :-1] + np.diag(np.concatenate(ridge)), z[:-1, -1], rcond=None)[0]
            w.fits["seasonal"] = betas


# ---- scoring ------------------------------------------------------------------------------


def predicted(plan: Plan, w: Window, name: str, x: dict[str, np.ndarray]) -> np.ndarray:
    """One model's predictions of rows of the window's month; NaN where it gives none."""
    if name in ("linear", "ridge"):
        z = least_squares_rows(plan, x)
        p, levels, fit = len(plan.numeric), len(plan.levels), w.fits[name]
        v = z[:, :p] + z[:, p : 2 * p] * centred_medians(plan, w)
        region = z[:, 2 * p : 2 * p + levels].copy()
        if w.usual is not None:
            region[:, plan.levels.index(w.usual)] += z[:, 2 * p + levels]
        return np.hstack([v, region]) @ fit["weights"] + fit["intercept"]
    if name == "additive":
        n = plan.models["additive"]["n_splines"]
        return np.maximum(np.expm1(additive_rows(plan, w.edges, n, x) @ additive_filled(plan, w, n) @ w.fits["additive"]), 0.0)
    out = np.full(len(x["load_mw"]), np.nan)
    for r, region in enumerate(plan.levels):
        own = x["region"] == r
        if region in w.fits["seasonal"] and own.any():
            at = w.by_region[region]
            value = seasonal_rows(plan, at, {c: v[own] for c, v in x.items()}) @ w.fits["seasonal"][region] * at["scale"]
            out[own] = np.maximum(value, 0.0)
    return out


def scored_rows(plan: Plan, rows: DataFrame, pairs: set[tuple[str, str]]) -> DataFrame:
    """region, time_utc, actual_load_mw, predicted_load_mw, model and month of every wanted pair, in one pass."""
    windows = {w.number: w for w in plan.windows}
    schema = "region string, time_utc timestamp, actual_load_mw double, predicted_load_mw double, model string, month string"

    def run(batches):
        names = plan.columns
        for batch in batches:
            x = {c: batch.column(i + 2).to_numpy(zero_copy_only=False).astype(float) for i, c in enumerate(names)}
            for number in np.unique(x["__month"]).tolist():
                w = windows.get(int(number))
                for name in plan.models if w else ():
                    if (name, w.month) not in pairs:
                        continue
                    own = (x["__month"] == number) & (~np.isnan(x["load_lag_24h"]) if name == "additive" else True)
                    if not own.any():
                        continue
                    value = predicted(plan, w, name, {c: v[own] for c, v in x.items()})
                    at = pa.array(np.flatnonzero(own))
                    n = len(at)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(at), batch.column(1).take(at), pa.array(x["load_mw"][own]), pa.array(value, from_pandas=True), pa.array([name] * n), pa.array([w.month] * n)],
                        names=["region", "time_utc", "actual_load_mw", "predicted_load_mw", "model", "month"],
                    )

    return rows.mapInArrow(run, schema)


# ---- planning -----------------------------------------------------------------------------


def prepared(revised: DataFrame, months: Sequence[str], lags: bool) -> DataFrame:
    """Usable rows up to the last scored month, with calendar columns, row lags, month number and day."""
    P.require_columns(revised, K.REVISED_COLUMNS)
    end = max(P.month_bounds(m)[1] for m in months)
    rows = P.usable_rows(with_calendar(revised)).where(F.col("time_utc") < P.utc_lit(end))
    if lags:
        rows = over_lookback(
            rows, 24, lambda w: {"load_lag_24h": F.lag("load_mw", 24).over(w), "load_24h_avg": F.avg("load_mw").over(w.rowsBetween(-24, -1))}
        )
    else:
        rows = rows.withColumns({"load_lag_24h": F.lit(None).cast("double"), "load_24h_avg": F.lit(None).cast("double")})
    ts = F.col("time_utc")
    return rows.withColumns({"__month": F.year(ts) * 12 + F.month(ts) - 1, "__day": days()})


def window_medians(rows: DataFrame, windows: list[Window], columns: list[str], by: list[str]) -> list[tuple]:
    """(window, by..., medians) of the training rows of each window."""
    if not columns:
        return []
    numbers = [w.number for w in windows]
    later = F.filter(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(m).alias("m")) for k, m in enumerate(numbers)]), lambda w: w["m"] > F.col("__month"))
    spread = rows.select("__month", *by, *columns).withColumn("__w", F.explode(F.transform(later, lambda w: w["k"])))
    return [tuple(r) for r in exact_quantiles(spread, columns, by=["__w", *by]).collect()]


def planned(rows: DataFrame, numeric: list[str], models: dict[str, dict], months: Sequence[str]) -> tuple[Plan, dict[str, int]]:
    """The plan, and the usable rows of each scored month. One aggregate by month and region, and medians of the columns
    that have gaps."""
    lagged = F.col("load_lag_24h").isNotNull()
    terms = [*K.ADDITIVE_SPLINES, *K.ADDITIVE_CYCLIC, *K.ADDITIVE_LINEAR]
    seasonal = [c for c in K.SEASONAL_REGRESSORS if c in rows.columns]
    aggs = {"n": F.count(F.lit(1)), "lagged": F.count_if(lagged), "d0": F.min("__day"), "d1": F.max("__day"), "scale": F.max(F.abs("load_mw"))}
    for c in {*numeric, *terms}:
        aggs[f"gaps_{c}"] = F.count_if(F.col(c).isNull())
        aggs[f"lagged_gaps_{c}"] = F.count_if(lagged & F.col(c).isNull())
    for c in [*numeric, "load_mw"]:
        aggs[f"centre_{c}"] = F.avg(F.col(c).cast("double"))
    for c in K.ADDITIVE_SPLINES:
        aggs |= {f"lo_{c}": F.min(F.when(lagged, F.col(c))), f"hi_{c}": F.max(F.when(lagged, F.col(c)))}
    for c in seasonal:
        v = F.col(c).cast("double")
        aggs |= {f"sum_{c}": F.sum(v), f"mid_{c}": F.avg(v), f"dev_{c}": F.var_pop(v), f"has_{c}": F.count(v)}
    cells = rows.groupBy("__month", "region").agg(*[a.alias(n) for n, a in aggs.items()]).limit(MOST_CELLS + 1).collect()
    if len(cells) > MOST_CELLS:
        raise ValueError(f"more than {MOST_CELLS} months and regions to plan with")
    windows = [Window(m, month_number(m)) for m in sorted(set(months), key=month_number)]
    levels = sorted({c["region"] for c in cells if c["region"] is not None})
    in_month = {w.month: sum(c["n"] for c in cells if c["__month"] == w.number) for w in windows}

    holes = lambda tag, names: [c for c in names if any(cell[f"{tag}_{c}"] for cell in cells)]
    for k, *values in window_medians(rows, windows, holes("gaps", numeric), []):
        windows[k].medians = {c: v for c, v in zip(holes("gaps", numeric), values) if v is not None}
    if "additive" in models:
        for k, *values in window_medians(rows.where(lagged), windows, holes("lagged_gaps", terms), []):
            windows[k].lagged_medians = {c: v for c, v in zip(holes("lagged_gaps", terms), values) if v is not None}
    regional: dict[tuple, dict] = {}
    if "seasonal" in models:
        gaps = holes("gaps", [c for c in seasonal if c in numeric])
        for k, region, *values in window_medians(rows, windows, gaps, ["region"]):
            regional[k, region] = dict(zip(gaps, values))

    for k, w in enumerate(windows):
        past = [c for c in cells if c["__month"] < w.number]
        w.train_rows = sum(c["n"] for c in past)
        counts = {r: sum(c["n"] for c in past if c["region"] == r) for r in levels}
        w.regions = [r for r in levels if counts[r]]
        w.usual = min(w.regions, key=lambda r: (-counts[r], r)) if w.regions else None
        w.lagged_regions = sorted({c["region"] for c in past if c["lagged"] and c["region"] is not None})
        if w.lagged_regions and "additive" in models:
            for c in K.ADDITIVE_SPLINES:
                seen = [(cell[f"lo_{c}"], cell[f"hi_{c}"]) for cell in past if cell[f"lo_{c}"] is not None]
                w.edges[c] = (float(min(lo for lo, _ in seen)), float(max(hi for _, hi in seen))) if seen else (0.0, 0.0)
        for region in w.regions if "seasonal" in models else ():
            own = [c for c in past if c["region"] == region]
            n = sum(c["n"] for c in own)
            at = {"d0": min(c["d0"] for c in own), "d1": max(c["d1"] for c in own), "scale": max(c["scale"] or 0.0 for c in own), "mean": {}, "std": {}}
            at["medians"] = {c: v for c, v in regional.get((k, region), {}).items() if v is not None}
            for c in seasonal:
                # Months' means and spreads, and the gaps at the median, put together around the common mean.
                groups = [(cell[f"has_{c}"], cell[f"mid_{c}"], cell[f"dev_{c}"]) for cell in own if cell[f"has_{c}"]]
                if gaps := n - sum(g[0] for g in groups):
                    groups.append((gaps, at["medians"].get(c, 0.0), 0.0))
                mean = sum(g[0] * g[1] for g in groups) / n
                at["mean"][c] = mean
                at["std"][c] = float(np.sqrt(sum(g[0] * (g[2] + (g[1] - mean) ** 2) for g in groups) / n))
            w.by_region[region] = at
    code = ["__month", "__day", "region", "load_mw"]
    columns = [*code, *dict.fromkeys(c for c in [*numeric, *terms, "day_of_week", "load_lag_24h", *seasonal] if c not in code)]
    centres = {}
    for c in [*numeric, "load_mw"]:
        known = [(cell["n"], cell[f"centre_{c}"]) for cell in cells if cell[f"centre_{c}"] is not None]
        centres[c] = sum(n * v for n, v in known) / sum(n for n, _ in known) if known else 0.0
    return Plan(columns, numeric, levels, windows, models, centres), in_month


def sweep(
    revised: DataFrame, models: dict[str, dict], months: Sequence[str], skip: set[tuple[str, str]] = frozenset()
) -> tuple[DataFrame, DataFrame, list[tuple[str, str, str]]]:
    """(predictions, training rows, failures) of every model of SWEPT on every month but the pairs in `skip`.

    `predictions`: region, time_key, time_utc, loads, error columns, model and month. `training rows`: model, month and
    train_rows_used of the pairs that were fitted. A month without usable rows before it or in it fails for its models,
    and the additive model where the month has a region that it was not trained on, as in single runs.
    """
    unknown = set(models) - set(SWEPT)
    if unknown:
        raise ValueError(f"No sweep for {sorted(unknown)}: expected some of {SWEPT}")
    settled = {}
    for name, given in models.items():
        if extra := set(given) - set(SETTINGS[name]):
            raise ValueError(f"{name} has no setting {sorted(extra)}")
        settled[name] = SETTINGS[name] | given
    spark = revised.sparkSession
    numeric = [c for c in numeric_features(with_calendar(revised)) if c not in ("__month", "__day")]
    rows = materialize(prepared(revised, months, "additive" in models), "sweep-rows")
    plan, in_month = planned(rows, numeric, settled, months)

    failures, pairs, last_regions = [], set(), {}
    for c in rows.where(F.col("load_lag_24h").isNotNull() & F.col("region").isNotNull()).select("__month", "region").distinct().collect():
        last_regions.setdefault(c["__month"], set()).add(c["region"])
    for w in plan.windows:
        for name in settled:
            if (name, w.month) in skip:
                continue
            unseen = sorted(last_regions.get(w.number, set()) - set(w.lagged_regions))
            if not w.train_rows or not in_month[w.month]:
                failures.append((name, w.month, f"No usable {'validation' if w.train_rows else 'training'} rows for month {w.month}"))
            elif name == "additive" and unseen:
                failures.append((name, w.month, f"Validation data contains regions not seen in training: {unseen}"))
            elif name == "additive" and not w.edges:
                failures.append((name, w.month, "no rows to fit"))
            else:
                pairs.add((name, w.month))

    codes = F.coalesce(F.element_at(F.create_map(*[F.lit(v) for i, r in enumerate(plan.levels) for v in (r, float(i))]), F.col("region")), F.lit(-1.0)) if plan.levels else F.lit(-1.0)
    shipped = [codes.alias("region") if c == "region" else F.col(c).cast("double").alias(c) for c in plan.columns]
    sums = added_up(rows.select(*shipped).mapInArrow(segment_sums(plan), PARTIAL)).collect()
    settle(plan, {r["key"]: np.array(r["stats"]) for r in sums})
    ahead = rows.where(F.col("__month").isin([w.number for w in plan.windows]))
    scored = scored_rows(plan, ahead.select("region", "time_utc", *[c.alias(f"__{i}") for i, c in enumerate(shipped)]), pairs)
    predictions = E.predictions_frame(scored.withColumn("time_key", S.time_key(F.col("time_utc"))))
    predictions = predictions.select("region", "time_key", "time_utc", *[c for c in predictions.columns if c not in ("region", "time_key", "time_utc")])
    trained = [(name, w.month, w.train_rows) for w in plan.windows for name in settled if (name, w.month) in pairs]
    return predictions, spark.createDataFrame(trained, "model string, month string, train_rows_used long"), failures
