"""Penalised additive models on log1p(load): one for all rows, or one per hour of day."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatt import constants as K
from tidewatt.functions import scalar as S
from tidewatt.models import basis as B
from tidewatt.models import rows as R
from tidewatt.models.features import require_known_regions, with_row_lags
from tidewatt.models.gram import dot, gram, grams_by, solve_by
from tidewatt.models.preprocess import cached, fit_imputer, levels, with_region_code


@dataclass
class Term:
    """One additive term: its columns as an expression, and its penalty.

    A spline also has its place on the knots, a column of its own that the
    expression then refers to many times. `rows` builds the same columns from
    arrays of the raw columns `inputs`, inside a task.
    """

    name: str
    size: int
    expr: Callable[[], Column]
    penalty: np.ndarray
    start: int = 0
    place: Callable[[], Column] | None = None
    inputs: tuple[str, ...] = ()
    rows: Callable[..., np.ndarray] | None = None


@dataclass
class Design:
    terms: list[Term] = field(default_factory=list)

    def add(self, name: str, size: int, expr: Callable[[], Column], penalty: np.ndarray, place=None, inputs=(), rows=None) -> None:
        self.terms.append(Term(name, size, expr, penalty, self.size, place, inputs, rows))

    def add_spline(self, name: str, lo: float | str, hi: float | str, n: int, lam: float) -> None:
        """A spline over [lo, hi], two numbers or the names of two columns."""
        end = lambda v: F.col(v) if isinstance(v, str) else v
        named = isinstance(lo, str)
        self.add(
            name,
            n,
            lambda: B.spline_row(F.col(f"__u_{name}"), F.col(f"__i_{name}"), F.col(f"__c_{name}"), n),
            lam * B.difference_penalty(n),
            lambda: B.spline_place(_column(name), end(lo), end(hi), n),
            (name, lo, hi) if named else (name,),
            (lambda x, a, b: R.spline(x, a, b, n)) if named else (lambda x: R.spline(x, lo, hi, n)),
        )

    @property
    def inputs(self) -> list[str]:
        """The raw columns that the design rows are built from."""
        return list(dict.fromkeys(c for t in self.terms for c in t.inputs))

    def raw(self, name: str = "x") -> Column:
        """The raw columns of a row as an array, for `prepare`."""
        return F.array(*[_column(c) for c in self.inputs]).alias(name)

    def matrix(self, raw: np.ndarray) -> np.ndarray:
        """Design rows from rows of `inputs`."""
        at = {c: i for i, c in enumerate(self.inputs)}
        ones = np.ones((len(raw), 1))
        return np.hstack([t.rows(*[raw[:, at[c]] for c in t.inputs]) if t.inputs else ones for t in self.terms])

    def prepare(self) -> Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """What turns raw rows into design rows inside the task that sums them."""
        return lambda x, y: R.complete(self.matrix(x), y)

    @property
    def size(self) -> int:
        return sum(t.size for t in self.terms)

    def apply(self, df: DataFrame, name: str = "x") -> DataFrame:
        """`df` with the design row as an array. Places are settled in steps, so that no step's code grows large."""
        splines = [t for t in self.terms if t.place is not None]
        placed = df.withColumns({f"__u_{t.name}": t.place() for t in splines})
        cells = {}
        for t in splines:
            cell = B.spline_cell(F.col(f"__u_{t.name}"), t.size)
            cells.update({f"__i_{t.name}": cell["inside"], f"__c_{t.name}": cell["cell"]})
        full = placed.withColumns(cells).withColumn(name, F.concat(*[t.expr() for t in self.terms]))
        return full.drop(*[f"__{k}_{t.name}" for t in splines for k in "uic"])

    def penalty(self, ridge: float = 1e-6) -> np.ndarray:
        out = np.eye(self.size) * ridge
        for t in self.terms:
            out[t.start : t.start + t.size, t.start : t.start + t.size] += t.penalty
        return out

    def term(self, name: str) -> Term:
        return next(t for t in self.terms if t.name == name)


def _column(name: str) -> Column:
    return F.col(name).cast("double")


def edges(train: DataFrame, names: list[str]) -> dict[str, tuple[float, float]]:
    row = train.agg(*[f(c).cast("double").alias(f"{tag}_{c}") for c in names for tag, f in (("lo", F.min), ("hi", F.max))]).first()
    return {c: (row[f"lo_{c}"], row[f"hi_{c}"]) for c in names}


def additive_design(train: DataFrame, regions: int, n_splines: int = 25, lam: float = 0.6) -> Design:
    design = Design()
    design.add("intercept", 1, lambda: F.array(F.lit(1.0)), np.zeros((1, 1)))
    for name, (lo, hi) in edges(train, K.ADDITIVE_SPLINES).items():
        design.add_spline(name, lo, hi, n_splines, lam)
    for name, (n, lo, hi) in K.ADDITIVE_CYCLIC.items():
        design.add(
            name,
            n,
            lambda name=name, n=n, lo=lo, hi=hi: B.cyclic_basis(_column(name), lo, hi, n),
            lam * B.difference_penalty(n, cyclic=True),
            inputs=(name,),
            rows=lambda x, n=n, lo=lo, hi=hi: R.cyclic(x, lo, hi, n),
        )
    for name in K.ADDITIVE_LINEAR:
        design.add(name, 1, lambda name=name: F.array(_column(name)), lam * np.eye(1), inputs=(name,), rows=lambda x: x[:, None])
    for name, n in zip(K.ADDITIVE_FACTORS, (regions, 7)):
        design.add(name, n, lambda name=name, n=n: B.one_hot(_column(name), n), lam * np.eye(n), inputs=(name,), rows=lambda x, n=n: R.one_hot(x, n))
    return design


@dataclass
class AdditiveModel:
    design: Design
    beta: np.ndarray
    covariance: np.ndarray
    prepare: Callable[[DataFrame], DataFrame]
    train_rows: int
    edges: dict[str, tuple[float, float]]

    def predict(self, df: DataFrame) -> DataFrame:
        weights = F.lit([float(b) for b in self.beta])
        scored = self.design.apply(self.prepare(df), "__x")
        return scored.withColumn("predicted_load_mw", S.from_log(dot(F.col("__x"), weights))).drop("__x")

    def partial_effect(self, spark, name: str, points: int = 100, z: float = 1.959963984540054) -> DataFrame:
        """Effect of one spline term on log load over its range, with a 95 % band."""
        term = self.design.term(name)
        cut = slice(term.start, term.start + term.size)
        lo, hi = self.edges.get(name) or K.ADDITIVE_CYCLIC[name][1:]
        # se^2 = |L'b|^2 for the Cholesky factor L of the term's covariance.
        block = self.covariance[cut, cut]
        vals, vecs = np.linalg.eigh((block + block.T) / 2)
        factor = (vecs * np.sqrt(np.maximum(vals, 0.0))).T
        grid = spark.range(points).select(
            (F.col("id") / float(points - 1) * (hi - lo) + lo).alias(name)
        )
        alone = Design([Term(term.name, term.size, term.expr, term.penalty, 0, term.place)])
        rows = alone.apply(grid, "__b")
        effect = dot(F.col("__b"), F.lit([float(b) for b in self.beta[cut]]))
        variance = F.aggregate(
            F.array(*[dot(F.col("__b"), F.lit([float(v) for v in r])) for r in factor]),
            F.lit(0.0),
            lambda acc, v: acc + v * v,
        )
        out = rows.select(name, effect.alias("effect"), F.sqrt(variance).alias("se"))
        return out.withColumns({"lower": F.col("effect") - z * F.col("se"), "upper": F.col("effect") + z * F.col("se")})


def fit_additive(train: DataFrame, n_splines: int = 25, lam: float = 0.6) -> AdditiveModel:
    """Fit on rows that already carry the row lags (see `with_row_lags`)."""
    known = levels(train, "region")
    columns = [*K.ADDITIVE_SPLINES, *K.ADDITIVE_CYCLIC, *K.ADDITIVE_LINEAR]
    impute = fit_imputer(train.withColumns({c: _column(c) for c in columns}), columns)

    def prepare(df: DataFrame) -> DataFrame:
        return with_region_code(impute(df.withColumns({c: _column(c) for c in columns})), known)

    ready = prepare(train)
    design = additive_design(ready, len(known), n_splines, lam)
    g = gram(ready.select(design.raw(), S.to_log(F.col("load_mw")).alias("y")), design.prepare())
    system = g.xtx + design.penalty()
    beta = np.linalg.solve(system, g.xty)
    inverse = np.linalg.inv(system)
    freedom = float(np.trace(inverse @ g.xtx))
    rss = g.yty - 2 * beta @ g.xty + beta @ g.xtx @ beta
    sigma2 = max(rss, 0.0) / max(g.n - freedom, 1.0)
    covariance = sigma2 * inverse @ g.xtx @ inverse
    return AdditiveModel(design, beta, covariance, prepare, g.n, edges(ready, K.ADDITIVE_SPLINES))


def fit_additive_split(train: DataFrame, valid: DataFrame, **kw) -> tuple[AdditiveModel, DataFrame]:
    """Row lags over both splits, regions checked, model fitted; returns it with the lagged validation rows."""
    lagged_train, lagged_valid = with_row_lags(train, valid)
    with cached(lagged_train) as rows:
        require_known_regions(rows, lagged_valid)
        return fit_additive(rows, **kw), lagged_valid


def fit_additive_by_hour(train: DataFrame, valid: DataFrame, n_splines: int = 20, lam: float = 0.6) -> DataFrame:
    """One additive model per hour of day, each with knots over its own hour's range.

    The hours share one pass: Grams are summed per hour and solved per hour.
    Hours without training rows leave their validation rows out.
    """
    terms = K.HOURLY_ADDITIVE_TERMS
    known = levels(train, "region")
    usable_train = train.dropna(subset=["load_mw", *terms])
    usable_valid = valid.dropna(subset=terms)
    # One row per hour of day, so 24 at most.
    bounds = usable_train.groupBy("hour").agg(
        *[f(_column(c)).alias(f"{tag}_{c}") for c in terms for tag, f in (("lo", F.min), ("hi", F.max))]
    )
    design = Design()
    design.add("intercept", 1, lambda: F.array(F.lit(1.0)), np.zeros((1, 1)))
    for name in terms:
        design.add_spline(name, f"lo_{name}", f"hi_{name}", n_splines, lam)
    n = len(known)
    design.add("region_code", n, lambda: B.one_hot(_column("region_code"), n), lam * np.eye(n), inputs=("region_code",), rows=lambda x: R.one_hot(x, n))

    def ready(df: DataFrame) -> DataFrame:
        return with_region_code(df, known).na.fill({"region_code": 0}).join(F.broadcast(bounds), "hour")

    rows = ready(usable_train).select("hour", design.raw(), S.to_log(F.col("load_mw")).alias("y"))
    betas = solve_by(grams_by(rows, F.col("hour"), design.prepare()), design.penalty()).select(
        F.col("key").cast("int").alias("hour"), "beta"
    )
    scored = design.apply(ready(usable_valid)).join(F.broadcast(betas), "hour")
    return scored.select(
        "region",
        "time_utc",
        "hour",
        F.col("load_mw").alias("actual_load_mw"),
        S.from_log(dot(F.col("x"), F.col("beta"))).alias("predicted_load_mw"),
    )
