"""Basis columns of the additive and seasonal models, as array expressions."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def _weights(f: Column) -> list[Column]:
    """The four cubic B-splines that overlap a unit cell, at position f in it."""
    g = 1.0 - f
    return [
        g * g * g / 6.0,
        ((f * 3.0 - 6.0) * f * f + 4.0) / 6.0,
        (((f * -3.0 + 3.0) * f + 3.0) * f + 1.0) / 6.0,
        f * f * f / 6.0,
    ]


def _slopes(f: Column) -> list[Column]:
    g = 1.0 - f
    return [g * g / -2.0, (f * 9.0 - 12.0) * f / 6.0, ((f * -9.0 + 6.0) * f + 3.0) / 6.0, f * f / 2.0]


def _zeros(n: Column) -> Column:
    return F.array_repeat(F.lit(0.0), n.cast("int"))


def spline_place(x: Column, lo: Column | float, hi: Column | float, n: int) -> Column:
    """x in knot steps from lo."""
    lo, hi = (v if isinstance(v, Column) else F.lit(float(v)) for v in (lo, hi))
    return (x - lo) / F.when(hi > lo, (hi - lo) / float(n - 3)).otherwise(1.0)


def spline_cell(u: Column, n: int) -> dict[str, Column]:
    """The place held inside the knots, and the cell it falls into."""
    inside = F.when(u.isNotNull(), F.least(F.greatest(u, F.lit(0.0)), F.lit(float(n - 3))))
    return {"inside": inside, "cell": F.least(F.floor(inside), F.lit(n - 4))}


def spline_row(u: Column, inside: Column, cell: Column, n: int) -> Column:
    """Only four splines differ from zero at any point: those four between two runs of zeros."""
    f, beyond = inside - cell, u - inside
    four = F.array(*[w + s * beyond for w, s in zip(_weights(f), _slopes(f))])
    return F.concat(_zeros(cell), four, _zeros(F.lit(n - 4) - cell))


def spline_basis(x: Column, lo: Column | float, hi: Column | float, n: int) -> Column:
    """n cubic B-splines on even knots over [lo, hi]; straight-line continuation outside."""
    u = spline_place(x, lo, hi, n)
    return spline_row(u, *spline_cell(u, n).values(), n)


def cyclic_basis(x: Column, lo: float, hi: float, n: int) -> Column:
    """n cubic B-splines that wrap from hi back to lo."""
    u = F.pmod((x - lo) / ((hi - lo) / n), F.lit(float(n)))
    cell = F.floor(u)
    run = F.concat(F.array(*_weights(u - cell)), _zeros(F.lit(n - 4)))
    turn = F.pmod(cell - 3, F.lit(n)).cast("int")
    return F.concat(F.slice(run, F.lit(n + 1) - turn, turn), F.slice(run, F.lit(1), F.lit(n) - turn))


def one_hot(code: Column, n: int) -> Column:
    """n indicators, all zero for a code outside 0..n-1."""
    hit = (code >= 0) & (code < n) & (code == F.floor(code))
    return F.when(
        hit, F.concat(_zeros(code), F.array(F.lit(1.0)), _zeros(F.lit(n - 1) - code))
    ).otherwise(F.array_repeat(F.lit(0.0), n))


def fourier(days: Column, period: float, order: int) -> Column:
    """sin and cos of the first `order` harmonics of a period in days."""
    angle = days * (2 * math.pi / period)
    return F.array(*[f(angle * float(k)) for k in range(1, order + 1) for f in (F.sin, F.cos)])


def hinges(t: Column, count: int, span: float = 0.8) -> Column:
    """Slope changes at even points over the first `span` of the history (t runs from 0 to 1)."""
    return F.array(*[F.greatest(t - span * (k + 1) / (count + 1), F.lit(0.0)) for k in range(count)])


def difference_penalty(n: int, cyclic: bool = False) -> np.ndarray:
    """Second-difference penalty matrix of n spline weights."""
    if cyclic:
        eye = np.eye(n)
        d = np.roll(eye, 1, axis=1) - 2 * eye + np.roll(eye, -1, axis=1)
    else:
        d = np.diff(np.eye(n), n=2, axis=0)
    return d.T @ d
