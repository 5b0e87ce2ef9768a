"""Design rows built inside the tasks that sum them.

A fit ships its raw columns, some fifteen numbers a row, and not the design row of a hundred or more: these functions
build the same columns as the expressions of `basis`, from arrays, on the batch that is being summed. Missing numbers
are NaN and make the row's columns NaN.
"""

from __future__ import annotations

import numpy as np


def _weights(f: np.ndarray) -> list[np.ndarray]:
    """The four cubic B-splines that overlap a unit cell, at place f in it."""
    g = 1.0 - f
    return [g**3 / 6.0, ((f * 3.0 - 6.0) * f * f + 4.0) / 6.0, (((f * -3.0 + 3.0) * f + 3.0) * f + 1.0) / 6.0, f**3 / 6.0]


def _slopes(f: np.ndarray) -> list[np.ndarray]:
    g = 1.0 - f
    return [g * g / -2.0, (f * 9.0 - 12.0) * f / 6.0, ((f * -9.0 + 6.0) * f + 3.0) / 6.0, f * f / 2.0]


def _placed(four: list[np.ndarray], first: np.ndarray, n: int, missing: np.ndarray) -> np.ndarray:
    """Rows of n numbers, zero but for four that begin at `first` and wrap at the end."""
    out = np.zeros((len(first), n))
    at = np.arange(len(first))
    start = np.where(missing, 0, first).astype("i8")
    for k, w in enumerate(four):
        out[at, (start + k) % n] += w
    out[missing] = np.nan
    return out


def spline(x: np.ndarray, lo: np.ndarray | float, hi: np.ndarray | float, n: int) -> np.ndarray:
    """n cubic B-splines on even knots over [lo, hi]; straight-line continuation outside."""
    lo, hi = np.broadcast_to(lo, x.shape), np.broadcast_to(hi, x.shape)
    u = (x - lo) / np.where(hi > lo, (hi - lo) / (n - 3), 1.0)
    inside = np.clip(u, 0.0, n - 3.0)
    cell = np.minimum(np.floor(inside), n - 4.0)
    f, beyond = inside - cell, u - inside
    return _placed([w + s * beyond for w, s in zip(_weights(f), _slopes(f))], cell, n, np.isnan(u))


def cyclic(x: np.ndarray, lo: float, hi: float, n: int) -> np.ndarray:
    """n cubic B-splines that wrap from hi back to lo."""
    u = ((x - lo) / ((hi - lo) / n)) % n
    cell = np.floor(u)
    return _placed(_weights(u - cell), (cell - 3) % n, n, np.isnan(u))


def one_hot(code: np.ndarray, n: int) -> np.ndarray:
    """n indicators, all zero for a code outside 0..n-1 or a missing one."""
    return (code[:, None] == np.arange(n)).astype(float)


def fourier(days: np.ndarray, period: float, order: int) -> np.ndarray:
    """sin and cos of the first `order` harmonics of a period in days."""
    angle = days[:, None] * (2 * np.pi / period) * np.arange(1, order + 1)
    return np.stack([np.sin(angle), np.cos(angle)], axis=2).reshape(len(days), -1)


def hinges(t: np.ndarray, count: int, span: float = 0.8) -> np.ndarray:
    """Slope changes at even points over the first `span` of the history (t runs from 0 to 1)."""
    return np.maximum(t[:, None] - span * np.arange(1, count + 1) / (count + 1), 0.0)


def complete(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rows without a missing number, each with weight 1: what `gram` takes from a preparation."""
    whole = ~np.isnan(x).any(axis=1)
    return x[whole], y[whole], np.ones(int(whole.sum()))
