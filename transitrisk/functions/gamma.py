"""Gamma distribution numerics.

scipy is not available, so the regularised incomplete gamma function,
digamma/trigamma and the maximum-likelihood shape solver are written
here in numpy. They only ever run on per-distribution rows (one row
per cluster, or one row per grid point of one cluster), never on the
edges or observations themselves.
"""

from __future__ import annotations

import math

import numpy as np

_TINY = 1e-300
_EPS = 1e-16


def _series_p(a: float, x: np.ndarray, lg: float) -> np.ndarray:
    term = np.full_like(x, 1.0 / a)
    total = term.copy()
    ap = a
    for _ in range(10000):
        ap += 1.0
        term = term * x / ap
        total = total + term
        if np.all(np.abs(term) <= np.abs(total) * _EPS):
            break
    return total * np.exp(-x + a * np.log(x) - lg)


def _cfrac_q(a: float, x: np.ndarray, lg: float) -> np.ndarray:
    b = x + 1.0 - a
    c = np.full_like(x, 1.0 / _TINY)
    d = 1.0 / b
    h = d.copy()
    for i in range(1, 10000):
        an = -i * (i - a)
        b = b + 2.0
        d = an * d + b
        d = np.where(np.abs(d) < _TINY, _TINY, d)
        c = b + an / c
        c = np.where(np.abs(c) < _TINY, _TINY, c)
        d = 1.0 / d
        delta = d * c
        h = h * delta
        # a factor next to 1 may keep alternating in its last bit
        if np.all(np.abs(delta - 1.0) <= 2 * np.finfo(float).eps):
            break
    return np.exp(-x + a * np.log(x) - lg) * h


def reg_lower_gamma(a: float, x) -> np.ndarray:
    """P(a, x) for scalar shape ``a`` > 0 and an array of ``x``."""
    x = np.asarray(x, dtype=float)
    out = np.zeros_like(x)
    pos = x > 0
    if not pos.any():
        return out
    xs = x[pos]
    lg = math.lgamma(a)
    res = np.empty_like(xs)
    small = xs < a + 1.0
    if small.any():
        res[small] = _series_p(a, xs[small], lg)
    if (~small).any():
        res[~small] = 1.0 - _cfrac_q(a, xs[~small], lg)
    out[pos] = np.clip(res, 0.0, 1.0)
    return out


def gamma_cdf(x, shape: float, loc: float, scale: float) -> np.ndarray:
    """CDF of gamma(shape, loc, scale); shape 1 uses the closed form 1 - e^-z."""
    z = (np.asarray(x, dtype=float) - loc) / scale
    if shape == 1.0:
        return np.where(z > 0, 1.0 - np.exp(-np.maximum(z, 0.0)), 0.0)
    return reg_lower_gamma(shape, z)


def gamma_pdf(x, shape: float, loc: float, scale: float) -> np.ndarray:
    z = (np.asarray(x, dtype=float) - loc) / scale
    out = np.zeros_like(z)
    pos = z > 0
    out[pos] = np.exp((shape - 1.0) * np.log(z[pos]) - z[pos] - math.lgamma(shape)) / scale
    return out


def digamma(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, dtype=float).copy()
    acc = np.zeros_like(x)
    while True:
        low = x < 6.0
        if not low.any():
            break
        acc = acc - np.where(low, 1.0 / x, 0.0)
        x = np.where(low, x + 1.0, x)
    inv = 1.0 / x
    inv2 = inv * inv
    series = (np.log(x) - 0.5 * inv
              - inv2 * (1.0 / 12 - inv2 * (1.0 / 120 - inv2 * (1.0 / 252 - inv2 * (1.0 / 240 - inv2 / 132)))))
    return acc + series


def trigamma(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, dtype=float).copy()
    acc = np.zeros_like(x)
    while True:
        low = x < 6.0
        if not low.any():
            break
        acc = acc + np.where(low, 1.0 / (x * x), 0.0)
        x = np.where(low, x + 1.0, x)
    inv = 1.0 / x
    inv2 = inv * inv
    series = inv + 0.5 * inv2 + inv * inv2 * (1.0 / 6 - inv2 * (1.0 / 30 - inv2 * (1.0 / 42 - inv2 / 30)))
    return acc + series


def solve_shape(s) -> np.ndarray:
    """Solve ln(a) - digamma(a) = s for a (s > 0), Newton as in Minka (2002)."""
    s = np.asarray(s, dtype=float)
    a = (3.0 - s + np.sqrt((s - 3.0) ** 2 + 24.0 * s)) / (12.0 * s)
    for _ in range(100):
        num = np.log(a) - digamma(a) - s
        den = a * a * (1.0 / a - trigamma(a))
        new_inv = 1.0 / a + num / den
        a_new = 1.0 / new_inv
        a_new = np.where(np.isfinite(a_new) & (a_new > 0), a_new, a * 0.5)
        done = np.all(np.abs(a_new - a) <= 1e-14 * a)
        a = a_new
        if done:
            break
    return a


def cdf_grid(shape: float | None, loc: float, scale: float | None,
             max_slack: int) -> tuple[int, list[float]]:
    """CDF at every integer second from ``lo`` until it is exactly 1.0 in
    float64 (or ``max_slack``). Below ``lo`` the CDF is 0, above the grid it
    keeps the last value.

    ``shape is None`` means a point mass at ``loc``.
    """
    if shape is None or scale is None or not (scale > 0) or not (shape > 0):
        at = int(math.ceil(loc))
        return at - 1, [0.0, 1.0]
    lo = int(math.floor(loc))
    values: list[float] = []
    start = lo
    chunk = 4096
    while True:
        xs = np.arange(start, start + chunk, dtype=float)
        ys = gamma_cdf(xs, shape, loc, scale)
        ones = np.nonzero(ys >= 1.0)[0]
        if ones.size:
            values.extend(ys[: ones[0] + 1].tolist())
            break
        values.extend(ys.tolist())
        start += chunk
        if start > max_slack:
            break
    return lo, values
