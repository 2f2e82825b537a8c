"""Tail probabilities, vectorised over columns: Spark has none of them built in.

Each is an Arrow function over the few rows of an aggregated table; a null argument gives null. The incomplete
beta function uses its continued fraction, the incomplete gamma function its series or continued fraction.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

_lgamma = np.vectorize(math.lgamma, otypes=[float])
_erfc = np.vectorize(math.erfc, otypes=[float])
_TINY = 1e-300


def beta_inc(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The regularised incomplete beta function I_x(a, b)."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, float) for v in (a, b, x)))
    turn = x > (a + 1) / (a + b + 2)
    p, q, z = np.where(turn, b, a), np.where(turn, a, b), np.where(turn, 1 - x, x)
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(_lgamma(p + q) - _lgamma(p) - _lgamma(q) + p * np.log(z) + q * np.log1p(-z)) / p
    safe = lambda v: np.where(np.abs(v) < _TINY, _TINY, v)
    c, d = np.ones_like(z), 1 / safe(1 - (p + q) * z / (p + 1))
    h = d.copy()
    for m in range(1, 400):
        for up in (m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))):
            d, c = 1 / safe(1 + up * d), safe(1 + up / c)
            h = h * d * c
        if np.all(np.abs(d * c - 1) < 1e-15):
            break
    part = np.where(z <= 0, 0.0, front * h)
    return np.clip(np.where(turn, 1 - part, part), 0, 1)


def gamma_upper(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The regularised upper incomplete gamma function Q(a, x)."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float))
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.where(x > 0, np.exp(-x + a * np.log(x) - _lgamma(a)), 0.0)
    term = total = 1 / a
    for i in range(1, 2000):
        term = term * x / (a + i)
        total = total + term
        if np.all((np.abs(term) < np.abs(total) * 1e-16) | (x >= a + 1)):
            break
    b = x + 1 - a
    c, d = np.full_like(x, 1 / _TINY), 1 / np.where(b == 0, _TINY, b)
    h = d.copy()
    for i in range(1, 2000):
        n = -i * (i - a)
        b = b + 2
        d = n * d + b
        d = 1 / np.where(np.abs(d) < _TINY, _TINY, d)
        c = b + n / c
        c = np.where(np.abs(c) < _TINY, _TINY, c)
        h = h * d * c
        if np.all((np.abs(d * c - 1) < 1e-15) | (x < a + 1)):
            break
    return np.clip(np.where(x <= 0, 1.0, np.where(x < a + 1, 1 - front * total, front * h)), 0, 1)


def _rowwise(fn, *columns: pd.Series) -> pd.Series:
    """fn over the rows without a null, null elsewhere."""
    values = [c.to_numpy(float, na_value=np.nan) for c in columns]
    ok = np.all([np.isfinite(v) for v in values], axis=0)
    out = np.full(len(values[0]), np.nan)
    if ok.any():
        out[ok] = fn(*(v[ok] for v in values))
    return pd.Series(out).astype(object).where(pd.Series(np.isfinite(out)), None)


@F.pandas_udf(DoubleType())
def normal_p(z: pd.Series) -> pd.Series:
    """Two-sided p of a standard normal."""
    return _rowwise(lambda x: _erfc(np.abs(x) / math.sqrt(2)), z)


@F.pandas_udf(DoubleType())
def student_p(t: pd.Series, df: pd.Series) -> pd.Series:
    """Two-sided p of Student's t; null for df <= 0."""
    return _rowwise(lambda x, v: np.where(v > 0, beta_inc(np.maximum(v, 1e-9) / 2, 0.5, v / (v + x * x)), np.nan), t, df)


@F.pandas_udf(DoubleType())
def chi_square_p(x: pd.Series, df: pd.Series) -> pd.Series:
    """Upper tail of chi-square; null for df <= 0."""
    return _rowwise(lambda a, v: np.where(v > 0, gamma_upper(np.maximum(v, 1e-9) / 2, a / 2), np.nan), x, df)


@F.pandas_udf(DoubleType())
def f_p(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    """Upper tail of F; null where a df is not positive."""
    return _rowwise(lambda x, a, b: np.where((a > 0) & (b > 0), beta_inc(np.maximum(b, 1e-9) / 2, np.maximum(a, 1e-9) / 2, b / (b + a * np.maximum(x, 0))), np.nan), f, d1, d2)


def _bound(log_mass, best: float, low: int, high: int, rising: bool) -> int:
    """Between low and high, where log_mass only rises (falls), the last (first) outcome of at most this log mass; low - 1 (high + 1) without any."""
    if rising:
        a, b = low - 1, high
        while a < b:
            m = (a + b + 1) // 2
            a, b = (m, b) if log_mass(m) <= best else (a, m - 1)
        return a
    a, b = low, high + 1
    while a < b:
        m = (a + b) // 2
        a, b = (a, m) if log_mass(m) <= best else (m + 1, b)
    return a


#: How much likelier than the observed outcome one may seem and still count as equally likely.
_SLACK = math.log1p(1e-7)


def _binomial(k: float, n: float, p0: float) -> float:
    """Both tails by the incomplete beta function: outcomes are no likelier than k up to a bound on either side of the mode."""
    k, n = int(k), int(n)
    if n == 0:
        return 1.0
    if not 0 < p0 < 1:
        return 1.0 if k == (n if p0 >= 1 else 0) else 0.0
    log = lambda i: math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p0) + (n - i) * math.log1p(-p0)
    mode, best = min(n, int((n + 1) * p0)), log(k) + _SLACK
    low, high = _bound(log, best, 0, mode, True), _bound(log, best, mode, n, False)
    if low >= mode or high <= mode:
        return 1.0
    one = lambda a, b, x: float(beta_inc(np.array([float(a)]), np.array([float(b)]), np.array([x]))[0])
    below = one(n - low, low + 1, 1 - p0) if low >= 0 else 0.0
    above = one(high, n - high + 1, p0) if high <= n else 0.0
    return min(1.0, below + above)


@F.pandas_udf(DoubleType())
def binomial_p(k: pd.Series, n: pd.Series, p0: pd.Series) -> pd.Series:
    """Two-sided exact p of k successes in n: the outcomes that are no likelier. n = 0 gives 1."""
    return _rowwise(lambda a, b, c: np.array([_binomial(*x) for x in zip(a, b, c)]), k, n, p0)


def _outward(first: int, step: int, mass: float, total: int, marked: int, drawn: int, low: int, high: int) -> float:
    """The sum of hypergeometric masses from `first` on, away from the mode, a bounded number of terms at a time until they no longer count."""
    out, i, width = 0.0, first, 4096
    while mass > 0 and low <= i <= high:
        at = np.arange(i, max(low - 1, i - width) if step < 0 else min(high + 1, i + width), step, dtype=float)
        up = (marked - at) * (drawn - at) / ((at + 1) * (total - marked - drawn + at + 1))
        down = at * (total - marked - drawn + at) / ((marked - at + 1) * (drawn - at + 1))
        terms = mass * np.cumprod(np.concatenate([[1.0], (up if step > 0 else down)]))
        out += float(terms[:-1].sum())
        mass, i = float(terms[-1]), i + step * len(at)
        if mass < 1e-18 * out:
            break
    return out


def _fisher(a: float, b: float, c: float, d: float) -> tuple[float, float]:
    """(upper tail, both tails) summed outwards from the observed outcome and from its equal on the other side of the mode."""
    total, marked, drawn, k = int(a + b + c + d), int(a + b), int(a + c), int(a)
    low, high = max(0, drawn - (total - marked)), min(marked, drawn)
    comb = lambda n, i: math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1)
    log = lambda i: comb(marked, i) + comb(total - marked, drawn - i) - comb(total, drawn)
    mode = min(high, max(low, (marked + 1) * (drawn + 1) // (total + 2)))
    tail = lambda i, step: _outward(i, step, math.exp(log(i)) if low <= i <= high else 0.0, total, marked, drawn, low, high)
    greater = tail(k, 1) if k > mode else 1.0 - tail(k - 1, -1)
    best = log(k) + _SLACK
    left, right = _bound(log, best, low, mode, True), _bound(log, best, mode, high, False)
    both = 1.0 if left >= mode or right <= mode else tail(left, -1) + tail(right, 1)
    return min(1.0, max(0.0, greater)), min(1.0, both)


@F.pandas_udf(StructType([StructField("p_greater", DoubleType()), StructField("p_two_sided", DoubleType())]))
def fisher_p(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.DataFrame:
    """Fisher's exact test of the 2 x 2 table (a, b; c, d): the upper tail of a, and both sides."""
    rows = [_fisher(*map(float, x)) if not any(pd.isna(v) for v in x) else (None, None) for x in zip(a, b, c, d)]
    return pd.DataFrame(rows, columns=["p_greater", "p_two_sided"])


def signed_rank_ways(n: int) -> np.ndarray:
    """How many subsets of 1..n have each sum."""
    ways = np.zeros(n * (n + 1) // 2 + 1)
    ways[0] = 1
    for r in range(1, n + 1):
        ways[r:] += ways[:-r].copy()
    return ways


@F.pandas_udf(DoubleType())
def signed_rank_p(w: pd.Series, n: pd.Series) -> pd.Series:
    """Two-sided exact p of a signed-rank sum of n values without ties; null for n over 1,000 (use the normal z)."""

    def one(s: float, m: float) -> float:
        m = int(m)
        if m > 1_000:
            return float("nan")
        low = min(s, m * (m + 1) / 2 - s)
        return float(min(1.0, 2 * signed_rank_ways(m)[: int(low) + 1].sum() / 2.0**m))

    return _rowwise(lambda a, b: np.array([one(*x) for x in zip(a, b)]), w, n)
