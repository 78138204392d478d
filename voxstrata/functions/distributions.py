"""Tail probabilities for the few rows that a test leaves, from math's gamma and error functions."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Exact rank-sum tails are used up to so many values in the larger group.
EXACT_MOST = 10_000


def _beta_fraction(a: float, b: float, x: float) -> float:
    """The continued fraction of the incomplete beta function, by Lentz's method."""
    tiny, c, d = 1e-300, 1.0, 1 / max(1 - (a + b) * x / (a + 1), 1e-300)
    out = d
    for m in range(1, 400):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + top * d or tiny)
            c = 1 + top / c or tiny
            out *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return out


def beta_share(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function."""
    if not 0 < x < 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def t_two_sided(t: float, df: float) -> float:
    """P(|T| > |t|) under Student's distribution."""
    return beta_share(df / 2, 0.5, df / (df + t * t)) if math.isfinite(t) and df > 0 else math.nan


def t_quantile(p: float, df: float) -> float:
    """The value that T stays below with probability p > 0.5; 1 where df isn't positive."""
    if not df > 0:
        return 1.0
    low, high = 0.0, 1.0
    while t_two_sided(high, df) > 2 * (1 - p):
        low, high = high, 2 * high
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if t_two_sided(mid, df) > 2 * (1 - p) else (low, mid)
    return high


def f_upper(f: float, df1: float, df2: float) -> float:
    """P(F > f)."""
    return beta_share(df2 / 2, df1 / 2, df2 / (df2 + df1 * f)) if f >= 0 and df1 > 0 and df2 > 0 else math.nan


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def chi_upper(x: float, df: float) -> float:
    """P(X > x) under the chi-squared distribution: by steps of two degrees from 1 or 2."""
    if not x >= 0 or not df >= 1:
        return math.nan
    h, odd = x / 2, int(df) % 2
    out = math.erfc(math.sqrt(h)) if odd else math.exp(-h)
    for k in range(1, (int(df) - odd) // 2 + odd):
        a = k - 0.5 * odd
        out += math.exp(a * math.log(h) - h - math.lgamma(a + 1)) if h > 0 else 0.0
    return min(out, 1.0)


def rank_sum_exact(u: float, n_a: int, n_b: int) -> float:
    """Two-sided tail of U without ties, from the number of arrangements that give each value."""
    few, many = sorted((int(n_a), int(n_b)))
    ways = np.zeros(few * many + 1)
    ways[0] = 1.0
    for i in range(1, few + 1):  # times (1 - q^(many + i)) over (1 - q^i)
        ways[many + i :] -= ways[: max(0, len(ways) - many - i)].copy()
        for j in range(i):
            ways[j::i] = ways[j::i].cumsum()
    top = max(u, n_a * n_b - u)
    return float(min(1.0, 2 * ways[math.ceil(top) :].sum() / ways.sum()))


def rank_sum_two_sided(u: float, n_a: float, n_b: float, ties: float) -> float:
    """Exact where a group has at most 8 values and none are tied; else normal with continuity and tie corrections."""
    if min(n_a, n_b) <= 8 and ties == 0 and max(n_a, n_b) <= EXACT_MOST:
        return rank_sum_exact(u, int(n_a), int(n_b))
    return rank_sum_normal(u, n_a, n_b, ties)


def rank_sum_normal(u: float, n_a: float, n_b: float, ties: float) -> float:
    n = n_a + n_b
    variance = n_a * n_b / 12 * (n + 1 - ties / (n * (n - 1)))
    return normal_two_sided(max(abs(u - n_a * n_b / 2) - 0.5, 0) / math.sqrt(variance)) if variance > 0 else math.nan


def applied(f: Callable[..., float], *columns: Column | str) -> Column:
    """f of each row, for tables of results; null where an argument is."""

    def run(*parts: pd.Series) -> pd.Series:
        made = [None if any(v is None or pd.isna(v) for v in row) else f(*map(float, row)) for row in zip(*parts)]
        return pd.Series([None if v is None or math.isnan(v) else v for v in made], dtype="float64")

    run.__annotations__ = {"parts": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "double")(*columns)
