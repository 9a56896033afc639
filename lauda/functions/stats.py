"""Exact binomial intervals over aggregated rows."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _tail(k: int, n: int, p: float) -> float:
    """P(X >= k) of a binomial."""
    if k <= 0:
        return 1.0
    if p <= 0:
        return 0.0
    if p >= 1:
        return 1.0
    lp, lq, c = math.log(p), math.log1p(-p), math.lgamma(n + 1)
    return min(1.0,
        math.fsum(math.exp(c - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * lp + (n - i) * lq) for i in range(k, n + 1)))


def _solve(f, target: float) -> float:
    lo, hi = 0.0, 1.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f(mid) < target else (lo, mid)
    return (lo + hi) / 2


def exact_interval(k: int, n: int, level: float = 0.95) -> tuple[float | None, float | None]:
    """Clopper-Pearson interval in percent with one decimal; none for n = 0."""
    if not n:
        return None, None
    a = (1 - level) / 2
    low = 0.0 if k == 0 else _solve(lambda p: _tail(k, n, p), a)
    high = 1.0 if k == n else _solve(lambda p: _tail(k + 1, n, p), 1 - a)
    return round(100 * low, 1), round(100 * high, 1)


def interval_column(k: str, n: str) -> Column:
    """The interval of each aggregated row: struct(low, high)."""

    def rows(k: pd.Series, n: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([exact_interval(int(a), int(b)) for a, b in zip(k, n)], columns=["low", "high"], dtype="float64")

    out = T.StructType([T.StructField("low", T.DoubleType()), T.StructField("high", T.DoubleType())])
    return F.pandas_udf(rows, out)(k, n)
