"""Normal and Student tails over tables with one row per pair or per test."""
from __future__ import annotations

import math
from statistics import NormalDist

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


@F.pandas_udf(DoubleType())
def normal_two_sided(z: pd.Series) -> pd.Series:
    """Two-sided normal p of a z value; infinite z gives 0, missing stays missing."""
    return z.map(lambda v: None if v is None or math.isnan(v) else math.erfc(abs(v) / math.sqrt(2.0)))


@F.pandas_udf(DoubleType())
def normal_upper(p: pd.Series) -> pd.Series:
    """z with upper tail ``p``."""
    return p.map(lambda v: None if v is None or math.isnan(v) else -NormalDist().inv_cdf(v))


def _student_tail(t: float, df: float) -> float:
    """Upper tail of Student's t by the integral of its density, in the angle t = sqrt(df) tan(a)."""
    a = math.atan(t / math.sqrt(df))
    n = 400
    h = (math.pi / 2 - a) / n
    f = [math.cos(a + k * h) ** (df - 1) if k < n else (1.0 if df == 1 else 0.0) for k in range(n + 1)]
    area = h / 3 * (f[0] + f[n] + 4 * sum(f[1:n:2]) + 2 * sum(f[2:n:2]))
    const = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(math.pi)
    return const * area


def student_quantile(upper: float, df: float) -> float:
    lo, hi = 0.0, 1.0
    while _student_tail(hi, df) > upper:
        hi *= 2
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if _student_tail(mid, df) > upper else (lo, mid)
    return (lo + hi) / 2


@F.pandas_udf(DoubleType())
def student_upper(upper: pd.Series, df: pd.Series) -> pd.Series:
    """Student quantile with the given upper tail; few distinct arguments, so each is solved once."""
    known: dict[tuple[float, float], float | None] = {}
    for u, d in set(zip(upper, df)):
        known[(u, d)] = student_quantile(u, d) if d >= 1 else None
    return pd.Series([known[k] for k in zip(upper, df)])
