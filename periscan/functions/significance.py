"""p-values of correlations."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def beta_share(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_share(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    value = 0.0
    for j in range(400, 0, -1):  # from the innermost fraction outwards
        m = j // 2
        if j % 2:
            d = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        else:
            d = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        value = d / (1 + value)
    return front / (1 + value)


@F.pandas_udf(DoubleType())
def correlation_p(r: pd.Series, n: pd.Series) -> pd.Series:
    """Two-sided p-value of correlations ``r`` of ``n`` rows by Student's t; null below three rows or without a correlation."""
    out = []
    for x, k in zip(r, n, strict=True):
        if x is None or pd.isna(x) or pd.isna(k) or k < 3:
            out.append(None)
        else:
            out.append(0.0 if abs(x) >= 1 else beta_share((k - 2) / 2, 0.5, 1 - x * x))
    return pd.Series(out, dtype="float64")
