"""Statistical column expressions that stay defined for short, constant or null-laden input."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def finite(c: str, dtype: T.DataType) -> str:
    """NaN counts as missing."""
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return f"CASE WHEN NOT isnan({c}) THEN {c} END"
    return c


def approx_distinct(c: str, log_size: int = 14) -> str:
    """Distinct non-null values by a HyperLogLog sketch of fixed size (2^14 registers: about 0.8% error).

    The sketch is one binary buffer; the built-in approximate count spreads the same precision over thousands
    of buffer columns, which makes wide aggregates slow to plan and to run.
    """
    mark = f"CASE WHEN {c} IS NOT NULL THEN xxhash64({c}) END"
    return f"coalesce(hll_sketch_estimate(hll_sketch_agg({mark}, {log_size})), 0L)"


def sample_skewness(c: str) -> str:
    """Bias-corrected skewness; null below three values or without spread."""
    n = f"CAST(count({c}) AS DOUBLE)"
    return f"CASE WHEN {n} >= 3 THEN skewness({c}) * try_divide(sqrt({n} * ({n} - 1)), {n} - 2) END"


def number(x: float) -> str:
    """A double as SQL text, to the last bit."""
    return f"CAST('{x!r}' AS DOUBLE)"


def from_sums() -> Column:
    """Correlation from n, sx, sy, sxx, syy, sxy of values shifted by mx and my, their means; null without spread."""
    n = F.col("n")
    xx = F.col("sxx") - F.col("sx") * F.try_divide(F.col("sx"), n)
    yy = F.col("syy") - F.col("sy") * F.try_divide(F.col("sy"), n)
    xy = F.col("sxy") - F.col("sx") * F.try_divide(F.col("sy"), n)
    # a spread within the rounding error of the values themselves (near mx, my) counts as none
    def noise(mean: str) -> Column:
        return n * F.pow(F.abs(mean) * 1e-13, F.lit(2.0))

    flat = (xx <= noise("mx")) | (yy <= noise("my"))
    r = F.try_divide(xy, F.sqrt(xx) * F.sqrt(yy))
    return F.when(~flat, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)))


def t_statistic(r: Column, n: Column) -> Column:
    """t of a correlation r over n pairs; null when |r| = 1 or n < 3."""
    df = (n - 2).cast("double")
    return F.when(df > 0, r * F.sqrt(F.try_divide(df, 1 - r * r)))


def _beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray, steps: int = 300) -> np.ndarray:
    """Continued fraction of the incomplete beta function, evaluated by the modified Lentz method."""

    def away_from_zero(v: np.ndarray) -> np.ndarray:
        return np.where(np.abs(v) < 1e-300, 1e-300, v)

    c = np.ones_like(x)
    d = 1.0 / away_from_zero(1.0 - (a + b) * x / (a + 1.0))
    h = d.copy()
    for m in range(1, steps + 1):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for term in (even, odd):
            d = 1.0 / away_from_zero(1.0 + term * d)
            c = away_from_zero(1.0 + term / c)
            h = h * d * c
    return h


def _log_gamma_step(a: np.ndarray) -> np.ndarray:
    """log Gamma(a + 1/2) - log Gamma(a): raise a above 20, then use the Stirling series."""
    shift, z = np.zeros_like(a), a.copy()
    for _ in range(20):
        low = z < 20.0
        shift = shift + np.where(low, np.log(z) - np.log(z + 0.5), 0.0)
        z = np.where(low, z + 1.0, z)

    def series(v: np.ndarray) -> np.ndarray:
        return (v - 0.5) * np.log(v) - v + 1.0 / (12 * v) - 1.0 / (360 * v**3) + 1.0 / (1260 * v**5)

    return series(z + 0.5) - series(z) + shift


def two_sided_p(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """Two-sided p-value of Student's t through the incomplete beta function I_x(df/2, 1/2)."""
    a, half = df / 2.0, np.full_like(df, 0.5)
    x = np.clip(df / (df + t * t), 1e-300, 1.0 - 1e-16)
    front = np.exp(_log_gamma_step(a) - 0.5 * np.log(np.pi) + a * np.log(x) + 0.5 * np.log1p(-x))
    small_x = front * _beta_fraction(a, half, x) / a
    large_x = 1.0 - front * _beta_fraction(half, a, 1.0 - x) / half
    return np.clip(np.where(x < (a + 1.0) / (a + 2.5), small_x, large_x), 0.0, 1.0)


@F.pandas_udf(T.DoubleType())
def correlation_p_value(r: pd.Series, n: pd.Series) -> pd.Series:
    """p-value of a correlation; runs on the small table of column pairs, never on data rows."""
    rv, nv = r.to_numpy(float), n.to_numpy(float)
    ok = np.isfinite(rv) & (nv > 2)
    out = np.full(len(rv), np.nan)
    df = nv[ok] - 2.0
    rest = np.maximum(1.0 - rv[ok] ** 2, 1e-300)
    out[ok] = two_sided_p(np.abs(rv[ok]) * np.sqrt(df / rest), df)
    return pd.Series(out).where(pd.Series(ok), None)
