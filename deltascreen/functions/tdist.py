"""Two-sided Student t p-values as a vectorised pandas UDF (regularised incomplete beta)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling series after shifting the argument above 10."""
    shift = np.zeros_like(x)
    y = x.copy()
    for _ in range(10):
        low = y < 10.0
        shift = np.where(low, shift + np.log(y), shift)
        y = np.where(low, y + 1.0, y)
    inv = 1.0 / y
    tail = inv / 12.0 - inv**3 / 360.0 + inv**5 / 1260.0 - inv**7 / 1680.0
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2.0 * np.pi) + tail - shift


def _beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray, steps: int = 400) -> np.ndarray:
    """Continued fraction of the incomplete beta, evaluated from the last term backwards."""
    value = np.ones_like(x)
    for i in range(steps, 0, -1):
        m = i // 2
        if i % 2:
            coef = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        else:
            coef = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        value = 1.0 + coef / value
    return 1.0 / value


def incomplete_beta(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    x = np.clip(x, 0.0, 1.0)
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        front = np.exp(
            _log_gamma(a + b) - _log_gamma(a) - _log_gamma(b) + a * np.log(x) + b * np.log1p(-x)
        )
        direct = x < (a + 1.0) / (a + b + 2.0)
        low = front * _beta_fraction(a, b, np.where(direct, x, 0.5)) / a
        high = 1.0 - front * _beta_fraction(b, a, np.where(direct, 0.5, 1.0 - x)) / b
    out = np.where(direct, low, high)
    return np.where(x <= 0.0, 0.0, np.where(x >= 1.0, 1.0, out))


@F.pandas_udf(DoubleType())
def t_two_sided_p(t: pd.Series, df: pd.Series) -> pd.Series:
    tv = t.to_numpy(dtype=float)
    dv = df.to_numpy(dtype=float)
    x = dv / (dv + tv * tv)
    p = incomplete_beta(dv / 2.0, np.full_like(dv, 0.5), x)
    return pd.Series(np.where(tv == 0.0, 1.0, p))
