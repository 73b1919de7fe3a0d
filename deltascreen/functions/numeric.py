"""Numeric Column functions that Spark does not ship."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Coefficients of the published Chebyshev fit of erfc (relative error 1.2e-7).
ERFC_COEFFICIENTS = [
    -1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806,
    0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277,
]


def erfc_nonneg(z: Column) -> Column:
    """erfc for z >= 0."""
    t = 1.0 / (1.0 + 0.5 * z)
    poly = reduce(lambda acc, c: F.lit(c) + t * acc, reversed(ERFC_COEFFICIENTS[:-1]),
                  F.lit(ERFC_COEFFICIENTS[-1]))
    return t * F.exp(-z * z + poly)


def two_sided_normal_p(z: Column) -> Column:
    return F.least(F.lit(1.0), erfc_nonneg(F.abs(z) / F.sqrt(F.lit(2.0))))


def squared_error(pred: Column, target: Column) -> Column:
    return (pred - target) * (pred - target)


def absolute_error(pred: Column, target: Column) -> Column:
    return F.abs(pred - target)


def sign_agreement(pred: Column, target: Column) -> Column:
    return (F.signum(pred) == F.signum(target)).cast("double")


def effect_mask(target: Column, threshold: float = 0.5) -> Column:
    return F.abs(target) > threshold


def depth_normalise(cnt: Column, depth: Column, target_sum: float = 1e4) -> Column:
    return cnt * F.lit(target_sum) / depth


def clip(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))
