"""Shrinkage, order statistics and robust weights as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from blockfit.functions.arrays import _col, let


def _shrink(a: Column, k: Column) -> Column:
    return F.greatest(a - k, F.lit(0.0)) - F.greatest(-(a + k), F.lit(0.0))


def soft_threshold(a: Column | str, k: float | Column) -> Column:
    """Soft threshold of a number by ``k``."""
    return _shrink(_col(a), F.lit(k))


def soft_threshold_each(a: Column | str, k: Column | str | float) -> Column:
    """Soft threshold of a vector: by one number, or by a threshold per coordinate."""
    if isinstance(k, (int, float)):
        return F.transform(_col(a), lambda v: _shrink(v, F.lit(float(k))))
    return F.zip_with(_col(a), _col(k), _shrink)


def shrink_pair(lo: Column | str, hi: Column | str) -> Column:
    """``lo`` where it is positive, else ``hi`` where it is negative, else 0."""
    lo, hi = _col(lo), _col(hi)
    return F.when(lo > 0, lo).when(hi < 0, hi).otherwise(F.lit(0.0))


def order_stat(values: Column | str, t: float) -> Column:
    """The ascending sorted element at 0-based index ``int(size * t)``."""
    v = _col(values)
    return F.sort_array(v)[F.floor(F.size(v) * F.lit(t)).cast("int")]


def residual_weights(squared: Column | str, t: float = 0.7, c: float = 1.0) -> Column:
    """Logistic weight of every squared residual around the order statistic at ``t``.

    The denominator form cannot overflow; where the order statistic is 0 the weight
    is 1 for residuals not above it and 0 for the others.
    """
    r = _col(squared)

    def weights(at: Column) -> Column:
        return F.transform(
            r,
            lambda v: F.when(at == 0, F.when(v <= at, 1.0).otherwise(0.0)).otherwise(
                1.0 / (1.0 + F.exp(F.lit(c) / at * (v - at)))
            ),
        )

    return let(order_stat(r, t), weights)


def residual_mae(residuals: Column | str, exact: bool = False) -> Column:
    """Sum of absolute residuals over the full length; without the last entry unless ``exact``."""
    r = _col(residuals)
    used = r if exact else F.slice(r, F.lit(1), F.size(r) - 1)
    return F.aggregate(used, F.lit(0.0), lambda acc, v: acc + F.abs(v)) / F.size(r)


def median_avg(values: Column | str) -> Column:
    """Median of an array; the mean of the two middle entries for an even size."""

    def middle(s: Column) -> Column:
        n = F.size(s)
        return (s[F.floor((n - 1) / 2).cast("int")] + s[F.floor(n / 2).cast("int")]) / 2.0

    return let(F.sort_array(_col(values)), middle)
