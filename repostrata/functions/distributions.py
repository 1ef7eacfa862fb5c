"""Tail probabilities as Arrow UDFs over a few rows; normal scores as column expressions."""

from __future__ import annotations

import math
import sys
from statistics import NormalDist

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, functions as F, types as T

_NORMAL = NormalDist()


def _doubles(*names: str) -> T.StructType:
    return T.StructType([T.StructField(name, T.DoubleType()) for name in names])


# Polynomial coefficients of Royston's approximation (1992, 1995), from the
# constant term up.
ROYSTON_LARGEST = (0.0, 0.221157, -0.147981, -2.07119, 4.434685, -2.706056)
ROYSTON_SECOND = (0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633)
ROYSTON_SMALL_MEAN = (0.5440, -0.39978, 0.025054, -0.0006714)
ROYSTON_SMALL_SD = (1.3822, -0.77857, 0.062767, -0.0020322)
ROYSTON_MEAN = (-1.5861, -0.31082, -0.083751, 0.0038915)
ROYSTON_SD = (-0.4803, -0.082676, 0.0030302)
ROYSTON_GAMMA = (-2.273, 0.459)


# Coefficients of Acklam's rational approximation (2003) of the inverse normal
# distribution, from the highest power down; its relative error is below 1.2e-9.
ACKLAM_MIDDLE = (
    (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00),
    (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0),
)
ACKLAM_TAIL = (
    (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00),
    (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0),
)
ACKLAM_BREAK = 0.02425


def _horner(coefficients, x: Column) -> Column:
    total = F.lit(coefficients[0])
    for c in coefficients[1:]:
        total = total * x + c
    return total


def inverse_normal(p: Column) -> Column:
    """Quantile of the standard normal distribution as a column expression."""
    q = p - 0.5
    middle = q * _horner(ACKLAM_MIDDLE[0], q * q) / _horner(ACKLAM_MIDDLE[1], q * q)
    tail = F.sqrt(-2 * F.ln(F.least(p, 1 - p)))
    outer = _horner(ACKLAM_TAIL[0], tail) / _horner(ACKLAM_TAIL[1], tail)
    return F.when(p < ACKLAM_BREAK, outer).when(p > 1 - ACKLAM_BREAK, -outer).otherwise(middle)


def polynomial(coefficients, x: float) -> float:
    return sum(c * x**power for power, c in enumerate(coefficients))


def normal_score(position: float, n: float) -> float:
    """Expected normal order statistic of a 1-based position among n (Blom)."""
    return _NORMAL.inv_cdf((position - 0.375) / (n + 0.25))


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0.0 or x >= 1.0:
        return 0.0 if x <= 0.0 else 1.0
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - incomplete_beta(b, a, 1.0 - x)
    log_front = (
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
        + a * math.log(x) + b * math.log1p(-x) - math.log(a)
    )
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    value = d
    for m in range(1, 10_000_000):
        for numerator in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + numerator * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + numerator / c
            c = c if abs(c) > tiny else tiny
            step = c * d
            value *= step
        if abs(step - 1.0) < 1e-15:
            return math.exp(log_front) * value
    raise ArithmeticError(f"the incomplete beta function did not converge at {a}, {b}, {x}")


def correlation_p(r: float | None, n: float | None) -> float | None:
    """Two-sided p-value of a correlation of n pairs."""
    if r is None or n is None or math.isnan(r) or n < 3:
        return None
    if abs(r) >= 1.0:
        return 0.0
    freedom = n - 2
    t_squared = r * r * freedom / (1.0 - r * r)
    return incomplete_beta(freedom / 2.0, 0.5, freedom / (freedom + t_squared))


def shapiro_weights(n: int, sum_squares: float) -> tuple[float, float, float]:
    """Weights of the largest and second-largest value, and the divisor of all other
    normal scores. ``sum_squares`` is the sum of squared scores of positions 1..n."""
    if n == 3:
        return math.sqrt(0.5), 0.0, 1.0
    top, second = normal_score(n, n), normal_score(n - 1, n)
    root, u = math.sqrt(sum_squares), 1.0 / math.sqrt(n)
    a_top = top / root + polynomial(ROYSTON_LARGEST, u)
    if n <= 5:
        scale = (sum_squares - 2 * top**2) / (1 - 2 * a_top**2)
        return a_top, second / math.sqrt(scale), math.sqrt(scale)
    a_second = second / root + polynomial(ROYSTON_SECOND, u)
    scale = (sum_squares - 2 * top**2 - 2 * second**2) / (1 - 2 * a_top**2 - 2 * a_second**2)
    return a_top, a_second, math.sqrt(scale)


def shapiro_p(w: float, n: int) -> float:
    """P-value of a Shapiro-Wilk statistic."""
    if n == 3:
        p = 6.0 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75)))
        return min(max(p, 0.0), 1.0)
    if w >= 1.0:
        return 1.0
    y = math.log(1.0 - w)
    if n <= 11:
        gamma = polynomial(ROYSTON_GAMMA, n)
        if y >= gamma:
            return 0.0
        y = -math.log(gamma - y)
        mean = polynomial(ROYSTON_SMALL_MEAN, n)
        sd = math.exp(polynomial(ROYSTON_SMALL_SD, n))
    else:
        mean = polynomial(ROYSTON_MEAN, math.log(n))
        sd = math.exp(polynomial(ROYSTON_SD, math.log(n)))
    return 0.5 * math.erfc((y - mean) / sd / math.sqrt(2.0))


@F.pandas_udf(T.DoubleType())
def correlation_p_value(r: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([correlation_p(*pair) for pair in zip(r, n)], dtype="float64")


@F.pandas_udf(_doubles("statistic", "p_value"))
def shapiro_result(
    n: pd.Series, squares: pd.Series, weighted: pd.Series, spread: pd.Series,
    outer_gap: pd.Series, second_gap: pd.Series,
) -> pd.DataFrame:
    """Finish the statistic from sums: ``weighted`` is the score-weighted sum of all
    values, the gaps are largest minus smallest and second-largest minus second-smallest."""
    rows = []
    for size, sq, total, ss, gap1, gap2 in zip(n, squares, weighted, spread, outer_gap, second_gap):
        if pd.isna(size) or size < 3 or not ss > 0:
            rows.append((None, None))
            continue
        a1, a2, divisor = shapiro_weights(int(size), sq)
        middle = total - normal_score(size, size) * gap1 - normal_score(size - 1, size) * gap2
        w = min((a1 * gap1 + a2 * gap2 + middle / divisor) ** 2 / ss, 1.0)
        rows.append((w, shapiro_p(w, int(size))))
    return pd.DataFrame(rows, columns=["statistic", "p_value"], dtype="float64")


# Workers need no copy of the package: the functions above travel with the UDF.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
