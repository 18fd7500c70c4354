"""Statistical column expressions that Spark does not ship in the needed form."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

# Rational approximation of the inverse normal distribution (P. J. Acklam).
_PPF_A = [-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.3577518672690, -30.66479806614716, 2.506628277459239]
_PPF_B = [-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572, 1.0]
_PPF_C = [-0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783]
_PPF_D = [0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416, 1.0]
_PPF_LOW = 0.02425

# Normal tail polynomial (Abramowitz and Stegun, formula 26.2.17).
_TAIL = [1.330274429, -1.821255978, 1.781477937, -0.356563782, 0.319381530, 0.0]
_TAIL_SCALE = 0.2316419


def polynomial(x: Column, coefficients: Sequence[float]) -> Column:
    """Horner evaluation, highest power first."""
    result = F.lit(float(coefficients[0]))
    for c in coefficients[1:]:
        result = result * x + F.lit(float(c))
    return result


def normal_ppf(p: Column) -> Column:
    """Inverse of the standard normal distribution function (relative error about 1e-9)."""
    low = F.sqrt(-2 * F.log(p))
    high = F.sqrt(-2 * F.log(1 - p))
    centre = p - 0.5
    square = centre * centre
    return (
        F.when(p < _PPF_LOW, polynomial(low, _PPF_C) / polynomial(low, _PPF_D))
        .when(p > 1 - _PPF_LOW, -polynomial(high, _PPF_C) / polynomial(high, _PPF_D))
        .otherwise(polynomial(square, _PPF_A) * centre / polynomial(square, _PPF_B))
    )


def normal_upper_tail(z: Column) -> Column:
    """P(Z > z) for a standard normal Z (absolute error below 1e-7)."""
    t = 1 / (1 + F.lit(_TAIL_SCALE) * F.abs(z))
    tail = polynomial(t, _TAIL) * F.exp(-z * z / 2) / F.lit(2.5066282746310002)
    return F.when(z >= 0, tail).otherwise(1 - tail)


def sample_skewness(x: Column) -> Column:
    """Bias-corrected skewness G1; NULL below three values, 0 for a constant column."""
    n = F.count(x).cast("double")
    corrected = F.skewness(x) * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0))
    return F.when(n >= 3, F.when(F.var_pop(x) == 0, F.lit(0.0)).otherwise(corrected))


def sample_kurtosis(x: Column) -> Column:
    """Bias-corrected excess kurtosis G2; NULL below four values, 0 for a constant column."""
    n = F.count(x).cast("double")
    inner = (n + 1) * F.kurtosis(x) + 6
    corrected = (n - 1) * inner / F.nullif((n - 2) * (n - 3), F.lit(0.0))
    return F.when(n >= 4, F.when(F.var_pop(x) == 0, F.lit(0.0)).otherwise(corrected))


def safe_divide(a: Column, b: Column) -> Column:
    """a / b as double, NULL when b is zero."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def micros(ts: Column) -> Column:
    """Microseconds since the epoch of a date or timestamp column."""
    return F.unix_micros(ts.cast("timestamp"))


MICROS_PER_DAY = 86_400_000_000


def whole_days(micros_gap: Column) -> Column:
    """Length of a gap in whole 24-hour days, rounded down."""
    return F.floor(micros_gap / F.lit(MICROS_PER_DAY)).cast("long")
