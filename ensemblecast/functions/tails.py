"""Tails of distributions as columns, so that any number of tests is judged in one pass and none on the driver."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Terms of series and continued fractions; enough for double precision up to MOST_FREEDOM degrees of freedom.
DEPTH, MOST_FREEDOM = 200, 2000
#: Differences up to which the exact distribution of a signed-rank sum is used.
EXACT = 50


def _down(most: int) -> Column:
    return F.sequence(F.lit(most), F.lit(1), F.lit(-1))


def log_gamma(x: Column) -> Column:
    """Stirling's series, ten steps further up where it is exact to the last digits."""
    far = x + 10
    square = 1 / (far * far)
    series = (1 / 12.0 - square * (1 / 360.0 - square * (1 / 1260.0 - square / 1680.0))) / far
    steps = F.aggregate(F.sequence(F.lit(0), F.lit(9)), F.lit(0.0), lambda total, k: total + F.log(x + k))
    return (far - 0.5) * F.log(far) - far + 0.5 * math.log(2 * math.pi) + series - steps


def gamma_tail(a: Column, x: Column) -> Column:
    """Upper tail of the gamma distribution with shape ``a``: a series near its start, a continued fraction beyond."""
    front = F.exp(a * F.log(x) - x - log_gamma(a))
    below = F.aggregate(_down(DEPTH), F.lit(1.0), lambda rest, k: 1 + x / (a + k) * rest) / a
    above = F.aggregate(_down(DEPTH), x + 1 - a + 2 * DEPTH + 2, lambda rest, k: x + 2 * k - 1 - a - k * (k - a) / rest)
    return F.when(x <= 0, 1.0).when(x < a + 1, F.greatest(F.lit(0.0), 1 - front * below)).otherwise(front / above)


def chi2(x: Column, freedom: Column) -> Column:
    """Upper tail of chi squared."""
    return gamma_tail(freedom / 2.0, x / 2.0)


def normal(z: Column) -> Column:
    """Both tails of the normal distribution."""
    return gamma_tail(F.lit(0.5), z * z / 2.0)


def _beta_fraction(a: Column, b: Column, x: Column) -> Column:
    """Incomplete beta by its continued fraction, evaluated from the far end."""
    even = lambda k: k * (b - k) * x / ((a + 2 * k - 1) * (a + 2 * k))
    odd = lambda k: -(a + k) * (a + b + k) * x / ((a + 2 * k) * (a + 2 * k + 1))
    rest = F.aggregate(_down(DEPTH), F.lit(1.0), lambda rest, k: 1 + even(k) / (1 + odd(k) / rest))
    front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.log(x) + b * F.log1p(-x))
    return front / (a * (1 - (a + b) * x / (a + 1) / rest))


def student(t: Column, freedom: Column) -> Column:
    """Both tails of Student's t; beyond MOST_FREEDOM those of the normal deviate that it comes to."""
    x, a, b = freedom / (freedom + t * t), freedom / 2.0, F.lit(0.5)
    inside = F.when(x < (a + 1) / (a + b + 2), _beta_fraction(a, b, x)).otherwise(1 - _beta_fraction(b, a, 1 - x))
    near = t * (1 - 1 / (4.0 * freedom)) / F.sqrt(1 + t * t / (2.0 * freedom))
    return F.when(t == 0, 1.0).when(freedom > MOST_FREEDOM, normal(near)).otherwise(inside)


def signed_rank(n: Column, w: Column, ties: Column) -> Column:
    """Two-sided p of a signed-rank sum ``w`` of ``n`` differences; ``ties`` is the sum of t**3 - t over equal sizes.

    Without ties and up to EXACT differences, it counts the sign patterns: their sums are built up one rank at a time in an
    array. Otherwise the normal tail, with the variance that ties leave.
    """
    few = F.least(n, F.lit(EXACT)).cast("int")
    shifted = lambda ways, r: F.concat(F.array_repeat(F.lit(0.0), r), ways)
    longer = lambda ways, r: F.concat(ways, F.array_repeat(F.lit(0.0), r))
    ways = F.aggregate(F.sequence(F.lit(1), few), F.array(F.lit(1.0)), lambda ways, r: F.zip_with(longer(ways, r), shifted(ways, r), lambda x, y: x + y))
    tail = F.aggregate(F.slice(ways, F.lit(1), F.floor(w).cast("int") + 1), F.lit(0.0), lambda total, v: total + v)
    exact = F.least(F.lit(1.0), 2 * tail / F.pow(F.lit(2.0), few))
    size = n.cast("double")
    variance = size * (size + 1) * (2 * size + 1) / 24 - ties / 48.0
    deviate = (w - size * (size + 1) / 4) / F.sqrt(variance)
    return F.when(n == 0, 1.0).when((n <= EXACT) & (ties == 0), exact).otherwise(normal(deviate))


def rank_correlation(rho: Column, n: Column) -> Column:
    """Two-sided p of a rank correlation; 1 where there is none."""
    sure = F.abs(rho) >= 1 - 1e-15
    t = rho * F.sqrt((n - 2) / F.when(sure, 1.0).otherwise(1 - rho * rho))
    return F.when(rho.isNull() | (n < 3), 1.0).when(sure, 0.0).otherwise(student(t, (n - 2).cast("double")))


def kolmogorov(gap: Column, n: Column, m: Column) -> Column:
    """Asymptotic p of the greatest gap between two empirical distributions of ``n`` and ``m`` values."""
    z = gap * F.sqrt(n * m / (n + m).cast("double"))
    series = F.aggregate(F.sequence(F.lit(1), F.lit(100)), F.lit(0.0), lambda total, k: total + F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2 * k * k * z * z))
    return F.when(z < 0.2, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), series)))
