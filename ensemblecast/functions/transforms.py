"""Series transforms as columns: scalars over long rows, arrays over packed rows."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

TINY = "2.2250738585072014E-308"
NAN, INF = "double('NaN')", "double('Infinity')"


def boxcox(x: Column, lam: Column) -> Column:
    power = (F.signum(x) * F.pow(F.abs(x), lam) - 1) / F.when(lam == 0, F.lit(1.0)).otherwise(lam)
    return F.when(F.abs(lam) < 1e-12, F.log(x)).otherwise(power)


def inv_boxcox(x: Column, lam: Column) -> Column:
    base = F.greatest(lam * x + 1, F.expr(f"{TINY}D"))
    return F.when(F.abs(lam) < 1e-12, F.exp(x)).otherwise(F.pow(base, 1 / F.when(F.abs(lam) < 1e-12, F.lit(1.0)).otherwise(lam)))


def is_clipped(x: Column, lam: Column) -> Column:
    """Whether the inverse has to be clipped to stay positive."""
    return (F.abs(lam) >= 1e-12) & (lam * x + 1 <= 0)


def next_odd(x: Column) -> Column:
    r = F.bround(x)
    return (r + (r % 2 == 0).cast("int")).cast("int")


def default_tail(n: Column, m: Column) -> Column:
    """Length of the held-out tail: two seasons (or 10), at most under half of the series."""
    return F.least(F.when(m > 1, 2 * m).otherwise(10), F.floor((n - 1) / 2)).cast("int")


def least_tail(m: Column) -> Column:
    """Shorter tails aren't validated on."""
    return F.greatest(F.lit(4), m)


def pack(value: str = "y", order: str = "idx") -> Column:
    """An aggregate: the values of a series as an array in time order."""
    return F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda p: p[value])


def head(array: str, n: Column) -> Column:
    return F.slice(array, F.lit(1), n)


def tail(array: str, n: Column) -> Column:
    """All values after the first ``n``."""
    return F.slice(array, n + 1, F.size(array) - n)


def block_replica(array: str, starts: Column, offset: Column, block: int) -> Column:
    """Blocks of an array from given places (from 0), joined, from an offset on, as long as the array."""
    joined = F.flatten(F.transform(starts, lambda s: F.slice(array, s + 1, block)))
    return F.slice(joined, offset + 1, F.size(array))


def windows(array: str, lookback: Column, horizon: Column) -> Column:
    """(x, target) pairs, oldest first."""
    last = F.size(array) - lookback - horizon
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(F.slice(array, i + 1, lookback).alias("x"), F.slice(array, i + lookback + 1, horizon).alias("target")))


def scale(x: Column) -> Column:
    """Mean absolute value of an array, 1 if that is almost zero."""
    level = F.aggregate(x, F.lit(0.0), lambda a, v: a + F.abs(v)) / F.size(x)
    return F.when(level < 1e-8, F.lit(1.0)).otherwise(level)


def lookback(n: Column, horizon: Column, multiplier: int = 3, least_windows: int = 8) -> Column:
    size = F.least(multiplier * horizon, n - horizon - least_windows + 1)
    return F.when(size >= horizon, size)


def trailing_block(n: Column, period: Column) -> Column:
    """Number of the block of a row ``idx`` (from 1); blocks end with the series, leftovers in front are negative."""
    count = F.floor(n / period)
    return F.floor((F.col("idx") - 1 - (n - count * period)) / period)


def cycle_mean(value: str, m: Column) -> Column:
    return F.avg(value).over(Window.partitionBy("uid", F.pmod(F.col("idx") - 1, m)))
