"""Accuracy measures as columns. Divisions by zero give NaN or infinity instead of an error."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

def ratio(top: Column, bottom: Column) -> Column:
    """As floating point has it."""
    return F.when(bottom != 0, top / F.when(bottom != 0, bottom)).when(F.isnan(top) | (top == 0), F.lit(float("nan"))).otherwise(F.signum(top) * F.lit(float("inf")))


def smape_term(y: Column, f: Column) -> Column:
    return ratio(200 * F.abs(y - f), F.abs(y) + F.abs(f))


def mape_term(y: Column, f: Column) -> Column:
    return 100 * F.abs(ratio(y - f, y))


def smape(y: Column, f: Column) -> Column:
    return F.avg(smape_term(y, f))


def mape(y: Column, f: Column) -> Column:
    return F.avg(mape_term(y, f))


def mae(y: Column, f: Column) -> Column:
    return F.avg(F.abs(y - f))


def rms(y: Column, f: Column) -> Column:
    return F.sqrt(F.avg((y - f) * (y - f)))


def seasonal_step(value: str, m: Column | int) -> Column:
    """|y_t - y_{t-m}| by series; aggregate with ``avg`` for the scale of a scaled error."""
    lag = F.lag(value, m if isinstance(m, int) else 1).over(Window.partitionBy("uid").orderBy("idx"))
    return F.abs(F.col(value) - lag)


def array_mean(terms: Column) -> Column:
    return F.aggregate(terms, F.lit(0.0), lambda a, v: a + v) / F.size(terms)


def array_smape(y: str, f: str) -> Column:
    return array_mean(F.zip_with(y, f, smape_term))


def array_mape(y: str, f: str) -> Column:
    return array_mean(F.zip_with(y, f, mape_term))


METRICS = {"smape": array_smape, "mape": array_mape}


def array_mase(y: str, f: str, train: str, m: Column) -> Column:
    lag = F.greatest(F.lit(1), m)
    steps = F.zip_with(F.slice(train, lag + 1, F.size(train) - lag), F.slice(train, F.lit(1), F.size(train) - lag), lambda a, b: F.abs(a - b))
    return ratio(array_mean(F.zip_with(y, f, lambda a, b: F.abs(a - b))), array_mean(steps))
