"""Ensembles as aggregates over member rows ``(uid, ..., step, value)``."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SIMPLE: dict[str, Callable[[str], Column]] = {"median": F.median, "mean": F.avg, "min": F.min, "max": F.max}


def trimmed_mean(rows: DataFrame, by: list[str], value: str = "value", share: float = 0.1) -> DataFrame:
    """Mean without the lowest and the highest ``int(share * n)`` of each group."""
    w = Window.partitionBy(*by)
    cut = F.floor(F.lit(share) * F.col("n"))
    ranked = rows.withColumns({"n": F.count("*").over(w), "rn": F.row_number().over(w.orderBy(value))})
    return ranked.where((F.col("rn") > cut) & (F.col("rn") <= F.col("n") - cut)).groupBy(*by).agg(F.avg(value).alias(value))


def combine(rows: DataFrame, by: list[str], how: str | Callable, value: str = "value") -> DataFrame:
    """One value a group by name (median, mean, trimmed, min, max) or by a function of a numpy vector or a column."""
    if how == "trimmed":
        return trimmed_mean(rows, by, value)
    if isinstance(how, str):
        if how not in SIMPLE:
            raise ValueError(f"unknown aggregator {how!r}; one of {sorted([*SIMPLE, 'trimmed'])}")
        return rows.groupBy(*by).agg(SIMPLE[how](value).alias(value))
    @F.pandas_udf("double")
    def custom(v: pd.Series) -> float:
        return float(how(v.to_numpy()))

    return rows.groupBy(*by).agg(custom(value).alias(value))


def quantiles(rows: DataFrame, by: list[str], at: list[float], value: str = "value") -> DataFrame:
    """Linear quantiles of the members, q_5 for 0.05 and so on: their spread, not a calibrated interval."""
    return rows.groupBy(*by).agg(*(F.percentile(value, F.lit(q)).alias(f"q_{round(100 * q)}") for q in at))


def with_weights(families: DataFrame, by: list[str]) -> DataFrame:
    """A weight for each row of ``families(..., aicc)``."""
    w = Window.partitionBy(*by)
    raw = families.withColumn("least", F.min("aicc").over(w)).withColumn("raw", F.exp(-0.5 * (F.col("aicc") - F.col("least"))))
    return raw.withColumn("weight", F.col("raw") / F.sum("raw").over(w)).drop("least", "raw")


def entropy(weight: str) -> Column:
    """In nats; weights that vanish count nothing."""
    return -F.sum(F.when(F.col(weight) > 0, F.col(weight) * F.log(F.when(F.col(weight) > 0, F.col(weight)).otherwise(1.0))).otherwise(0.0))


def prefix_means(rows: DataFrame, by: list[str], order: str, value: str = "value") -> DataFrame:
    """``top``: mean over the first 1, 2, ... rows of a group, all in one pass."""
    w = Window.partitionBy(*by).orderBy(order)
    return rows.withColumns({"j": F.row_number().over(w), "top": F.avg(value).over(w.rowsBetween(Window.unboundedPreceding, 0))})


def off_the_tops(frame: DataFrame, by: list[str], pile: str, height: str, units: str) -> DataFrame:
    """``lost``: how many of ``units`` each pile of a group loses if one after another goes from the first of the highest piles.

    No unit is looked at alone. Cut down to a level, the k highest piles lose at least their sum less k levels; the lowest level that costs
    no more than ``units`` follows from these sums, and what is left over is one more unit for each of the first piles there.
    """
    group = Window.partitionBy(*by)
    tallest = group.orderBy(F.desc(height), pile).rowsBetween(Window.unboundedPreceding, 0)
    spare = F.greatest(F.lit(0), F.col(units))
    own = frame.withColumn("_level", F.ceil((F.sum(height).over(tallest) - spare) / F.count("*").over(tallest)))
    own = own.withColumn("_level", F.greatest(F.lit(0), F.max("_level").over(group))).withColumn("_lost", F.greatest(F.lit(0), F.col(height) - F.col("_level")))
    reached = (F.col(height) >= F.col("_level")) & (F.col("_level") > 0)
    own = own.withColumn("_next", F.sum(F.when(reached, 1).otherwise(0)).over(group.orderBy(pile).rowsBetween(Window.unboundedPreceding, 0)))
    more = reached & (F.col("_next") <= spare - F.sum("_lost").over(group))
    return own.withColumn("lost", (F.col("_lost") + more.cast("int")).cast("long")).drop("_level", "_lost", "_next")


def allocate(clusters: DataFrame, by: list[str], n: Column, pile: str = "cluster", size: str = "size") -> DataFrame:
    """``clusters`` with ``take``: largest remainders of ``n`` by size, then shifted so that each gets 1 to its size and the total is ``n``.

    With more clusters than ``n`` the first of the largest give way, down to none; where all are used up the total is less.
    """
    group = Window.partitionBy(*by)
    share = F.col(size) / F.sum(size).over(group) * F.col("_n")
    rows = clusters.withColumn("_n", n).withColumn("_share", share).withColumn("_whole", F.floor("_share"))
    place = F.row_number().over(group.orderBy(F.col("_whole") - F.col("_share"), pile))
    rows = rows.withColumn("_wanted", F.least(F.col(size), F.greatest(F.lit(1), F.col("_whole") + (place <= F.col("_n") - F.sum("_whole").over(group)).cast("int"))))
    rows = off_the_tops(rows.withColumn("_units", F.sum("_wanted").over(group) - F.col("_n")), by, pile, "_wanted", "_units")
    rows = rows.withColumn("_wanted", F.col("_wanted") - F.col("lost")).withColumn("_room", F.col(size) - F.col("_wanted"))
    rows = off_the_tops(rows.withColumn("_units", F.col("_n") - F.sum("_wanted").over(group)), by, pile, "_room", "_units")
    return rows.withColumn("take", (F.col("_wanted") + F.col("lost")).cast("long")).drop("_n", "_share", "_whole", "_wanted", "_room", "_units", "lost")
