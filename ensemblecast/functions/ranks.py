"""Ranks and the parts of rank tests that are relational."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ensemblecast.functions import tails
from ensemblecast.session import cut


def average_rank(value: str, *by: str, descending: bool = False) -> Column:
    """Ties share the mean of their ranks."""
    order = F.desc(value) if descending else F.asc(value)
    return F.rank().over(Window.partitionBy(*by).orderBy(order)) + (F.count("*").over(Window.partitionBy(*by, value)) - 1) / 2.0


def ordinal_rank(value: str, tie: str, *by: str) -> Column:
    return F.row_number().over(Window.partitionBy(*by).orderBy(value, tie))


def summary(scores: DataFrame) -> DataFrame:
    """Per strategy the mean rank, mean and median of both measures, over seeds first; the best rank comes first."""
    mean = scores.groupBy("uid", "strategy").agg(F.avg("smape").alias("smape"), F.avg("mase").alias("mase"))
    ranked = mean.withColumns({f"rank_{c}": average_rank(c, "uid") for c in ("smape", "mase")})
    return ranked.groupBy("strategy").agg(
        *(x for c in ("smape", "mase") for x in (F.avg(f"rank_{c}").alias(f"rank_{c}"), F.avg(c).alias(f"mean_{c}"), F.median(c).alias(f"median_{c}")))
    ).orderBy("rank_smape", "strategy")


def friedman_parts(scores: DataFrame, metric: str) -> DataFrame:
    """One row: n, k and the tie-corrected statistic."""
    ranked = scores.withColumn("r", average_rank(metric, "uid"))
    ties = ranked.groupBy("uid", metric).count().agg(F.sum(F.col("count") * F.col("count") * F.col("count") - F.col("count")).alias("ties"))
    sums = ranked.groupBy("strategy").agg(F.sum("r").alias("total"), F.count("*").alias("n"))
    out = sums.agg(F.max("n").alias("n"), F.count("*").alias("k"), F.sum(F.col("total") * F.col("total")).alias("squares")).crossJoin(F.broadcast(ties))  # two one-row frames
    n, k = F.col("n"), F.col("k")
    raw = 12 / (n * k * (k + 1)) * F.col("squares") - 3 * n * (k + 1)
    return out.select("n", "k", (raw / (1 - F.col("ties") / (n * k * (k * k - 1)))).alias("statistic"))


def rank_z(scores: DataFrame, metric: str, control: str | None = None) -> DataFrame:
    """strategy, mean_rank and z against the control (the best mean rank if None)."""
    ranked = scores.withColumn("r", average_rank(metric, "uid")).groupBy("strategy").agg(F.avg("r").alias("mean_rank"), F.count("*").alias("n"))
    everything = Window.partitionBy()  # a row a strategy
    base = F.min(F.struct("mean_rank", "strategy")).over(everything)["mean_rank"] if control is None else F.max(F.when(F.col("strategy") == control, F.col("mean_rank"))).over(everything)
    k = F.count("*").over(everything)
    return ranked.withColumns({"base": base, "k": k}).select(
        "strategy", "mean_rank", ((F.col("mean_rank") - F.col("base")) / F.sqrt(F.col("k") * (F.col("k") + 1) / (6.0 * F.col("n")))).alias("z")
    )


def hochberg(p: str) -> Column:
    """Step-up adjustment of a column of p values (one family, so one window)."""
    order = Window.partitionBy().orderBy(F.desc(p))
    return F.least(F.lit(1.0), F.min(F.col("step")).over(order.rowsBetween(Window.unboundedPreceding, 0)))


def adjust(frame: DataFrame, p: str = "p_raw") -> DataFrame:
    step = F.col(p) * F.row_number().over(Window.partitionBy().orderBy(F.desc(p)))
    return frame.withColumn("step", step).withColumn("p_hochberg", hochberg(p)).drop("step")


def _match(left: DataFrame, right: DataFrame, **names: str) -> Column:
    """Equality of columns of two frames, nulls equal to each other."""
    out = None
    for ours, theirs in names.items():
        own = left[ours].eqNullSafe(right[theirs])
        out = own if out is None else out & own
    return out


def _ranged(table: DataFrame, by: tuple[str, ...], order: tuple[str, ...], **weights: Column) -> DataFrame:
    """``table`` with the ``range`` that a row falls into, and for each weight ``before_*``, its sum over the group's ranges below.

    Ranges follow the order of ``by`` and ``order`` and are drawn from a sample by a range shuffle, as many as the rows need. Rows that
    tie in the first columns are split by the last, so neither a hot value nor a hot group ends in one task.
    """
    placed = cut(table.repartitionByRange(*by, *order).withColumn("range", F.spark_partition_id()))
    sums = placed.groupBy(*by, "range").agg(*(F.sum(w).alias(f"own_{k}") for k, w in weights.items()))
    lower = Window.partitionBy(*by).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row a group and range
    names = {c: f"of_{c}" for c in (*by, "range")}
    below = cut(sums.select(*(F.col(c).alias(n) for c, n in names.items()), *(F.coalesce(F.sum(f"own_{k}").over(lower), F.lit(0)).alias(f"before_{k}") for k in weights)))
    return placed.join(below, _match(placed, below, **names)).drop(*names.values())


def _counted(frame: DataFrame, value: str, by: tuple[str, ...], sums: dict[str, Column]) -> DataFrame:
    """A row a group and different value, so that ties are gone before anything is ordered."""
    return cut(frame.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("value")).agg(F.count("*").alias("n"), *(c.alias(k) for k, c in sums.items())))


def value_ranks(frame: DataFrame, value: str, by: tuple[str, ...] = (), **sums: Column) -> DataFrame:
    """(by, value, n, rank and ``sums``): one row a different value, with its average rank in its group.

    Values are counted first and ranked range by range, the ranges of all groups at once, so no task has a whole group.
    """
    upto = F.sum("n").over(Window.partitionBy(*by, "range").orderBy("value"))
    ranged = _ranged(_counted(frame, value, by, sums), by, ("value",), n=F.col("n"))
    return ranged.withColumn("rank", F.col("before_n") + upto - (F.col("n") - 1) / 2.0).drop("range", "before_n")


def running(frame: DataFrame, value: str, by: tuple[str, ...] = (), **sums: Column) -> DataFrame:
    """(by, value and ``sums``): the sums over all values of the group up to each different one."""
    ranged = _ranged(_counted(frame, value, by, sums), by, ("value",), **{k: F.col(k) for k in sums})
    upto = Window.partitionBy(*by, "range").orderBy("value")
    return ranged.select(*by, "value", *((F.col(f"before_{k}") + F.sum(k).over(upto)).alias(k) for k in sums))


def global_order(frame: DataFrame, value: str, tie: str) -> DataFrame:
    """``frame`` with ``r``, the place of each row in order of ``value`` and ``tie``, from 1."""
    own = F.row_number().over(Window.partitionBy("range").orderBy(value, tie))
    return _ranged(cut(frame), (), (value, tie), n=F.lit(1)).withColumn("r", F.col("before_n") + own).drop("range", "before_n")


def signed_rank(pairs: DataFrame, a: str, b: str, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, n without zero differences, w_plus, w_minus, w, p): Wilcoxon's test of every group, two-sided."""
    d = pairs.select(*by, (F.col(a) - F.col(b)).alias("d")).where("d != 0").withColumn("size", F.abs("d"))
    ranked = value_ranks(d, "size", by, plus=F.count_if(F.col("d") > 0))
    plus, minus = (F.coalesce(F.sum(F.col("rank") * c), F.lit(0.0)) for c in (F.col("plus"), F.col("n") - F.col("plus")))
    ties = F.coalesce(F.sum((F.col("n") * F.col("n") * F.col("n") - F.col("n")).cast("double")), F.lit(0.0))
    found = ranked.groupBy(*by).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), plus.alias("w_plus"), minus.alias("w_minus"), ties.alias("ties"))
    if by:  # groups whose differences are all zero
        groups = pairs.select(*(F.col(c).alias(f"of_{c}") for c in by)).distinct()
        found = groups.join(found, _match(groups, found, **{f"of_{c}": c for c in by}), "left").select(*(F.col(f"of_{c}").alias(c) for c in by), *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "w_plus", "w_minus", "ties")))
    found = found.withColumn("w", F.least("w_plus", "w_minus"))
    return found.withColumn("p", tails.signed_rank(F.col("n"), F.col("w"), F.col("ties"))).drop("ties")


def wilcoxon_parts(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """n without zero differences, both rank sums and W."""
    return signed_rank(pairs, a, b).drop("p")


def spearman(pairs: DataFrame, x: str, y: str, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, rho (null where all values tie), n and two-sided p), over the pairs that have both values."""
    both = cut(pairs.select(*by, F.col(x).alias("x"), F.col(y).alias("y")).where("x is not null and y is not null"))
    ranked = both
    for c in ("x", "y"):
        side = value_ranks(both, c, by).select(*(F.col(g).alias(f"of_{g}") for g in by), F.col("value").alias(f"value_{c}"), F.col("rank").alias(f"r{c}"))
        names = {g: f"of_{g}" for g in by} | {c: f"value_{c}"}
        ranked = ranked.join(side, _match(ranked, side, **names)).drop(*names.values())
    spread = F.stddev_pop("rx") * F.stddev_pop("ry")  # none where all values tie
    found = ranked.groupBy(*by).agg(F.when(spread > 0, F.covar_pop("rx", "ry") / F.when(spread > 0, spread)).alias("rho"), F.count("*").alias("n"))
    return found.withColumn("p", tails.rank_correlation(F.col("rho"), F.col("n")))


def two_samples(frame: DataFrame, value: str, second: Column, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, n, m, gap, p): the Kolmogorov-Smirnov test of the rows where ``second`` is false against those where it is true."""
    sides = frame.select(*by, F.col(value).alias("v"), second.alias("second")).where("v is not null and second is not null")
    shares = running(sides, "v", by, one=F.count_if(~F.col("second")), two=F.count_if(F.col("second")))
    ends = shares.groupBy(*by).agg(F.max("one").alias("n"), F.max("two").alias("m"))
    names = {c: f"of_{c}" for c in by}
    ends = ends.select(*(F.col(c).alias(n) for c, n in names.items()), "n", "m")
    both = shares.join(F.broadcast(ends)) if not by else shares.join(ends, _match(shares, ends, **names))  # one row without groups
    gap = F.max(F.abs(F.col("one") / F.col("n") - F.col("two") / F.col("m")))
    found = both.where("n > 0 and m > 0").groupBy(*by, "n", "m").agg(gap.alias("gap"))
    return found.withColumn("p", tails.kolmogorov(F.col("gap"), F.col("n"), F.col("m")))


def adjusted_rand(frame: DataFrame, one: str, other: str, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, n, ari): how far two labellings agree beyond chance, from their contingency table."""
    pairs = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2.0)
    cells = frame.groupBy(*by, F.col(one).alias("a"), F.col(other).alias("b")).agg(F.count("*").alias("c"))
    rows, columns = (cells.groupBy(*by, side).agg(F.sum("c").alias("c")) for side in "ab")
    kinds = [t.groupBy(*by).agg(pairs("c").alias("pairs"), F.sum("c").alias("n")).withColumn("kind", F.lit(k)) for k, t in enumerate((cells, rows, columns))]
    pick = lambda k: F.max(F.when(F.col("kind") == k, F.col("pairs")))
    got = kinds[0].unionByName(kinds[1]).unionByName(kinds[2]).groupBy(*by).agg(F.max("n").alias("n"), pick(0).alias("both"), pick(1).alias("first"), pick(2).alias("second"))
    chance = F.col("first") * F.col("second") / F.greatest(F.lit(1.0), F.col("n") * (F.col("n") - 1) / 2.0)
    most = (F.col("first") + F.col("second")) / 2
    return got.select(*by, "n", F.when(most == chance, 1.0).otherwise((F.col("both") - chance) / F.when(most != chance, most - chance)).alias("ari"))
