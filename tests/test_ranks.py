"""Rank tests of many groups, their tails and allocations, against local versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ensemblecast.functions import aggregates, ranks, tails
from ensemblecast.operators import ranktests, selection


def test_tails(spark):
    zs = [0.0, 0.01, 0.3, 1.0, 1.7, 2.5, 4.0, 8.0]
    cells = [(x, d) for x in (-3.0, 0.05, 0.7, 2.0, 5.0, 30.0) for d in (1.0, 2.0, 5.0, 30.0, 400.0, 1999.0, 2001.0, 1e5)]
    rows = spark.createDataFrame([(z, 1.0) for z in zs] + cells, "x double, d double")
    for r in rows.select("x", "d", tails.normal(F.col("x")).alias("z"), tails.student(F.col("x"), F.col("d")).alias("t"), tails.chi2(F.col("x"), F.least("d", F.lit(120.0))).alias("c")).collect():
        assert r["z"] == pytest.approx(ranktests.normal_two_sided(r["x"]), rel=1e-11)
        assert r["t"] == pytest.approx(ranktests.student_two_sided(r["x"], r["d"]), abs=1e-7)
        assert r["c"] == pytest.approx(ranktests.chi2_tail(r["x"], min(r["d"], 120.0)), abs=1e-10)


@pytest.fixture(scope="module")
def groups(spark):
    rnd = np.random.default_rng(0)
    made = {}
    for g, n in ((None, 5), ("b", 30), ("c", 50), ("d", 51), ("e", 400), ("f", 3)):
        x = rnd.normal(size=n)
        y = x + rnd.normal(0.2, 1, n)
        made[g] = (np.round(x), np.round(x if g == "f" else y)) if g in ("e", "f") else (x, y)
    rows = [(g, float(a), float(b)) for g, (x, y) in made.items() for a, b in zip(x, y)]
    return made, spark.createDataFrame(rows + [("b", None, 1.0), ("b", 1.0, None)], "g string, a double, b double").repartition(5).cache()


def test_grouped_tests(groups):
    """All groups in one pass: exact and normal tails, ties, a group named null, one without a difference."""
    made, frame = groups
    found = {r["g"]: r for r in ranks.signed_rank(frame, "a", "b", ("g",)).collect()}
    assert found.keys() == made.keys() and found["f"]["n"] == 0
    for g, (x, y) in made.items():
        w, p = ranktests.wilcoxon(x, y)
        assert (found[g]["w"], found[g]["p"]) == (pytest.approx(w), pytest.approx(p, abs=1e-12))
    for r in ranks.spearman(frame, "a", "b", ("g",)).collect():
        rho, p = ranktests.spearman(*made[r["g"]])
        assert (r["rho"], r["p"]) == (pytest.approx(rho), pytest.approx(p, abs=1e-10))
    for r in ranks.two_samples(frame, "a", F.col("b") > 0, ("g",)).collect():
        x, y = made[r["g"]]
        gap, p = ranktests.ks_two_sample(x[y <= 0], x[y > 0])
        assert (r["n"], r["m"], r["gap"], r["p"]) == ((y <= 0).sum(), (y > 0).sum(), pytest.approx(gap), pytest.approx(p, abs=1e-12))
    alone = ranks.signed_rank(frame.where("g = 'c'"), "a", "b").first()
    assert alone["p"] == pytest.approx(found["c"]["p"]) and ranks.signed_rank(frame.where("false"), "a", "b").first()["p"] == 1.0
    labels = frame.withColumn("x", F.round(F.col("a")).cast("int")).withColumn("y", F.round(F.col("b")).cast("int")).dropna()
    own = np.array([(r["x"], r["y"]) for r in labels.collect()])
    assert ranks.adjusted_rand(labels, "x", "y").first()["ari"] == pytest.approx(ranktests.adjusted_rand(own[:, 0], own[:, 1]))
    assert ranks.adjusted_rand(labels, "x", "x").first()["ari"] == 1.0


def test_allocations_of_many_pools(spark):
    rnd = random.Random(3)
    pools = []
    for _ in range(300):
        sizes = [rnd.randint(1, rnd.choice([2, 9, 60])) for _ in range(rnd.randint(1, 14))]
        pools.append((sizes, rnd.randint(1, sum(sizes) + 3)))
    frame = spark.createDataFrame([(g, i, s, n) for g, (sizes, n) in enumerate(pools) for i, s in enumerate(sizes)], "g int, cluster int, size long, n int")
    got = {(r["g"], r["cluster"]): r["take"] for r in aggregates.allocate(frame, ["g"], F.col("n")).collect()}
    for g, (sizes, n) in enumerate(pools):
        assert [got[g, i] for i in range(len(sizes))] == selection.allocate_exact(np.array(sizes), sum(sizes), n).tolist()


def test_hot_ties_are_split(spark):
    """Two million rows of one value, and a few others: no range has much more than its share."""
    n = 2_000_000
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        frame = spark.range(n).select(F.when(F.col("id") % 1000 == 0, F.col("id")).otherwise(F.lit(77)).cast("double").alias("v"), F.xxhash64("id").alias("uid"))
        placed = ranks._ranged(frame, (), ("v", "uid"), n=F.lit(1))
        sizes = [r["count"] for r in placed.groupBy("range").count().collect()]
        assert len(sizes) >= 4 and max(sizes) < 1.5 * n / len(sizes)
        ordered = ranks.global_order(frame, "v", "uid")
        told = ordered.agg(F.min("r"), F.max("r"), F.count_distinct("r")).first()
        assert tuple(told) == (1, n, n)
        low = ordered.where("v < 77").agg(F.max("r")).first()[0]
        assert low == frame.where("v < 77").count() and ordered.where("v = 77").agg(F.min("r")).first()[0] == low + 1
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
