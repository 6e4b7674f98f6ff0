"""Comparisons of runs with anchors and with an independent implementation, and their reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ensemblecast.functions import metrics, transforms
from ensemblecast.plans import experiment
from ensemblecast.plans.strategies import parse
from ensemblecast.session import cut


def engine_summary(scores: DataFrame) -> DataFrame:
    """Mean and median of both measures by engine, over the series that all engines have."""
    engines = scores.select("engine").distinct().count()
    matched = scores.groupBy("uid").agg(F.count_distinct("engine").alias("k")).where(F.col("k") == engines).select("uid")
    kept = scores.join(matched, "uid", "left_semi")
    return kept.groupBy("engine").agg(*(f(c).alias(f"{n}_{c}") for c in ("smape", "mase") for n, f in (("mean", F.avg), ("median", F.median)))).orderBy("mean_smape")


def calibration(scores: DataFrame, anchor: float, gate: float, fallback: Column | None = None, most_fallback: float = 0.005) -> DataFrame:
    """One row: averages, the distance to a published value, the share of fallbacks, and whether both gates hold."""
    out = scores.agg(
        F.count("*").alias("n"), F.avg("smape").alias("mean_smape"), F.median("smape").alias("median_smape"), F.avg("mase").alias("mean_mase"),
        F.avg((fallback if fallback is not None else F.lit(False)).cast("double")).alias("fallback_rate"),
    )
    out = out.withColumn("delta", F.col("mean_smape") - anchor)
    return out.withColumn("passed", (F.abs("delta") <= gate) & (F.col("fallback_rate") < most_fallback))


def runnable_cases(series: DataFrame, both: tuple[str, ...] = (), left_out: tuple[str, ...] = ("synthetic_ar1",)) -> DataFrame:
    """``series(uid, m, h, n_train)`` as cases (uid, m, h, variant) of a comparison with the method's first publication.

    That needs a training part longer than two held-out tails (two seasons, or ten points without one). All cases
    run with five clusters, those in ``both`` with a number of their own choice too.
    """
    tail = F.when(F.col("m") > 1, 2 * F.col("m")).otherwise(10)
    variants = F.when(F.col("uid").cast("string").isin([str(u) for u in both]), F.array(F.lit("k5"), F.lit("auto"))).otherwise(F.array(F.lit("k5")))
    kept = series.where((F.col("n_train") - tail > tail) & ~F.col("uid").cast("string").isin(list(left_out)))
    return kept.select("uid", "m", "h", F.explode(variants).alias("variant"))


def seed_runs(series: DataFrame, cases: DataFrame, seeds: list[int], path: str, members: int = 1000, n: int = 100, engine: str = "ets") -> DataFrame:
    """One row a case and seed under ``path``: case, variant, seed, point, smape, k_chosen, n_members; what stands there isn't run again."""
    spark = series.sparkSession
    schema = "case string, variant string, seed int, point array<double>, smape double, k_chosen int, n_members long"
    spark.createDataFrame([], schema).write.mode("append").parquet(path)
    for seed in seeds:
        done = spark.read.schema(schema).parquet(path).where(F.col("seed") == seed).select(F.col("case").alias("uid"), "variant")
        todo = cases.join(done, ["uid", "variant"], "left_anti").select("uid", "variant")
        own = series.join(todo.select("uid").distinct(), "uid", "left_semi")
        if own.isEmpty():
            continue
        artifacts = cut(experiment.stage_a(own, members, seed, engine))
        labels = {"k5": "paper-k5", "auto": "paper-auto"}
        specs = [parse(t) for t in labels.values()]
        points = experiment.points(artifacts, experiment.select(artifacts, specs, n, (seed,)), specs)
        packed = points.groupBy("uid", "strategy", "n_members", "k_chosen").agg(transforms.pack("value", "step").alias("point"))
        variant = F.when(F.col("strategy") == "paper-k5", "k5").otherwise("auto")
        scored = packed.withColumn("variant", variant).join(todo, ["uid", "variant"], "left_semi").join(own.select("uid", "y_test"), "uid")
        scored = scored.select(F.col("uid").alias("case"), "variant", F.lit(seed).alias("seed"), "point", metrics.array_smape("y_test", "point").alias("smape"), "k_chosen", "n_members")
        scored.write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


def gates(cases: DataFrame) -> DataFrame:
    """One row over the cases of :func:`seed_band`: whether our method as a whole agrees with the outside one.

    ``g1``: at most one case, of those whose base learners agree, lies out of our band of seeds. ``g2``: each of them
    is within 1.5 points or three deviations, and their mean within half a point. ``attributed``: where the learners
    differ, the whole differs by no more than 1.5 points beyond that.
    """
    near = F.abs("delta") <= F.greatest(F.lit(1.5), 3 * F.col("sd_smape"))
    explained = F.abs("delta") <= F.abs("engine_delta") + 1.5
    all_of = lambda rows, holds: F.coalesce(F.bool_and(F.when(rows, holds)), F.lit(True))
    out = cases.agg(
        F.count("*").alias("n"), F.count_if("counts").alias("n_counting"), F.count_if(F.col("counts") & ~F.col("in_band")).alias("out_of_band"),
        F.avg(F.when(F.col("counts"), F.col("delta"))).alias("mean_delta"), all_of(F.col("counts"), near).alias("near"), all_of(~F.col("counts"), explained).alias("attributed"),
    )
    g1, g2 = F.col("out_of_band") <= 1, F.col("near") & (F.abs("mean_delta") <= 0.5)
    return out.withColumns({"g1": g1, "g2": F.coalesce(g2, F.lit(False))}).withColumn("passed", F.col("g1") & F.col("g2") & F.col("attributed")).drop("near")


def seed_band(points: DataFrame, reference: DataFrame, delta: float = 0.5) -> DataFrame:
    """Our seeds against one outside run, by case.

    ``points(case, seed, point array, smape)`` and ``reference(case, point array, smape, engine_delta)``: mean and
    spread over seeds, whether the outside score lies in our band, its distance, root mean square differences to
    the outside forecast and between our own seeds, and whether the base learners agree enough for the case to count.
    """
    ours = points.groupBy("case").agg(
        F.avg("smape").alias("mean_smape"), F.coalesce(F.stddev_samp("smape"), F.lit(0.0)).alias("sd_smape"), F.min("smape").alias("low"), F.max("smape").alias("high"), F.count("*").alias("seeds"),
    )
    gap = lambda a, b: F.sqrt(metrics.array_mean(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))
    outside = points.select("case", "point").join(reference.select("case", F.col("point").alias("theirs")), "case")
    to_outside = outside.groupBy("case").agg(F.avg(gap("point", "theirs")).alias("rms_to_reference"))
    a, b = points.select("case", F.col("seed").alias("i"), F.col("point").alias("a")), points.select("case", F.col("seed").alias("j"), F.col("point").alias("b"))
    between = a.join(b, "case").where("i < j").groupBy("case").agg(F.median(gap("a", "b")).alias("rms_between_seeds"))  # ten seeds a case
    out = ours.join(reference.select("case", F.col("smape").alias("reference_smape"), "engine_delta"), "case").join(to_outside, "case").join(between, "case", "left")
    return out.withColumns({
        "in_band": F.col("reference_smape").between(F.col("low"), F.col("high")), "delta": F.col("mean_smape") - F.col("reference_smape"),
        "counts": F.abs("engine_delta") <= delta,
    })


def fitted_ensemble(artifacts: DataFrame, selected: DataFrame, series: DataFrame) -> DataFrame:
    """(uid, strategy, seed, idx, fitted, residual, n): what an ensemble would have said one step ahead, and how far off it was.

    ``fitted`` is the mean of the chosen members' one-step fits, over those that have one at a place. Means are summed up where
    the members are, before the shuffle; residuals come from a join by place.
    """
    own = artifacts.select("uid", "member", "fitted").join(selected.select("uid", "strategy", "seed", "member"), ["uid", "member"])
    rows = own.select("uid", "strategy", "seed", F.posexplode("fitted").alias("k", "f")).where("f is not null and not isnan(f)")
    mean = rows.groupBy("uid", "strategy", "seed", "k").agg(F.avg("f").alias("fitted"), F.count("*").alias("n"))
    actual = series.select("uid", F.posexplode("y_train").alias("k", "y"))
    return mean.join(actual, ["uid", "k"]).select("uid", "strategy", "seed", (F.col("k") + 1).alias("idx"), "fitted", (F.col("y") - F.col("fitted")).alias("residual"), "n")


def markdown(frame: DataFrame, title: str, digits: int = 3, most: int = 1000) -> str:
    """A summary frame (a row a strategy or case) as a Markdown table."""
    show = lambda v: f"{v:.{digits}f}" if isinstance(v, float) else str(v)
    rows = ["| " + " | ".join(map(show, r)) + " |" for r in frame.limit(most).collect()]
    return "\n".join([f"## {title}", "", "| " + " | ".join(frame.columns) + " |", "|" + "---|" * len(frame.columns), *rows, ""])
