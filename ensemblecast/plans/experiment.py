"""The two-stage experiment as DataFrames.

Stage A bootstraps every series and forecasts every member, for validation and at full length, and is written
once. Stage B selects and combines members for any number of strategies and seeds without a single refit.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ensemblecast.functions import aggregates, metrics, ranks, tails, transforms
from ensemblecast.operators import bootstrap, ets, ranktests
from ensemblecast.operators.engines import build_engine
from ensemblecast.operators.selection import Artifacts, FirstN, TopK
from ensemblecast.plans.strategies import Spec, parse
from ensemblecast.session import cut, ship

#: Members that one task fits.
MEMBERS_A_TASK = 2000
POOL = "uid string, m int, h int, h_val int, member int, y array<double>, lam double, n_clipped int"
ARTIFACTS = "uid string, m int, h int, h_val int, member int, y array<double>, val_fc array<double>, val_fallback boolean, fc array<double>, method string, fallback boolean"


def pool(series: DataFrame, members: int, seed: int | None = 42, block: int | None = None, parts: int | None = None, span: int = 250, stream: Callable | None = None) -> DataFrame:
    """Member rows of every series; the stream of random numbers depends on the seed and the uid only.

    A row of work is a range of ``span`` members of one series. It draws the series' whole stream and builds its own
    members alone, so a long series is many tasks, and the rows are equal however they are dealt.
    """
    ship(series.sparkSession)
    stream = stream or bootstrap.series_rng

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                high = min(members, row.low + span)
                made = bootstrap.bootstrap_range(np.asarray(row.y_train), members, int(row.m), stream(seed, row.uid), row.low, high, block)
                yield pd.DataFrame({
                    "uid": row.uid, "m": row.m, "h": row.h, "h_val": row.h_val, "member": range(row.low, high),
                    "y": list(made.series), "lam": made.lam, "n_clipped": made.clipped,
                })

    n = F.size("y_train")
    h_val = F.col("h_val") if "h_val" in series.columns else transforms.default_tail(n, F.col("m")).alias("h_val")
    sized = series.select("uid", "m", "h", h_val, "y_train", F.explode(F.sequence(F.lit(0), F.lit(members - 1), F.lit(span))).alias("low"))
    return sized.repartition(parts or series.sparkSession.sparkContext.defaultParallelism).mapInPandas(run, POOL)


def forecasts(members: DataFrame, engine: str = "ets", final: bool = True, validate: bool = True, parts: int | None = None, fitted: bool = False, dealt: bool = False, **knobs) -> DataFrame:
    """Forecast the held-out tail and the horizon of every member row, many members of equal shape at once.

    Rows are dealt by series and member, so one long series doesn't wait for one task; rows that are ``dealt`` stay
    where they are. ``fitted`` adds the one-step fits at full length (not a number where there is none).
    """
    spark = members.sparkSession
    ship(spark)
    parts = parts or spark.sparkContext.defaultParallelism

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            frame = frame.assign(n=frame["y"].map(len))
            for (n, m, h, h_val), own in frame.groupby(["n", "m", "h", "h_val"]):
                learner = build_engine(engine, int(m)) if not knobs else type(build_engine(engine, int(m)))(int(m), **knobs)
                y = np.stack(own["y"].to_numpy())
                out = own[["uid", "m", "h", "h_val", "member", "y"]].reset_index(drop=True)
                nothing = [None] * len(own)
                checked = validate and h_val >= max(4, m)
                if checked:
                    tail = learner.forecast(y[:, : n - h_val], int(h_val))
                    out["val_fc"], out["val_fallback"] = list(tail.mean), tail.fallback
                else:
                    out["val_fc"], out["val_fallback"] = nothing, None
                if final:
                    full = learner.forecast(y, int(h), fitted)
                    out["fc"], out["method"], out["fallback"] = list(full.mean), full.methods, full.fallback
                else:
                    out["fc"], out["method"], out["fallback"] = nothing, None, None
                if fitted:
                    out["fitted"] = list(full.fitted) if final else nothing
                yield out

    rows = members if dealt else members.repartition(parts, "uid", "member")
    return rows.mapInPandas(run, ARTIFACTS + (", fitted array<double>" if fitted else ""))


def with_errors(rows: DataFrame, series: DataFrame, metric: str = "mape") -> DataFrame:
    """``val_err`` of member rows against ``actual``, the original series' tail."""
    if metric not in metrics.METRICS:
        raise ValueError(f"unknown validation metric {metric!r}; one of {sorted(metrics.METRICS)}")
    joined = rows.join(series.select("uid", "y_train"), "uid").withColumn("actual", F.slice("y_train", F.size("y_train") - F.col("h_val") + 1, F.col("h_val"))).drop("y_train")
    return joined.withColumn("val_err", F.when(F.col("val_fc").isNotNull(), metrics.METRICS[metric]("actual", "val_fc")))


def stage_a(series: DataFrame, members: int, seed: int = 42, engine: str = "ets", metric: str = "mape", **knobs) -> DataFrame:
    """Artifacts: member rows with forecasts, and their errors on the held-out tail.

    Replicas are built where they are forecast: a task takes ranges of members, and nothing but the series is shuffled.
    """
    # as many tasks as the fits need, and not fewer than there are cores
    total = series.count() * members
    parts = knobs.pop("parts", None) or max(series.sparkSession.sparkContext.defaultParallelism, -(-total // MEMBERS_A_TASK))
    span = max(1, min(members, -(-total // parts)))
    return with_errors(forecasts(pool(series, members, seed, parts=parts, span=span), engine, dealt=True, **knobs), series, metric)


SELECTED = "uid string, strategy string, seed int, member int, k_chosen int, how string"


def select(artifacts: DataFrame, specs: list[Spec], n: int = 100, seeds: tuple[int, ...] = (0,)) -> DataFrame:
    """(uid, strategy, seed, member): the chosen members of every strategy and seed.

    Simple strategies are windows. The others need a series' whole pool (a bounded number of members) at once.
    Members whose error isn't a number come last; series without any validation get a random subset.
    """
    ship(artifacts.sparkSession)
    windowed = [s for s in specs if s.strategy is None or isinstance(s.strategy, FirstN)]
    others = [s for s in specs if s not in windowed]
    every_seed = F.explode(F.array(*[F.lit(s) for s in seeds])).alias("seed")
    frames = []
    for s in windowed:
        count = 1 if s.strategy is None else s.strategy.count
        rows = artifacts if count is None else artifacts.where(F.col("member") < count)
        frames.append(rows.select("uid", F.lit(s.label).alias("strategy"), every_seed, "member", F.lit(None).cast("int").alias("k_chosen"), F.lit("selected").alias("how")))
    top = [s for s in others if isinstance(s.strategy, TopK)]
    if top:
        judged = artifacts.withColumn("checked", F.max(F.col("val_err").isNotNull()).over(Window.partitionBy("uid")))
        order = F.struct(F.coalesce("val_err", F.lit(float("nan"))).alias("e"), "member")
        best = judged.where("checked").withColumn("rn", F.row_number().over(Window.partitionBy("uid").orderBy(order))).where(F.col("rn") <= n)
        for s in top:
            frames.append(best.select("uid", F.lit(s.label).alias("strategy"), every_seed, "member", F.lit(None).cast("int").alias("k_chosen"), F.lit("selected").alias("how")))

    def choose(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("member")
        known = frame["checked"].any()
        out = []
        made = None
        if known:
            made = Artifacts(np.stack(frame["y"]), np.stack(frame["val_fc"]), np.asarray(frame["actual"].iloc[0]), frame["val_err"].to_numpy())
        for s in others:
            if known and isinstance(s.strategy, TopK):
                continue
            for seed in seeds:
                rng = bootstrap.strategy_rng(seed, key[0], s.label)
                if known:
                    members, k = s.strategy.select(made, n, rng)
                else:
                    members, k = np.sort(rng.choice(len(frame), min(n, len(frame)), replace=False)), None
                out += [(key[0], s.label, seed, int(i), k, "selected" if known else "fallback_random") for i in members]
        return pd.DataFrame(out, columns=[c.split()[0] for c in SELECTED.split(", ")])

    if others:
        frames.append(artifacts.select("uid", "member", "y", "val_fc", "val_err", "actual", F.col("val_err").isNotNull().alias("checked")).groupBy("uid").applyInPandas(choose, SELECTED))
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def points(artifacts: DataFrame, selected: DataFrame, specs: list[Spec]) -> DataFrame:
    """(uid, strategy, seed, step, value, n_members, k_chosen): the ensembles' forecasts."""
    rows = (
        selected.join(artifacts.select("uid", "member", "fc"), ["uid", "member"])
        .select("uid", "strategy", "seed", "k_chosen", F.posexplode("fc").alias("step", "value"))
        .withColumn("step", F.col("step") + 1)
    )
    by = ["uid", "strategy", "seed", "step"]
    made = []
    for how in sorted({s.aggregator for s in specs}):
        own = rows.where(F.col("strategy").isin([s.label for s in specs if s.aggregator == how]))
        made.append(aggregates.combine(own, by, how))
    out = made[0]
    for f in made[1:]:
        out = out.unionByName(f)
    sizes = selected.groupBy("uid", "strategy", "seed").agg(F.count("*").alias("n_members"), F.max("k_chosen").alias("k_chosen"))
    return out.join(sizes, ["uid", "strategy", "seed"])


def score(made: DataFrame, series: DataFrame) -> DataFrame:
    """(uid, strategy, seed, smape, mase, n_members, k_chosen)."""
    packed = made.groupBy("uid", "strategy", "seed", "n_members", "k_chosen").agg(transforms.pack("value", "step").alias("f"))
    both = packed.join(series.select("uid", "m", "y_train", "y_test"), "uid")
    return both.select("uid", "strategy", "seed", metrics.array_smape("y_test", "f").alias("smape"), metrics.array_mase("y_test", "f", "y_train", F.col("m")).alias("mase"), "n_members", "k_chosen")


def stage_b(artifacts: DataFrame, series: DataFrame, texts: list[str], n: int = 100, seeds: tuple[int, ...] = (0,)) -> DataFrame:
    specs = [parse(t) for t in texts]
    return score(points(artifacts, select(artifacts, specs, n, seeds), specs), series)


def compare(scores: DataFrame, metric: str = "smape", control: str | None = None) -> dict:
    """Friedman's test, and every strategy against the control with Hochberg's adjustment.

    The table has a row a strategy.
    """
    mean = scores.groupBy("uid", "strategy").agg(F.avg(metric).alias(metric))
    holes = mean.groupBy("strategy").agg(F.count(metric).alias("n")).collect()
    if len({r["n"] for r in holes}) > 1:
        raise ValueError(f"not every strategy has every series: { {r['strategy']: r['n'] for r in holes} }")
    if control is not None and control not in {r["strategy"] for r in holes}:
        raise ValueError(f"unknown control {control!r}")
    parts = ranks.friedman_parts(mean, metric).withColumn("p", tails.chi2(F.col("statistic"), (F.col("k") - 1).cast("double"))).first()
    judged = ranks.rank_z(mean, metric, control).withColumn("p_raw", tails.normal(F.col("z"))).orderBy("mean_rank", "strategy").toPandas()  # a row a strategy
    base = control or judged["strategy"].iloc[0]
    others = judged[judged["strategy"] != base].reset_index(drop=True)
    others["p_hochberg"] = ranktests.hochberg(others["p_raw"].to_numpy())
    return {
        "friedman_pvalue": parts["p"], "control": base,
        "control_mean_rank": float(judged.loc[judged["strategy"] == base, "mean_rank"].iloc[0]), "n_series": int(parts["n"]), "table": others,
    }


def paired(scores: DataFrame, a: str, b: str, metric: str = "smape") -> DataFrame:
    """(uid, a, b): averages of two arms on every series of the first; null where the second has none."""
    side = lambda s: scores.where(F.col("strategy") == s).groupBy("uid").agg(F.avg(metric).alias(s))
    return side(a).join(side(b), "uid", "left")


def win_rate(scores: DataFrame, a: str, b: str, metric: str = "smape") -> DataFrame:
    """How often ``b`` beats ``a`` on the series of ``a``, and both averages; where ``b`` has none it doesn't win."""
    wins = F.coalesce((F.col(b) < F.col(a)).cast("double"), F.lit(0.0))
    return paired(scores, a, b, metric).agg(F.count("*").alias("n"), F.avg(wins).alias("win_rate"), F.avg(a).alias("mean_a"), F.avg(b).alias("mean_b"))


def against(scores: DataFrame, control: str, metric: str = "smape") -> DataFrame:
    """(strategy, uid, a, b): every other strategy's average ``b`` beside the control's ``a``, on the series that both have."""
    mean = scores.groupBy("uid", "strategy").agg(F.avg(metric).alias("b"))
    base = mean.where(F.col("strategy") == control).select("uid", F.col("b").alias("a"))
    return mean.where(F.col("strategy") != control).join(base, "uid").select("strategy", "uid", "a", "b")


def paired_tests(scores: DataFrame, control: str, metric: str = "smape") -> DataFrame:
    """Every strategy against the control in one pass: n, mean difference, share of wins, w and p; and the mean difference on
    the tenth of the series that is hardest for the control, and on the others.

    The tenth is exact: places in order of the control's error (ties by uid) beyond nine tenths of their number.
    """
    pairs = cut(against(scores, control, metric))
    hard = ranks.global_order(pairs.select("uid", "a").distinct(), "a", "uid")
    total = hard.count()
    pairs = pairs.join(hard.select("uid", (F.ceil(F.col("r") * 10 / F.lit(max(1, total))) == 10).alias("hardest")), "uid")
    gap = F.col("b") - F.col("a")
    told = pairs.groupBy("strategy").agg(
        F.count("*").alias("n"), F.avg(gap).alias("mean_difference"), F.avg((F.col("b") < F.col("a")).cast("double")).alias("win_rate"),
        F.avg(F.when(F.col("hardest"), gap)).alias("hardest_difference"), F.avg(F.when(~F.col("hardest"), gap)).alias("other_difference"),
    )
    return told.join(ranks.signed_rank(pairs, "b", "a", ("strategy",)).select("strategy", "w", "p"), "strategy")


def split_half(scores: DataFrame, candidates: list[str], control: str, metric: str = "smape", seed: int = 0) -> DataFrame:
    """A choice that is judged on other series than it was made on.

    Series fall into two halves by a hash of seed and uid. On each half the candidate with the least mean error is chosen (ties by
    name) and scored on the other one. (half, strategy, n, mean_difference, w, p), the half that was scored; ``both`` has all series.
    """
    half = (F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), "uid")), 1, 8), 16, 10).cast("long") % 2).cast("string")
    pairs = cut(against(scores.where(F.col("strategy").isin([*candidates, control])), control, metric).withColumn("half", half))
    mean = pairs.groupBy("half", "strategy").agg(F.avg("b").alias("error"))
    chosen = mean.groupBy("half").agg(F.min(F.struct("error", "strategy"))["strategy"].alias("strategy"))
    scored = pairs.join(chosen.select((1 - F.col("half").cast("int")).cast("string").alias("half"), "strategy"), ["half", "strategy"])
    scored = cut(scored.select(F.explode(F.array("half", F.lit("both"))).alias("part"), F.col("strategy"), "a", "b"))
    told = scored.groupBy("part").agg(F.array_join(F.array_sort(F.collect_set("strategy")), ",").alias("strategy"), F.count("*").alias("n"), F.avg(F.col("b") - F.col("a")).alias("mean_difference"))
    return told.join(ranks.signed_rank(scored, "b", "a", ("part",)).select("part", "w", "p"), "part").withColumnRenamed("part", "half")


def require_agreement(one: DataFrame, other: DataFrame, value: str = "smape", most: float = 1e-4) -> float:
    """The greatest distance of two columns by uid, over the series that both have; an error if it isn't under ``most``."""
    both = one.select("uid", F.col(value).alias("a")).join(other.select("uid", F.col(value).alias("b")), "uid", "left")
    gap = both.agg(F.max(F.abs(F.col("a") - F.col("b"))).alias("gap")).first()["gap"]
    if gap is None or not gap < most:
        raise ValueError(f"two runs of one forecast disagree by {gap}")
    return gap


FAMILIES = "uid string, family string, method string, aicc double, n_params int, sigma2 double, fc array<double>"


def family_table(series: DataFrame, most: int = ets.MOST_STEPS, starts: int = 1) -> DataFrame:
    """Every admissible smoothing form of every series that gives finite forecasts."""
    ship(series.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            frame = frame.assign(n=frame["y_train"].map(len))
            for (_, m), own in frame.groupby(["n", "m"]):
                fits = ets.fit_families(np.stack(own["y_train"].to_numpy()), int(m), most=most, starts=starts)
                rows = [(u, ",".join(f.family), f.method, f.aicc, f.n_params, f.sigma2, f.forecast(int(h))) for u, h, found in zip(own["uid"], own["h"], fits) for f in found]
                yield pd.DataFrame([r for r in rows if np.isfinite(r[-1]).all()], columns=[c.split()[0] for c in FAMILIES.split(", ")])

    parts = max(series.sparkSession.sparkContext.defaultParallelism, -(-series.count() * len(ets.FAMILIES) // MEMBERS_A_TASK))
    return series.select("uid", "m", "h", "y_train").repartition(parts, "uid").mapInPandas(run, FAMILIES)


def family_points(families: DataFrame) -> DataFrame:
    """(uid, strategy, step, value): means of the best 1..15 forms, the weighted mean and two medians."""
    weighted = aggregates.with_weights(families, ["uid"])
    rows = weighted.select("uid", "aicc", "family", "weight", F.posexplode("fc").alias("step", "value")).withColumn("step", F.col("step") + 1)
    rows = rows.withColumn("order", F.struct("aicc", "family"))
    tops = aggregates.prefix_means(rows, ["uid", "step"], "order")
    total = F.count("*").over(Window.partitionBy("uid", "step"))
    last = F.when(F.col("j") == F.col("k"), F.sequence(F.col("j"), F.lit(len(ets.FAMILIES)))).otherwise(F.array(F.col("j")))
    swept = tops.withColumn("k", total.cast("int")).withColumn("j", F.explode(last)).select("uid", F.format_string("top%d_mean", "j").alias("strategy"), "step", F.col("top").alias("value"))
    by = ["uid", "step"]
    parts = [
        swept,
        rows.groupBy(*by).agg(F.sum(F.col("weight") * F.col("value")).alias("value")).withColumn("strategy", F.lit("aicc_weighted")),
        aggregates.combine(rows, by, "median").withColumn("strategy", F.lit("all_median")),
        aggregates.combine(tops.where("j <= 5"), by, "median").withColumn("strategy", F.lit("top5_median")),
        tops.where("j = 1").select(*by, "value", F.lit("ets_best").alias("strategy")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def family_scores(families: DataFrame, series: DataFrame) -> DataFrame:
    sizes = families.groupBy("uid").agg(F.count("*").alias("n_members"))
    made = family_points(families).join(sizes, "uid").withColumns({"seed": F.lit(0), "k_chosen": F.lit(None).cast("int")})
    return score(made, series)


def family_diagnostics(families: DataFrame) -> DataFrame:
    """How decisively one form wins: the gap to the second, the best weight, entropy and effective number of forms."""
    w = Window.partitionBy("uid").orderBy("aicc", "family")
    ranked = aggregates.with_weights(families, ["uid"]).withColumn("rn", F.row_number().over(w))
    pick = lambda c, k: F.max(F.when(F.col("rn") == k, F.col(c)))
    out = ranked.groupBy("uid").agg(
        F.count("*").alias("n_families"), pick("method", 1).alias("best_method"), (pick("aicc", 2) - pick("aicc", 1)).alias("delta_aicc_12"),
        pick("weight", 1).alias("w_best"), aggregates.entropy("weight").alias("aicc_entropy"),
    )
    return out.withColumn("n_eff_models", F.exp("aicc_entropy"))


def family_entropy(artifacts: DataFrame) -> DataFrame:
    """How far the members of a series disagree on the form."""
    counted = artifacts.groupBy("uid", "method").count()
    shares = counted.withColumn("p", F.col("count") / F.sum("count").over(Window.partitionBy("uid")))
    out = shares.groupBy("uid").agg(
        F.sum("count").alias("n_members_refit"), F.count("*").alias("n_families"), aggregates.entropy("p").alias("family_entropy"),
        F.max("p").alias("modal_share"), F.max_by("method", F.struct("count", "method")).alias("modal_family"),
    )
    return out.withColumn("n_eff_families", F.exp("family_entropy"))


def ablation(artifacts: DataFrame, series: DataFrame, sizes: list[int], draws: int = 20, seed: int = 0, aggregators: tuple[str, ...] = ("median", "mean", "trimmed")) -> DataFrame:
    """What the original series adds: the first members against random ones, with and without member 0."""
    ship(artifacts.sparkSession)

    def draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for uid, total in zip(frame["uid"], frame["total"]):
                rng, out = bootstrap.series_rng(seed, uid), [(uid, 1, "member0", 0, 0)]
                for n in (min(s, total) for s in sizes):
                    out += [(uid, n, "first", 0, k) for k in range(n)]
                    for arm, low in (("random_no0", 1), ("random_all", 0)):
                        for d in range(draws):
                            out += [(uid, n, arm, d, int(k)) for k in rng.choice(np.arange(low, total), min(n, total - low), replace=False)]
                yield pd.DataFrame(out, columns=["uid", "n", "arm", "draw", "member"]).drop_duplicates()

    drawn = artifacts.groupBy("uid").agg(F.count("*").alias("total")).mapInPandas(draw, "uid string, n int, arm string, draw int, member int")
    rows = drawn.join(artifacts.select("uid", "member", "fc"), ["uid", "member"]).select("uid", "n", "arm", "draw", F.posexplode("fc").alias("step", "value"))
    by = ["uid", "n", "arm", "draw", "step"]
    out = None
    for how in aggregators:
        own = aggregates.combine(rows.where("arm != 'member0'"), by, how).withColumn("aggregator", F.lit(how))
        out = own if out is None else out.unionByName(own)
    alone = rows.where("arm = 'member0'").select(*by, "value").withColumn("aggregator", F.lit("none"))
    packed = out.unionByName(alone).groupBy("uid", "n", "arm", "draw", "aggregator").agg(transforms.pack("value", "step").alias("f"))
    scored = packed.join(series.select("uid", "m", "y_train", "y_test"), "uid").withColumns({
        "s": metrics.array_smape("y_test", "f"), "a": metrics.array_mase("y_test", "f", "y_train", F.col("m"))
    })
    return scored.groupBy("uid", "n", "arm", "aggregator").agg(
        F.avg("s").alias("smape"), F.avg("a").alias("mase"), F.coalesce(F.stddev_samp("s"), F.lit(0.0)).alias("smape_sd"), F.count("*").alias("n_draws")
    )


def ablation_pivot(rows: DataFrame) -> DataFrame:
    wide = rows.where("arm != 'member0'").groupBy("n", "aggregator").pivot("arm", ["first", "random_all", "random_no0"]).agg(F.avg("smape"))
    return wide.withColumn("first_minus_random_no0", F.col("first") - F.col("random_no0"))


def quartiles(frame: DataFrame, by: str, values: list[str]) -> DataFrame:
    """Averages of ``values`` by quarter of the order of ``by``; edges at the linear quantiles of the ranks."""
    ranked = ranks.global_order(frame, by, "uid")
    quarter = F.greatest(F.lit(1), F.ceil((F.col("r") - 1) * 4 / F.lit(max(1, ranked.count() - 1))))
    return ranked.withColumn("q", quarter.cast("int")).groupBy("q").agg(F.count("*").alias("n"), F.avg(by).alias(by), *(F.avg(v).alias(v) for v in values))


PREDICTORS = ("n_families", "family_entropy", "n_eff_families", "modal_share")


def gains(scores: DataFrame, plain: str, **others: str) -> DataFrame:
    """(uid, one column a keyword): how much lower each named strategy's sMAPE is than the plain one's."""
    wide = scores.groupBy("uid").pivot("strategy", [plain, *others.values()]).agg(F.avg("smape")).dropna()
    return wide.select("uid", *((F.col(f"`{plain}`") - F.col(f"`{s}`")).alias(name) for name, s in others.items()))


def instability(entropy: DataFrame, gained: DataFrame, alpha: float = 0.05) -> dict:
    """Does disagreement of the members on a form predict the gain of bagging?

    Rank correlations of every predictor with every gain, all in one pass, averages by
    quarter of the first predictor, and the least correlation that the number of series could show.
    """
    both = cut(entropy.join(gained, "uid"))
    names = [c for c in gained.columns if c != "uid"]
    spread = lambda names, to: F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in names])).alias(to)
    long = both.select("uid", spread(PREDICTORS, "x"), *names).select("uid", "x", spread(names, "y"))
    long = long.select(F.col("x.name").alias("predictor"), F.col("y.name").alias("gain"), F.col("x.value").alias("x"), F.col("y.value").alias("y"))
    found = {(r["predictor"], r["gain"]): r for r in ranks.spearman(long, "x", "y", ("predictor", "gain")).collect()}  # a row a pair of measures
    rows = []
    for key in ((p, g) for p in PREDICTORS for g in names):
        rho, p = (found[key]["rho"], found[key]["p"]) if key in found else (None, 1.0)
        rows.append((*key, rho, p, p < alpha and (rho or 0) > 0))
    total = both.count()
    table = pd.DataFrame(rows, columns=["predictor", "gain", "rho", "p", "supported"])
    return {"n": total, "least_rho": ranktests.least_detectable_rho(total, alpha) if total > 3 else None, "table": table, "quartiles": quartiles(both, PREDICTORS[0], names)}
