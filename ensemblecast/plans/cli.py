"""``python -m ensemblecast.plans.cli <command>``: precompute, evaluate, report, stats, families, entropy, ablate, instability, calibrate, compare,
seeds."""

from __future__ import annotations

import argparse

from pyspark.sql import functions as F

from ensemblecast.functions import ranks
from ensemblecast.plans import experiment, reports
from ensemblecast.session import forget, local_session
from ensemblecast.sources import series as sources
from ensemblecast.sources import store
from ensemblecast.sources.ledger import Ledger

#: Waves of tasks that fill a bucket.
WAVES = 4
DEFAULT_STRATEGIES = "original,none100:mean,none100:trimmed,topk,random,greedy,portfolio,cluster-k5,cluster-auto,paper-k5"


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(description=__doc__)
    top.add_argument("--data", default="data/m3")
    top.add_argument("--root", default="data/runs")
    commands = top.add_subparsers(dest="command", required=True)
    for name in ("precompute", "evaluate", "report", "stats", "families", "entropy", "ablate", "instability", "calibrate", "compare", "seeds"):
        p = commands.add_parser(name)
        p.add_argument("--group", default="monthly")
        p.add_argument("--members", type=int, default=1000)
        p.add_argument("--seed", type=int, default=42)
        p.add_argument("--engine", default="ets", help="ets, naive, snaive; several for compare")
        p.add_argument("--limit", type=int)
        p.add_argument("--uids", nargs="*")
        p.add_argument("--run-id", default="latest")
        p.add_argument("--run-key", help="of the artifacts; by default that of group, members, seed and engine")
        p.add_argument("--buckets", type=int, help="parts of a long run that are committed one by one; by default as many as its fits need")
        p.add_argument("--strategies", default=DEFAULT_STRATEGIES)
        p.add_argument("--n-select", type=int, default=100)
        p.add_argument("--eval-seeds", type=int, nargs="*", default=[0])
        p.add_argument("--metric", default="smape")
        p.add_argument("--control")
        p.add_argument("--sizes", default="10,25,50,100")
        p.add_argument("--draws", type=int, default=20)
        p.add_argument("--anchor", type=float, default=14.135, help="published mean sMAPE, for calibrate")
        p.add_argument("--gate", type=float, default=0.5)
    return top


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = local_session()
    series = sources.load_group(spark, args.data, args.group, args.uids, args.limit).cache()
    keyed = lambda engine: store.run_key(group=args.group, members=args.members, seed=args.seed, engine=engine)
    files, scores, entropy = store.Store(spark, args.root), f"{args.root}/scores/{args.run_id}", f"{args.root}/family_entropy-{args.run_id}"
    fits = series.count() * args.members
    buckets = args.buckets or max(1, -(-fits // (WAVES * experiment.MEMBERS_A_TASK * spark.sparkContext.defaultParallelism)))
    ledger = lambda name, key: Ledger(spark, args.root, name, key, buckets)
    artifacts = lambda engine=args.engine: store.widen(ledger("artifacts", store.locate(files, args.run_key or keyed(engine))).read())
    if args.command == "precompute":
        files.put_json(f"manifests/{keyed(args.engine)}.json", {"group": args.group, "members": args.members, "seed": args.seed, "engine": args.engine})
        ledger("artifacts", keyed(args.engine)).run(series, lambda own: store.narrow(experiment.stage_a(own, args.members, args.seed, args.engine)))
    elif args.command == "evaluate":
        done = artifacts()
        store.require(series, done)
        experiment.stage_b(done, series, args.strategies.split(","), args.n_select, tuple(args.eval_seeds)).write.mode("overwrite").parquet(scores)
        ranks.summary(spark.read.parquet(scores)).coalesce(1).write.mode("overwrite").csv(f"{scores}-summary", header=True)
    elif args.command == "report":
        ranks.summary(spark.read.parquet(scores)).show(100, False)
    elif args.command == "stats":
        found = experiment.compare(spark.read.parquet(scores), args.metric, args.control)
        print({k: v for k, v in found.items() if k != "table"})
        print(found["table"].to_string(index=False))
    elif args.command == "families":
        forms = ledger("families", store.run_key(group=args.group))
        forms.run(series, experiment.family_table)
        families = forms.read().join(series.select("uid"), "uid", "left_semi")
        experiment.family_diagnostics(families).write.mode("overwrite").parquet(f"{args.root}/family_diagnostics")
        experiment.family_scores(families, series).write.mode("overwrite").parquet(scores)
    elif args.command == "entropy":
        done = artifacts()
        agreed = ledger("family_entropy", args.run_key or keyed(args.engine))
        agreed.run(done.select("uid").distinct(), lambda own: experiment.family_entropy(done.join(own, "uid", "left_semi")))
        agreed.read().write.mode("overwrite").parquet(entropy)
    elif args.command == "instability":
        specs, made = args.strategies.split(","), spark.read.parquet(scores)
        if files.exists("ablation") and not made.where("strategy = 'original'").isEmpty():
            # member 0 alone and the plain strategy are one forecast, however they were computed
            alone = spark.read.parquet(f"{args.root}/ablation").where("arm = 'member0'")
            plain = made.where("strategy = 'original'").groupBy("uid").agg(F.avg("smape").alias("smape"))
            print(f"member 0 and the plain strategy differ by {experiment.require_agreement(alone, plain):.1e} at most")
        gained = experiment.gains(made, specs[0], **{f"gain_{i}": s for i, s in enumerate(specs[1:], 1)})
        found = experiment.instability(spark.read.parquet(entropy), gained)
        print(f"n = {found['n']}, least rho at 80 % power: {found['least_rho']}")
        print(found["table"].to_string(index=False))
        found["quartiles"].orderBy("q").show()
    elif args.command == "calibrate":
        done = artifacts()
        fallback = done.where("member = 0").select("uid", "fallback")
        plain = experiment.stage_b(done, series, ["original"]).join(fallback, "uid")
        print(reports.markdown(reports.calibration(plain, args.anchor, args.gate, F.col("fallback")), "Calibration"))
    elif args.command == "ablate":
        done = artifacts()
        rows = experiment.ablation(done, series, [int(s) for s in args.sizes.split(",")], args.draws, args.seed)
        rows.write.mode("overwrite").parquet(f"{args.root}/ablation")
        experiment.ablation_pivot(spark.read.parquet(f"{args.root}/ablation")).show(100, False)
    elif args.command == "compare":
        arms, strategy = args.engine.split(","), args.strategies.split(",")[0]
        made = None
        for engine in arms:
            own = experiment.stage_b(artifacts(engine), series, [strategy], 10**9).withColumn("strategy", F.lit(engine))
            made = own if made is None else made.unionByName(own)
        matched = made.groupBy("uid").agg(F.count_distinct("strategy").alias("k")).where(F.col("k") == len(arms)).select("uid")
        made = made.join(matched, "uid", "left_semi").cache()
        ranks.summary(made).show(100, False)
        if len(arms) > 2:
            print(experiment.compare(made, args.metric, args.control))
        else:
            experiment.paired_tests(made, arms[0], args.metric).show(truncate=False)
            experiment.win_rate(made, arms[0], arms[1], args.metric).show()
    else:  # seeds
        lengths = series.select("uid", "m", "h", F.size("y_train").alias("n_train"))
        rows = reports.seed_runs(series, reports.runnable_cases(lengths), args.eval_seeds, f"{args.root}/seeds", args.members, args.n_select, args.engine)
        rows.groupBy("case", "variant").agg(F.count("*").alias("seeds"), F.avg("smape").alias("mean_smape"), F.stddev("smape").alias("sd_smape")).orderBy("case", "variant").show(100, False)
    forget(spark)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
