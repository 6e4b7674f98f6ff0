import numpy as np
import pytest
from pyspark.sql import functions as F

from ensemblecast.functions import aggregates, metrics, transforms
from ensemblecast.operators import selection
from ensemblecast.operators.engines import ETSEngine, build_engine
from ensemblecast.plans import cli, experiment, reports, strategies
from ensemblecast.plans.model import BaggedForecaster
from ensemblecast.sources import series as sources
from ensemblecast.sources import store
from ensemblecast import session
from ensemblecast.streaming import refresh


def long_series():
    rng = np.random.default_rng(5)
    t = np.arange(90)
    return {f"s{k}": (100 + t) * (1 + 0.15 * np.sin(t * np.pi / 6 + k)) * np.exp(rng.normal(0, 0.03, 90)) for k in range(4)}


@pytest.fixture(scope="module")
def series(spark):
    rows = [(u, i + 1, float(v)) for u, y in long_series().items() for i, v in enumerate(y)]
    return sources.from_long(spark.createDataFrame(rows, "uid string, idx int, y double").repartition(3), 12, 18).cache()


@pytest.fixture(scope="module")
def artifacts(series):
    return experiment.stage_a(series, 12, engine="snaive").cache()


def test_packing(series):
    got = {r["uid"]: r for r in series.collect()}
    for u, y in long_series().items():
        assert got[u]["y_train"] == list(y[:72]) and got[u]["y_test"] == list(y[72:])


def test_stage_a(artifacts, series):
    rows = {(r["uid"], r["member"]): r for r in artifacts.collect()}
    for u, y in long_series().items():
        one = rows[u, 0]
        assert np.allclose(one["y"], y[:72])
        want = build_engine("snaive", 12).forecast(np.array([one["y"]])[:, :48], 24).mean[0]
        assert np.allclose(one["val_fc"], want)
        assert one["val_err"] == pytest.approx(float(selection.mape(y[48:72], want)))
    again = experiment.forecasts(experiment.pool(series, 12), "snaive", parts=1)
    assert sorted((r["uid"], r["member"], tuple(r["fc"])) for r in again.collect()) == sorted((u, m, tuple(r["fc"])) for (u, m), r in rows.items())


def test_stage_b(artifacts, series):
    specs = ["original", "none5:trimmed", "topk", "random", "greedy:mean", "portfolio", "cluster-k2", "paper-auto"]
    scores = experiment.stage_b(artifacts, series, specs, 4, (0, 1))
    rows = scores.collect()
    assert len(rows) == 4 * len(specs) * 2 and all(np.isfinite(r["smape"]) and np.isfinite(r["mase"]) for r in rows)
    y = long_series()["s1"]
    flat = artifacts.where("uid = 's1'").orderBy("member").collect()
    best = selection.by_error(np.array([r["val_err"] for r in flat]))[:4]
    point = np.median([flat[k]["fc"] for k in best], axis=0)
    own = next(r for r in rows if r["uid"] == "s1" and r["strategy"] == "topk")
    assert own["smape"] == pytest.approx(float(selection.smape(y[72:], point))) and own["n_members"] == 4
    found = experiment.compare(scores)
    assert 0 <= found["friedman_pvalue"] <= 1 and len(found["table"]) == len(specs) - 1
    with pytest.raises(ValueError):
        experiment.compare(scores, control="nobody")
    with pytest.raises(ValueError):
        experiment.compare(scores.where("not (uid = 's1' and strategy = 'topk')"))


def test_short_series_are_drawn(spark):
    tiny = spark.createDataFrame([("t", 12, 30, 6, [float(v) for v in range(30, 60)], [1.0] * 6)], "uid string, m int, n_train int, h int, y_train array<double>, y_test array<double>")
    tiny = tiny.withColumn("y_train", F.slice("y_train", 1, 26))
    made = experiment.forecasts(experiment.pool(tiny, 6), "naive")
    made = made.withColumn("h_val", F.lit(12)).withColumns({"val_err": F.lit(None).cast("double"), "actual": F.lit(None).cast("array<double>")})
    got = experiment.select(made, [strategies.parse("topk")], 3).collect()
    assert len(got) == 3 and {r["how"] for r in got} == {"fallback_random"}


def test_families_and_ablation(artifacts, series):
    families = experiment.family_table(series, most=60, starts=1).cache()
    diag = experiment.family_diagnostics(families).collect()
    assert len(diag) == 4 and all(1 <= d["n_eff_models"] <= d["n_families"] <= 15 for d in diag)
    names = {r["strategy"] for r in experiment.family_scores(families, series).collect()}
    assert names == {f"top{j}_mean" for j in range(1, 16)} | {"ets_best", "aicc_weighted", "top5_median", "all_median"}
    rows = experiment.ablation(artifacts, series, [2, 4], 3)
    wide = experiment.ablation_pivot(rows).collect()
    assert len(wide) == 6
    assert rows.where("arm = 'member0'").count() == 4


def test_aggregates(spark):
    rows = spark.createDataFrame([("a", float(v)) for v in range(20)] + [("b", 1.0), ("b", 5.0)], "uid string, value double")
    for how, want in (("median", 9.5), ("mean", 9.5), ("trimmed", 9.5), ("max", 19.0), (lambda v: float(np.ptp(v)), 19.0)):
        assert {r["uid"]: r["value"] for r in aggregates.combine(rows, ["uid"], how).collect()}["a"] == want
    with pytest.raises(ValueError):
        aggregates.combine(rows, ["uid"], "other")
    q = aggregates.quantiles(rows, ["uid"], [0.25]).where("uid = 'b'").first()
    assert q["q_25"] == 2.0


def test_metrics_at_zero(spark):
    df = spark.createDataFrame([(0.0, 0.0), (0.0, 1.0)], "y double, f double")
    got = df.select(metrics.smape_term(F.col("y"), F.col("f")).alias("s"), metrics.mape_term(F.col("y"), F.col("f")).alias("m")).collect()
    assert np.isnan(got[0]["s"]) and got[1]["s"] == 200 and np.isnan(got[0]["m"]) and np.isinf(got[1]["m"])


def test_specs():
    assert strategies.parse("greedy:trimmed").strategy.aggregator == "trimmed"
    assert strategies.parse("paper-k5").strategy == selection.Clusters.published(5)
    assert strategies.parse("cluster-5").strategy.k == 5 and strategies.parse("none100").strategy.count == 100
    assert strategies.parse("original").strategy is None
    for bad in ("nonsense", "topk:mode", "cluster-x"):
        with pytest.raises(ValueError):
            strategies.parse(bad)


def test_estimator(spark):
    y = next(iter(long_series().values()))
    made = BaggedForecaster(spark, 12, members=16, n_select=5, selection=selection.TopK(), seed=3, engine="snaive").fit(y)
    out = made.predict(6)
    assert out.ensemble.shape == (5, 6) and out.info["n_members"] == 5
    assert (out.quantile(0.1) <= out.point).all() and (out.quantile([0.1, 0.9]).shape == (2, 6))
    again = BaggedForecaster(spark, 12, members=16, n_select=5, selection=selection.TopK(), seed=3, engine="snaive", parts=1).fit(y).predict(6)
    np.testing.assert_array_equal(again.point, out.point)
    custom = BaggedForecaster(spark, 12, members=6, n_select=3, selection=selection.FirstN(3), aggregator=lambda e: e.max(axis=0), engine="naive").fit(y).predict(2)
    assert (custom.point == custom.ensemble.max(axis=0)).all()
    with pytest.raises(RuntimeError):
        BaggedForecaster(spark, 12).predict(3)
    with pytest.raises(ValueError):
        BaggedForecaster(spark, 12, aggregator="x")
    with pytest.warns(UserWarning):
        short = BaggedForecaster(spark, 1, members=5, n_select=2, engine="naive", seed=2).fit(50 + 2 * np.arange(8.0))
    assert short.info_["selection"] == "fallback_random"


def test_store(spark, tmp_path, artifacts):
    files = store.Store(spark, str(tmp_path / "root"))
    assert not files.exists("x/y.json") and files.keys() == []
    files.put_json("x/y.json", {"a": 1})
    files.put_arrays("arrays", a=np.arange(6.0).reshape(2, 3))
    assert files.get_json("x/y.json") == {"a": 1} and files.exists("x/y.json") and "x/y.json" in files.keys("x")
    assert (files.get_arrays("arrays")["a"] == np.arange(6.0).reshape(2, 3)).all()
    (tmp_path / "f.bin").write_bytes(b"abc")
    files.put_file("f.bin", str(tmp_path / "f.bin"))
    files.get_file("f.bin", str(tmp_path / "g.bin"))
    assert (tmp_path / "g.bin").read_bytes() == b"abc" == files.get_bytes("f.bin")
    key = store.run_key(seed=1, engine="snaive")
    assert key == store.run_key(engine="snaive", seed=1) and len(key) == 10
    half = artifacts.where("uid in ('s0', 's1')")
    store.write_artifacts(half, str(tmp_path / "a"), key)
    done = store.read_artifacts(spark, str(tmp_path / "a"), key)
    assert done.count() == 24
    assert sorted(r["uid"] for r in store.missing(artifacts.select("uid").distinct(), done).collect()) == ["s2", "s3"]
    with pytest.raises(LookupError):
        store.require(artifacts, done)
    store.require(half, done)
    assert [r["uid"] for r in store.every_nth(artifacts.select("uid").distinct(), 2).orderBy("uid").collect()] == ["s0", "s2"]


def test_exports(spark, tmp_path):
    rows = [f"N{k},{i},train,{k * 100 + i}" for k in (1, 2) for i in range(1, 8)]
    (tmp_path / "m3_yearly.csv").write_text("unique_id,idx,split,y\n" + "\n".join(reversed(rows)))
    (tmp_path / "meta.csv").write_text("unique_id,group,m,n_train,h\nN1,yearly,1,5,2\nN2,yearly,1,5,2\nN9,other,1,5,2\n")
    got = sources.load_group(spark, str(tmp_path), "yearly").orderBy("uid").collect()
    assert [r["uid"] for r in got] == ["N1", "N2"] and got[0]["y_train"] == [101, 102, 103, 104, 105] and got[0]["y_test"] == [106, 107]
    assert sources.load_group(spark, str(tmp_path), "yearly", uids=["N2"]).count() == 1
    with pytest.raises(ValueError):
        sources.load_group(spark, str(tmp_path), "weekly")
    with pytest.raises(FileNotFoundError):
        sources.load_group(spark, str(tmp_path), "monthly")


def test_small_functions(spark):
    one = spark.range(1)
    got = one.select(
        transforms.next_odd(F.lit(2.5)).alias("a"), transforms.next_odd(F.lit(3.2)).alias("b"), transforms.default_tail(F.lit(20), F.lit(12)).alias("c"),
        transforms.least_tail(F.lit(12)).alias("d"), transforms.lookback(F.lit(40), F.lit(12)).alias("e"), transforms.lookback(F.lit(20), F.lit(12)).alias("f"),
    ).first()
    assert tuple(got) == (3, 3, 9, 12, 21, None)
    assert isinstance(build_engine("ets", 12), ETSEngine)
    with pytest.raises(ValueError):
        build_engine("x", 12)


def test_stream(spark, tmp_path):
    schema = "ts timestamp, uid string, v double"
    src = tmp_path / "in"
    rows = [(f"2024-01-{d:02d} 05:00:00", u, float(d)) for d in range(1, 11) for u in "ab"]
    frame = spark.createDataFrame(rows, "ts string, uid string, v double").withColumn("ts", F.to_timestamp("ts"))
    frame.coalesce(1).write.parquet(str(src))
    totals = refresh.period_totals(spark.readStream.schema(schema).parquet(str(src)), "ts", "uid", "v", "1 day", "1 day")
    none = spark.createDataFrame([], "uid string, start timestamp, y double")
    q = refresh.refresh(totals, lambda: none, lambda rows: rows.groupBy("uid").agg(F.max_by("y", "start").alias("next")), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    got = {r["uid"]: r["next"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert set(got) == {"a", "b"} and min(got.values()) >= 8


def test_reports(spark, series):
    assert len(sources.synthetic()) == 120
    scores = spark.createDataFrame([("a", "x", 10.0, 1.0), ("b", "x", 12.0, 1.0), ("a", "y", 20.0, 2.0)], "uid string, engine string, smape double, mase double")
    got = reports.engine_summary(scores).collect()
    assert [r["engine"] for r in got] == ["x", "y"] and got[0]["mean_smape"] == 10
    one = reports.calibration(scores.where("engine = 'x'"), 11.2, 0.5).first()
    assert one["passed"] and one["delta"] == pytest.approx(-0.2)
    points = spark.createDataFrame([("c", s, [1.0 * s, 2.0], 10.0 + s) for s in range(3)], "case string, seed int, point array<double>, smape double")
    outside = spark.createDataFrame([("c", [1.0, 2.0], 11.5, 0.2)], "case string, point array<double>, smape double, engine_delta double")
    row = reports.seed_band(points, outside).first()
    assert row["in_band"] and row["counts"] and row["delta"] == pytest.approx(-0.5) and row["rms_between_seeds"] == pytest.approx(2**-0.5)
    fits = series.select("uid", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("member"), "y_train")
    fits = fits.select("uid", "member", F.transform("y_train", lambda v, k: F.when(k == 0, float("nan")).otherwise(v + F.col("member"))).alias("fitted"))
    chosen = fits.where("member > 0").select("uid", "member", F.lit("topk").alias("strategy"), F.lit(0).alias("seed"))
    told = reports.fitted_ensemble(fits, chosen, series).collect()
    assert {(round(r["residual"], 9), r["n"]) for r in told} == {(-1.5, 2)} and {r["idx"] for r in told} == set(range(2, 73))
    assert reports.markdown(scores.orderBy("uid", "engine"), "T").splitlines()[4] == "| a | x | 10.000 | 1.000 |"


def test_commands(spark, tmp_path, capsys):
    rows, meta = [], []
    for u, y in long_series().items():
        rows += [f"{u},{i},{'train' if i < 73 else 'test'},{v}" for i, v in enumerate(y, 1)]
        meta.append(f"{u},monthly,12,72,18")
    (tmp_path / "m3_monthly.csv").write_text("unique_id,idx,split,y\n" + "\n".join(rows))
    (tmp_path / "meta.csv").write_text("unique_id,group,m,n_train,h\n" + "\n".join(meta))
    base = ["--data", str(tmp_path), "--root", str(tmp_path / "runs")]
    small = ["--members", "8", "--n-select", "3", "--strategies", "original,topk,random", "--draws", "2", "--sizes", "2"]
    for engine in ("naive", "snaive"):
        assert cli.main([*base, "precompute", *small, "--engine", engine]) == 0
    before = spark.read.parquet(str(tmp_path / "runs" / "artifacts" / "run_key=*" / "bucket=*" / "part=*")).count()
    cli.main([*base, "precompute", *small, "--engine", "snaive"])  # nothing is left to do
    assert spark.read.parquet(str(tmp_path / "runs" / "artifacts" / "run_key=*" / "bucket=*" / "part=*")).count() == before == 2 * 4 * 8
    for command in ("evaluate", "report", "stats", "ablate"):
        assert cli.main([*base, command, *small, "--engine", "snaive"]) == 0
    for command in ("entropy", "instability", "calibrate"):
        assert cli.main([*base, command, *small, "--engine", "snaive"]) == 0
    assert cli.main([*base, "compare", *small, "--engine", "naive,snaive"]) == 0
    assert cli.main([*base, "entropy", *small, "--engine", "snaive"]) == 0  # nothing is left to do
    assert spark.read.parquet(str(tmp_path / "runs" / "family_entropy-latest")).count() == 4
    assert cli.main([*base, "seeds", *small, "--engine", "snaive", "--eval-seeds", "1", "2"]) == 0
    assert cli.main([*base, "seeds", *small, "--engine", "snaive", "--eval-seeds", "2", "3"]) == 0
    found = spark.read.parquet(str(tmp_path / "runs" / "seeds")).collect()
    assert sorted((r["case"], r["seed"]) for r in found) == [(f"s{k}", seed) for k in range(4) for seed in (1, 2, 3)]
    assert all(len(r["point"]) == 18 and r["variant"] == "k5" and r["n_members"] for r in found)
    out = capsys.readouterr().out
    assert "friedman_pvalue" in out and "differ by" in out
    with pytest.raises(LookupError, match="there are"):
        cli.main([*base, "evaluate", *small, "--engine", "ets"])


def test_instability(spark):
    rows = [(f"u{k:02d}", k, 0.1 * k, 1.0 + k, 1.0 / (k + 1)) for k in range(20)]
    e = spark.createDataFrame(rows, "uid string, n_families int, family_entropy double, n_eff_families double, modal_share double")
    scores = spark.createDataFrame([(f"u{k:02d}", s, v) for k in range(20) for s, v in (("original", 20.0), ("bag", 20.0 - k * k))], "uid string, strategy string, smape double")
    found = experiment.instability(e, experiment.gains(scores, "original", gain="bag"))
    first = found["table"].iloc[0]
    assert first["rho"] == pytest.approx(1) and first["supported"] and not found["table"].iloc[3]["supported"]
    assert [r["n"] for r in found["quartiles"].orderBy("q").collect()] == [5, 5, 5, 5]


def test_errors_that_are_no_numbers_come_last(spark):
    """A NaN error ranks its member last; the other members are chosen as before."""
    errors = [3.0, float("nan"), 1.0, 4.0, 2.0, 5.0]
    rows = [("s", 4, 2, 2, k, [float(k + t) for t in range(8)], [10.0 + k, 11.0], e, [10.0, 11.0]) for k, e in enumerate(errors)]
    pool = spark.createDataFrame(rows, "uid string, m int, h int, h_val int, member int, y array<double>, val_fc array<double>, val_err double, actual array<double>")
    specs = [experiment.parse(t) for t in ("topk", "greedy", "portfolio", "cluster-k2")]
    got = {}
    for r in experiment.select(pool, specs, 3).collect():
        assert r["how"] == "selected"
        got.setdefault(r["strategy"], []).append(r["member"])
    assert sorted(got["topk"]) == [0, 2, 4]
    assert all(len(v) == len(set(v)) for v in got.values())
    five = experiment.select(pool, [experiment.parse("topk")], 6).collect()
    assert sorted(r["member"] for r in five) == list(range(6))


def test_replayed_batches_count_once(spark, tmp_path):
    steps = []

    class Writer:
        outputMode = foreachBatch = option = start = lambda self, *a, **k: steps.append(a[0]) if a and callable(a[0]) else self

    class Totals:
        writeStream = Writer()

    Writer.foreachBatch = lambda self, f: steps.append(f) or self
    none = spark.createDataFrame([], "uid string, y double")
    refresh.refresh(Totals(), lambda: none, lambda rows: rows, str(tmp_path / "out"), "cp")
    batch = spark.createDataFrame([("a", 1.0)], "uid string, y double")
    for number in (0, 0, 1):
        steps[0](batch, number)
    assert sorted(r["batch"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [0, 1]


def test_clusters_need_a_shared_folder(tmp_path):
    class Conf:
        named = None

        def get(self, key, default=None):
            return self.named

    class Dir:
        isEmpty = lambda self: True

    class Context:
        master = "spark://host:7077"
        _jsc = type("J", (), {"sc": lambda self: type("S", (), {"getCheckpointDir": lambda self: Dir()})()})()

    fake = type("Session", (), {"conf": Conf(), "sparkContext": Context()})()
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_folder(fake)
    Conf.named = str(tmp_path)
    assert session.shared_folder(fake) == str(tmp_path)


def test_cuts_can_be_forgotten(spark):
    made = session.cut(spark.range(5))
    assert made.count() == 5 and session.forget(spark) >= 1 and session.forget(spark) == 0
    with pytest.raises(Exception, match="PATH_NOT_FOUND|FILE_NOT_EXIST|does not exist"):
        made.sparkSession.catalog.clearCache()
        made.count()


def test_outside_gates(spark):
    """Cases that can run, and the gates over cases, by hand."""
    cases = spark.createDataFrame([("a", 12, 18, 49), ("b", 12, 18, 48), ("c", 1, 6, 21), ("synthetic_ar1", 1, 6, 90)], "uid string, m int, h int, n_train int")
    got = sorted((r["uid"], r["variant"]) for r in reports.runnable_cases(cases, ("c",)).collect())
    assert got == [("a", "k5"), ("c", "auto"), ("c", "k5")]
    schema = "case string, counts boolean, in_band boolean, delta double, sd_smape double, engine_delta double"
    rows = [("a", True, True, 0.1, 0.1, 0.2), ("b", True, False, 0.9, 0.1, 0.1), ("c", False, False, 3.0, 0.1, -2.0)]
    one = reports.gates(spark.createDataFrame(rows, schema)).first()
    assert one["g1"] and one["g2"] and one["attributed"] and one["passed"] and one["n_counting"] == 2 and one["mean_delta"] == pytest.approx(0.5)
    worse = rows[:1] + [("b", True, False, 1.6, 0.1, 0.1), ("d", True, False, 0.0, 0.1, 0.1), ("c", False, False, 3.6, 0.1, 2.0)]
    two = reports.gates(spark.createDataFrame(worse, schema)).first()
    assert not (two["g1"] or two["g2"] or two["attributed"] or two["passed"])
    left = spark.createDataFrame([("x", "a", 2.0), ("y", "a", 3.0), ("x", "b", 1.0)], "uid string, strategy string, smape double")
    won = experiment.win_rate(left, "a", "b").first()
    assert (won["n"], won["win_rate"], won["mean_a"], won["mean_b"]) == (2, 0.5, 2.5, 1.0)
    assert experiment.require_agreement(left.where("strategy = 'a'"), left.where("strategy = 'a'")) == 0
    with pytest.raises(ValueError, match="disagree"):
        experiment.require_agreement(left.where("strategy = 'a'"), left.where("strategy = 'b'"))
