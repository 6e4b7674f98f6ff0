import numpy as np
import pytest

from ensemblecast.operators import clustering, engines, ets, ranktests, selection
from ensemblecast.operators.bootstrap import bootstrap_pool


def test_pam_matches_reference_partitions(golden):
    y = np.array(golden["series"]["monthly_N1861"]["y"])
    d = clustering.distances(bootstrap_pool(y, 120, 12, np.random.default_rng(1861)).series)
    for k, labels in golden["pam"]["labels"].items():
        assert ranktests.adjusted_rand(clustering.pam(d, int(k)), np.array(labels)) == pytest.approx(1.0), k
    widths = {int(k): w for k, w in golden["pam"]["silhouette"].items()}
    ours = {k: clustering.silhouette(d, clustering.pam(d, k)) for k in (2, 3, 5, 10, 20, 40, 60)}
    for k, w in ours.items():
        assert w == pytest.approx(widths[k], abs=1e-9), k


def test_blobs():
    rng = np.random.default_rng(7)
    rows = np.vstack([level + rng.normal(size=(15, 20)) for level in (0, 50, 200)])
    truth = np.repeat([0, 1, 2], 15)
    d = clustering.distances(rows)
    for variant in ("pam", "fasterpam"):
        assert ranktests.adjusted_rand(clustering.pam(d, 3, variant), truth) == 1.0
        assert clustering.best_k(d, 2, 10, variant)[0] == 3
    with pytest.raises(ValueError):
        clustering.pam(d, 3, "other")
    with pytest.raises(ValueError):
        clustering.best_k(d[:2, :2], 2, 5)


def test_allocations():
    assert list(selection.allocate_rounded([150, 100, 50], 300, 100)) == [50, 33, 17]
    assert list(selection.allocate_exact([150, 100, 50], 300, 100)) == [50, 33, 17]
    assert selection.allocate_exact([298, 1, 1], 300, 10).tolist() == [8, 1, 1]
    assert selection.allocate_exact([3, 3, 3], 9, 2).sum() == 2


def pool(seed=0, biased=10, good=30, h=12):
    rng = np.random.default_rng(seed)
    actual = 100 + rng.normal(size=h)
    clones = np.tile(actual + 2 + rng.normal(size=h) * 0.1, (biased, 1))
    noisy = actual + rng.normal(size=(good, h)) * 2.2
    forecasts = np.vstack([clones, noisy])
    return selection.Artifacts(forecasts, forecasts, actual, selection.mape(actual, forecasts))


def test_strategies():
    a, rng = pool(), np.random.default_rng(1)
    top, _ = selection.TopK().select(a, 10, rng)
    assert set(top) == set(np.argsort(a.val_errors, kind="stable")[:10]) and (np.diff(top) > 0).all()
    for s in (selection.Greedy("mean"), selection.Greedy("trimmed", "smape"), selection.Portfolio()):
        own, _ = s.select(a, 10, rng)
        assert len(own) == 10 and sum(k < 10 for k in own) <= 4
        mean = a.val_forecasts[own].mean(axis=0)
        assert selection.mape(a.val_actuals, mean) < selection.mape(a.val_actuals, a.val_forecasts[top].mean(axis=0))
    assert len(selection.Greedy(patience=0).select(a, 40, rng)[0]) < 40
    assert list(selection.FirstN(3).select(a, 10, rng)[0]) == [0, 1, 2]
    assert len(selection.FirstN().select(a, 10, rng)[0]) == 40
    assert len(set(selection.Random().select(a, 10, rng)[0])) == 10
    own, k = selection.Clusters(k=4, pool=30).select(a, 10, rng)
    assert k == 4 and len(own) == 10
    assert selection.Clusters(pool=300).select(a, 40, rng)[1] is None
    with pytest.raises(ValueError):
        selection.Clusters(allocation="x").select(a, 5, rng)


def test_portfolio_by_definition():
    """Each pick makes the mean of the team least risky: squared mean bias plus variance of the mean."""
    for seed in range(5):
        a = pool(seed)
        errors = a.val_forecasts - a.val_actuals
        bias, cov = errors.mean(axis=1), selection.shrunk_covariance(errors.T)
        team = []
        for _ in range(12):
            def risk(k):
                own = [*team, k]
                return bias[own].mean() ** 2 + cov[np.ix_(own, own)].sum() / len(own) ** 2

            team.append(min((k for k in range(len(bias)) if k not in team), key=risk))
        assert selection.Portfolio().select(a, 12, None)[0].tolist() == sorted(team)


def test_ranks(golden):
    rows = golden["ranks"]
    control = next(r for r in rows["summary"] if r["strategy"] not in {t["strategy"] for t in rows["stats"]})
    se = np.sqrt(10 * 11 / (6 * 1428))
    z = np.array([(float(t["mean_rank"]) - float(control["rank_smape"])) / se for t in rows["stats"]])
    np.testing.assert_allclose(z, [float(t["z"]) for t in rows["stats"]], rtol=1e-9)
    p = np.array([ranktests.normal_two_sided(v) for v in z])
    np.testing.assert_allclose(ranktests.hochberg(p), [float(t["p_hochberg"]) for t in rows["stats"]], atol=1e-9)


def test_tails():
    assert ranktests.chi2_tail(5.991464547107979, 2) == pytest.approx(0.05, rel=1e-9)
    assert ranktests.chi2_tail(16.918977604620448, 9) == pytest.approx(0.05, rel=1e-9)
    assert ranktests.student_two_sided(2.2281388519649385, 10) == pytest.approx(0.05, rel=1e-9)
    assert ranktests.normal_two_sided(1.959963984540054) == pytest.approx(0.05, rel=1e-9)
    assert ranktests.wilcoxon(np.arange(1.0, 9), np.zeros(8))[1] == pytest.approx(2 / 256)
    assert ranktests.spearman([1, 2, 3, 4, 5], [2, 1, 4, 3, 5])[0] == pytest.approx(0.8)
    assert ranktests.friedman(np.tile([1.0, 2, 3], (10, 1)))[0] == pytest.approx(20)
    rng = np.random.default_rng(0)
    assert ranktests.ks_two_sample(rng.normal(size=500), rng.normal(size=500))[1] > 0.01


def test_smoothing_against_reference(golden):
    gaps, agree = [], []
    for g in golden["series"].values():
        if "ets" not in g:
            continue
        y, want = np.array(g["y"]), np.array(g["ets"]["values"])
        out = engines.ETSEngine(g["m"]).forecast(y[None], len(want))  # as it is shipped
        assert not out.fallback[0]
        agree.append(out.methods[0] == g["ets"]["method"])
        m = 12 if len(y) > 12 else 1
        gaps.append(np.abs(out.mean[0] - want).mean() / np.abs(y[m:] - y[:-m]).mean())
    assert np.median(gaps) <= 0.10 and max(gaps) <= 1.5 and np.mean(agree) >= 0.6


def test_engine_contract():
    y = 100 + 0.4 * np.arange(100) + 12 * np.sin(np.arange(100) * np.pi / 6)
    for engine in (engines.NaiveEngine(12), engines.SeasonalNaiveEngine(12), engines.ETSEngine(12, most=200, starts=1)):
        assert isinstance(engine, engines.Engine)
        one, two = engine.forecast(np.stack([y, 2 * y]), 6, True), engine.forecast(y[None], 6)
        assert one.mean.shape == (2, 6) and np.isfinite(one.mean).all() and one.fitted.shape == (2, 100)
        np.testing.assert_allclose(one.mean[0], two.mean[0], rtol=1e-9)
    zero = engines.ETSEngine(12).forecast(np.zeros((1, 30)), 4)
    assert np.isfinite(zero.mean).all()
    short = engines.ETSEngine(1).forecast(np.array([[1.0, 2.0, 7.0]]), 6)
    assert short.fallback[0] and short.methods == ["naive-fallback"] and (short.mean == 7).all()
    assert ("A", "N", "M") not in ets.FAMILIES and len(ets.FAMILIES) == 15


def test_fit_then_predict():
    """In two steps the same as in one; forms that are given up on the way don't change the best."""
    rng = np.random.default_rng(0)
    y = (100 + np.arange(40.0)) * (1 + 0.2 * np.sin(np.arange(40) * np.pi / 2)) * np.exp(rng.normal(0, 0.05, 40))
    engine = engines.ETSEngine(4)
    fit = engine.fit(y)
    both = engine.forecast(y[None], 6, True)
    np.testing.assert_array_equal(engine.predict(fit, 6), both.mean[0])
    np.testing.assert_array_equal(fit.fitted, both.fitted[0])
    assert fit.method == both.methods[0] == ets.fit_families(y[None], 4)[0][0].method and not fit.fallback
    none = engine.fit(np.array([1.0, np.nan, 3.0]))
    assert none.fallback and (engine.predict(none, 3) == 3).all()
