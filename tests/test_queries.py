"""Every registered query runs; those with SQL give the same rows as DuckDB."""

import math
import os

import duckdb
import numpy as np
import pytest

from ensemblecast.plans import catalogue

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events embeddings".split()


def rows(found, columns):
    def plain(v):
        if v is None:
            return "~"
        if isinstance(v, float):
            return "nan" if math.isnan(v) else f"{v:.4f}" if abs(v) < 1e7 else f"{v:.1f}"
        return str(v)

    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted([plain(r[k]) for k in order] for r in found)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    return con


def by_uid(rows):
    out = {}
    for r in rows:
        out.setdefault(r["uid"], []).append(r)
    return out


def series(duck):
    out = {}
    for uid, y in duck.sql(f"{catalogue.MONTHLY} select uid, y from s order by uid, idx").fetchall():
        out.setdefault(uid, []).append(float(y))
    return out


def components(rows, duck):
    """Parts add up to the logarithm, seasons to almost nothing over a cycle, and the trend is smoother than the series."""
    ys = series(duck)
    for uid, own in by_uid(rows).items():
        own.sort(key=lambda r: r["idx"])
        log = np.log(ys[uid][: len(own)])
        np.testing.assert_allclose([r["trend"] + r["seasonal"] + r["remainder"] for r in own], log, rtol=1e-9)
        season, trend = np.array([r["seasonal"] for r in own]), np.array([r["trend"] for r in own])
        assert abs(season[:12].mean()) < 0.1 * log.std() + 1e-6 and np.abs(np.diff(trend)).mean() < np.abs(np.diff(log)).mean()


def smooth(rows, duck):
    assert all(np.isfinite(v) for r in rows for v in r if isinstance(v, float)) and len(rows) == sum(len(y) - catalogue.H for y in series(duck).values())


def exponents(rows, duck):
    """No exponent of a grid gives a clearly steadier ratio of spread to level over the blocks of a season."""
    def unsteady(y, lam):
        n = len(y) // 12
        blocks = np.array(y[len(y) - n * 12 :]).reshape(n, 12)
        ratio = blocks.std(axis=1, ddof=1) / blocks.mean(axis=1) ** (1 - lam)
        return ratio.std(ddof=1) / ratio.mean()

    for r in rows:
        lam = next(v for v in r if isinstance(v, float))
        y = series(duck)[r["uid"]][: -catalogue.H]
        assert -1 <= lam <= 2 and unsteady(y, lam) <= min(unsteady(y, g) for g in np.linspace(0, 1, 101)) + 0.01


def replicas(rows, duck):
    ys = series(duck)
    for uid, own in by_uid(rows).items():
        assert sorted(r["member"] for r in own) == list(range(catalogue.MEMBERS))
        assert next(r["total"] for r in own if r["member"] == 0) == pytest.approx(sum(ys[uid][: -catalogue.H]))
        assert len({r["total"] for r in own}) == catalogue.MEMBERS


def paths(rows, duck):
    """Whole horizons, and no worse than twice the error of repeating the last season."""
    ys = series(duck)
    for uid, own in by_uid(rows).items():
        own.sort(key=lambda r: r["step"])
        point, past, truth = np.array([r["value"] for r in own]), np.array(ys[uid][: -catalogue.H]), np.array(ys[uid][-catalogue.H :])
        assert len(point) == catalogue.H and np.isfinite(point).all() and not own[0]["fallback"]
        assert np.abs(point - truth).mean() <= 2 * np.abs(past[-12 + np.arange(catalogue.H) % 12] - truth).mean()


def scored(*strategies):
    def check(rows, duck):
        for own in by_uid(rows).values():
            assert set(strategies) <= {r["strategy"] for r in own}
            assert all(0 <= r["smape"] <= 200 and r["mase"] >= 0 and r["n_members"] >= 1 for r in own)
            assert all(r["n_members"] == 1 for r in own if r["strategy"] == "original")

    return check


def clusters(rows, duck):
    for own in by_uid(rows).values():
        assert len(own) == 60 and {r["label"] for r in own} == set(range(own[0]["k"])) and 2 <= own[0]["k"] <= 10


def decisive(rows, duck):
    assert all(1 <= r["n_families"] <= 15 and 0 < r["w_best"] <= 1 and r["delta_aicc_12"] >= 0 and 1 <= r["n_eff_models"] <= r["n_families"] + 1e-9 for r in rows)


def ablated(rows, duck):
    assert all(r["first_minus_random_no0"] == pytest.approx(r["first"] - r["random_no0"]) for r in rows) and {r["n"] for r in rows} == {5, 10}


#: What must hold of queries that SQL can't express.
CONTRACTS = {
    "stl_components": components, "lowess_trend": smooth, "guerrero_exponent": exponents, "bootstrap_members": replicas, "ets_forecast": paths,
    "family_averaging": scored("ets_best", "top1_mean", "top15_mean", "aicc_weighted", "all_median", "top5_median"), "pam_labels": clusters,
    "greedy_selection": scored("greedy", "greedy:trimmed", "greedy:mean"), "portfolio_selection": scored("portfolio", "portfolio:mean"),
    "strategy_sweep": scored("original", "none", "topk", "random", "greedy", "portfolio", "cluster-k3", "cluster-auto", "paper-k3"),
    "bagged_pipeline": scored("original", "none:trimmed", "topk", "cluster-k3"), "member0_ablation": ablated, "family_diagnostics": decisive,
}


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, DATA)
    got = df.collect()
    if name not in catalogue.SQL:
        assert got
        CONTRACTS[name](got, duck)
        return
    rel = duck.sql(catalogue.SQL[name])
    want = rel.fetchall()
    assert sorted(df.columns) == sorted(rel.columns)
    assert rows(got, df.columns) == rows(want, rel.columns)


def test_whole_tables(spark, duck):
    """Nothing is left out by id: every vector, every engine and every pair of members."""
    n = dict(duck.sql("select label, count(*) from embeddings group by label").fetchall())
    got = {r["label"]: r["n"] for r in catalogue.QUERIES["silhouette_given_labels"](spark, DATA).collect()}
    assert got == n
    assert {r["engine"] for r in catalogue.QUERIES["engine_summary"](spark, DATA).collect()} == {"naive", "seasonal", "mean", "year"}
    pairs = catalogue.QUERIES["pair_rms"](spark, DATA).groupBy("uid").count().collect()
    assert {r["count"] for r in pairs} == {catalogue.MEMBERS * (catalogue.MEMBERS - 1) // 2}


def test_silhouette_by_blocks(spark, duck, monkeypatch):
    monkeypatch.setattr(catalogue, "_VECTORS", 60)
    got = catalogue.QUERIES["silhouette_given_labels"](spark, DATA)
    assert rows(got.collect(), got.columns) == rows(duck.sql(catalogue.SQL["silhouette_given_labels"]).fetchall(), got.columns)


@pytest.mark.parametrize("name, step", [("ets_forecast", "forecasts"), ("family_averaging", "family_table"), ("family_diagnostics", "family_table"), ("bagged_pipeline", "stage_a")])
def test_whole_searches(spark, monkeypatch, name, step):
    """Registered queries search with the operators' defaults."""
    found = {}

    class Seen(Exception):
        pass

    def seen(*_, **knobs):
        found.update(knobs)
        raise Seen

    monkeypatch.setattr(catalogue.experiment, step, seen)
    with pytest.raises(Seen):
        catalogue.QUERIES[name](spark, DATA)
    assert not {"most", "starts", "max_epochs", "width"} & found.keys()
