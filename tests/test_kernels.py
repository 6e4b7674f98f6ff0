"""Numpy kernels against values from an independent implementation."""

import numpy as np
import pytest

from ensemblecast.operators import boxcox, decompose
from ensemblecast.operators.bootstrap import after_pool, bootstrap_range, block_bootstrap, bootstrap_pool, series_rng


def test_exponents(golden):
    for sid, g in golden["series"].items():
        assert boxcox.guerrero_lambda(np.array(g["y"]), g["m"]) == pytest.approx(g["lambda"], abs=1e-3), sid


def test_transform(golden):
    for g in golden["series"].values():
        y = np.array(g["y"])
        x = boxcox.boxcox(y, g["lambda"])
        np.testing.assert_allclose(x, g["x_bc"], rtol=1e-9)
        np.testing.assert_allclose(boxcox.inv_boxcox(x, g["lambda"])[0], y, rtol=1e-9)


def test_components(golden):
    for sid, g in golden["series"].items():
        x = np.array(g["x_bc"])
        trend, seasonal, rest = decompose.decompose(x, g["m"])
        np.testing.assert_allclose(trend + seasonal + rest, x, rtol=1e-12)
        if g["m"] > 1:
            assert np.abs(trend - g["trend"]).max() <= 1e-9 * x.std(), sid
            assert np.abs(seasonal - g["seasonal"]).max() <= 1e-9 * x.std(), sid
        else:
            assert np.abs(trend - g["trend"]).max() <= 1e-3 * x.std(), sid
            assert np.corrcoef(rest, g["remainder"])[0, 1] >= 0.999


def test_short_series():
    with pytest.raises(ValueError):
        decompose.decompose(np.arange(24.0), 12)
    assert boxcox.guerrero_lambda(np.arange(1.0, 20), 12) == 1.0


def test_pool():
    y = (120 + 2 * np.arange(144.0)) * (1 + 0.25 * np.sin(np.arange(144) / 12 * 2 * np.pi))
    y *= np.exp(np.random.default_rng(0).normal(0, 0.03, 144))
    pool = bootstrap_pool(y, 20, 12, series_rng(1, "a"))
    assert pool.series.shape == (20, 144) and (pool.series[0] == y).all() and (pool.series > 0).all()
    assert (bootstrap_pool(y, 20, 12, series_rng(1, "a")).series == pool.series).all()
    assert (bootstrap_pool(y, 20, 12, series_rng(1, "b")).series != pool.series).any()
    x = np.arange(100.0)
    drawn = block_bootstrap(x, 8, np.random.default_rng(0))
    assert len(drawn) == 100 and (np.diff(drawn) == 1).mean() > 0.8
    with pytest.raises(ValueError):
        bootstrap_pool(np.array([1.0, np.nan, 2.0]), 5, 1, series_rng(1, "a"))
    with pytest.raises(ValueError):
        block_bootstrap(x[:5], 8, np.random.default_rng(0))
    assert boxcox.inv_boxcox(np.array([-5.0, 1.0]), 0.5)[1] == 1


@pytest.mark.parametrize("span", [1, 7, 19, 50])
def test_ranges_equal_the_pool(span):
    y = (120 + 2 * np.arange(144.0)) * (1 + 0.25 * np.sin(np.arange(144) / 12 * 2 * np.pi))
    whole = bootstrap_pool(y, 20, 12, series_rng(1, "a"))
    parts = [bootstrap_range(y, 20, 12, series_rng(1, "a"), low, low + span) for low in range(0, 20, span)]
    np.testing.assert_array_equal(np.vstack([p.series for p in parts]), whole.series)
    np.testing.assert_array_equal(np.concatenate([p.clipped for p in parts]), whole.clipped)
    used = series_rng(1, "a")
    bootstrap_pool(y, 20, 12, used)
    assert after_pool(144, 20, 12, series_rng(1, "a")).bit_generator.state == used.bit_generator.state
