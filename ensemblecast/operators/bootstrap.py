"""Replicates of a series: resampled blocks of its remainder on its own trend and seasonal."""

from __future__ import annotations

import zlib
from typing import NamedTuple

import numpy as np

from ensemblecast.operators.boxcox import boxcox, guerrero_lambda, inv_boxcox
from ensemblecast.operators.decompose import decompose


class Pool(NamedTuple):
    series: np.ndarray  # members x points; the first of a whole pool is the original
    lam: float
    clipped: np.ndarray  # how many points of each member had to be clipped


def series_rng(seed: int, uid: str) -> np.random.Generator:
    """A stream that depends on the seed and the series only, whatever the order or the partitions."""
    return np.random.default_rng((seed, zlib.crc32(uid.encode())))


def strategy_rng(seed: int, uid: str, label: str) -> np.random.Generator:
    return np.random.default_rng((seed, zlib.crc32(uid.encode()), zlib.crc32(label.encode())))


def _draw(n: int, block: int, rng: np.random.Generator) -> tuple[np.ndarray, int]:
    """The random numbers of one replica: where its blocks start, and the offset into the first."""
    return rng.integers(0, n - block + 1, size=n // block + 2), int(rng.integers(0, block))


def block_bootstrap(x: np.ndarray, block: int, rng: np.random.Generator) -> np.ndarray:
    """Blocks from random places, joined, from a random offset on."""
    x = np.asarray(x, float)
    n = len(x)
    if n < block:
        raise ValueError(f"{n} points hold no block of {block}")
    starts, offset = _draw(n, block, rng)
    return x[(starts[:, None] + np.arange(block)).ravel()[offset : offset + n]]


def block_length(season_length: int) -> int:
    return 2 * season_length if season_length > 1 else 8


def bootstrap_range(x: np.ndarray, members: int, season_length: int, rng: np.random.Generator, low: int, high: int, block: int | None = None) -> Pool:
    """The members from ``low`` to ``high`` - 1 of a pool of ``members`` series.

    All of the stream is drawn, whoever builds what, so ranges built apart equal the pool built at once, bit by bit.
    """
    x = np.asarray(x, float)
    if x.ndim != 1:
        raise ValueError("a series has one dimension")
    if not np.isfinite(x).all():
        raise ValueError("a series has finite values only")
    if members < 1:
        raise ValueError("a pool has one member at least")
    if members == 1:
        return Pool(x[None, :].copy(), 1.0, np.zeros(1, int))
    n, block = len(x), block or block_length(season_length)
    lam = guerrero_lambda(x, season_length)
    trend, seasonal, remainder = decompose(boxcox(x, lam), season_length)
    if n < block:
        raise ValueError(f"{n} points hold no block of {block}")
    rows, clipped = ([x], [0]) if low == 0 else ([], [])
    for k in range(1, min(high, members)):
        if k < low:
            _draw(n, block, rng)
            continue
        replica, cut_off = inv_boxcox(trend + seasonal + block_bootstrap(remainder, block, rng), lam)
        rows.append(replica)
        clipped.append(cut_off)
    return Pool(np.array(rows).reshape(len(rows), n), lam, np.array(clipped, int))


def bootstrap_pool(x: np.ndarray, members: int, season_length: int, rng: np.random.Generator, block: int | None = None) -> Pool:
    """``members`` series, the original first; one exponent and one decomposition serve all."""
    return bootstrap_range(x, members, season_length, rng, 0, members, block)


def after_pool(n: int, members: int, season_length: int, rng: np.random.Generator, block: int | None = None) -> np.random.Generator:
    """The stream as a pool of a series of ``n`` points leaves it."""
    for _ in range(members - 1):
        _draw(n, block or block_length(season_length), rng)
    return rng
