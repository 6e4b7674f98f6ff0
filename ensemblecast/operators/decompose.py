"""Trend, seasonal and remainder: periodic STL for seasonal series, a loess trend otherwise."""

from __future__ import annotations

import math

import numpy as np


def next_odd(x: float) -> int:
    """The nearest integer (halves to even), raised to an odd one."""
    r = round(x)
    return int(r) + (r % 2 == 0)


def _tricube(distance: np.ndarray, h: np.ndarray) -> np.ndarray:
    with np.errstate(all="ignore"):
        w = (1 - (distance / h) ** 3) ** 3
    return np.where(distance <= 0.001 * h, 1.0, np.where(distance <= 0.999 * h, w, 0.0))


def _loess_at(y: np.ndarray, at: np.ndarray, left: np.ndarray, right: np.ndarray, window: int, degree: int) -> np.ndarray:
    """Local fits at points ``at`` (positions from 1) over positions left..right; NaN without weight."""
    n = len(y)
    j = np.arange(1, n + 1.0)
    at = np.asarray(at, float)[:, None]
    h = np.maximum(at[:, 0] - left, right - at[:, 0])[:, None] + ((window - n) // 2 if window > n else 0)
    inside = (j >= np.asarray(left)[:, None]) & (j <= np.asarray(right)[:, None])
    w = _tricube(np.abs(j - at), h) * inside
    total = w.sum(axis=1, keepdims=True)
    with np.errstate(all="ignore"):
        w = w / total
        if degree:
            centre = (w * j).sum(axis=1, keepdims=True)
            spread = (w * (j - centre) ** 2).sum(axis=1, keepdims=True)
            slope = np.where(np.sqrt(spread) > 0.001 * (n - 1), (at - centre) / spread, 0.0)
            w = np.where(h > 0, w * (slope * (j - centre) + 1), w)
    return np.where(total[:, 0] > 0, w @ y, np.nan)


def _loess(y: np.ndarray, window: int, degree: int, jump: int) -> np.ndarray:
    """Fits at every ``jump``-th position, lines in between."""
    n = len(y)
    if n < 2:
        return y.copy()
    jump = min(jump, n - 1)
    at = np.arange(1, n + 1, jump)
    if at[-1] != n:
        at = np.append(at, n)
    if window >= n:
        left, right = np.ones(len(at)), np.full(len(at), float(n))
    else:
        left = np.clip(at - (window + 1) // 2 + 1, 1, n - window + 1).astype(float)
        right = left + window - 1
    fit = _loess_at(y, at, left, right, window, degree)
    fit = np.where(np.isnan(fit), y[at - 1], fit)
    return fit if jump == 1 else np.interp(np.arange(1, n + 1), at, fit)


def _seasonal(y: np.ndarray, period: int, window: int, jump: int) -> np.ndarray:
    """Each cycle position's sub-series smoothed, with one value more at both ends."""
    out = np.empty(len(y) + 2 * period)
    for p in range(period):
        own = y[p::period]
        k = len(own)
        ends = _loess_at(own, np.array([0, k + 1]), np.array([1, max(1, k - window + 1)]), np.array([min(window, k), k]), window, 0)
        mid = _loess(own, window, 0, jump)
        ends = np.where(np.isnan(ends), [mid[0], mid[-1]], ends)
        out[p::period] = np.concatenate([[ends[0]], mid, [ends[1]]])
    return out


def _moving(x: np.ndarray, k: int) -> np.ndarray:
    s = np.concatenate([[0.0], np.cumsum(x)])
    return (s[k:] - s[:-k]) / k


def stl(x: np.ndarray, period: int) -> tuple[np.ndarray, np.ndarray]:
    """Trend and raw seasonal of a non-robust STL with a window that spans all cycles, two inner passes."""
    n = len(x)
    s_window = 10 * n + 1
    t_window = next_odd(math.ceil(1.5 * period / (1 - 1.5 / s_window)))
    l_window = next_odd(period)
    jumps = [math.ceil(w / 10) for w in (s_window, t_window, l_window)]
    trend = np.zeros(n)
    for _ in range(2):
        cycles = _seasonal(x - trend, period, s_window, jumps[0])
        low = _loess(_moving(_moving(_moving(cycles, period), period), 3), l_window, 1, jumps[2])
        seasonal = cycles[period : period + n] - low
        trend = _loess(x - seasonal, t_window, 1, jumps[1])
    return trend, seasonal


def lowess(x: np.ndarray, frac: float) -> np.ndarray:
    """Local lines over the nearest ``frac * n`` points, at every point, without robustness passes."""
    n = len(x)
    k = max(2, int(frac * n + 1e-10))
    t = np.arange(n)
    # of the windows of k points around t, the one whose farther end is nearest; the earlier one in a tie
    starts = np.clip(t[:, None] + np.arange(-k + 1, 1), 0, n - k)
    far = np.maximum(t[:, None] - starts, starts + k - 1 - t[:, None])
    left = starts[t, far.argmin(axis=1)]
    j = np.arange(n)
    inside = (j >= left[:, None]) & (j < left[:, None] + k)
    distance = np.abs(j - t[:, None]).astype(float)
    h = np.where(inside, distance, 0).max(axis=1, keepdims=True)
    w = _tricube(distance, h) * inside
    w /= w.sum(axis=1, keepdims=True)
    centre = (w * j).sum(axis=1, keepdims=True)
    spread = (w * (j - centre) ** 2).sum(axis=1, keepdims=True)
    with np.errstate(all="ignore"):
        slope = np.where(np.sqrt(spread) > 0.001 * (n - 1), (t[:, None] - centre) / spread, 0.0)
    return (w * (1 + slope * (j - centre))) @ np.asarray(x, float)


def decompose(x: np.ndarray, season_length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(trend, seasonal, remainder), which add up to ``x``; the seasonal is the same in every cycle."""
    x = np.asarray(x, float)
    if season_length <= 1:
        trend, seasonal = lowess(x, min(1.0, 6.0 / len(x))), np.zeros(len(x))
        return trend, seasonal, x - trend
    if len(x) <= 2 * season_length:
        raise ValueError(f"{len(x)} points are not over two seasons of {season_length}")
    trend, raw = stl(x, season_length)
    position = np.arange(len(x)) % season_length
    seasonal = (np.bincount(position, raw) / np.bincount(position))[position]
    return trend, seasonal, x - trend - seasonal
