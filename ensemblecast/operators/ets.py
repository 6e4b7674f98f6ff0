"""Automatic exponential smoothing, fitted for many series at once.

A *lane* is one series under one model form. All lanes of a seasonal type run through time together, and a
batched Nelder-Mead search moves every lane's simplex in step; lanes that have settled drop out. The form with
the least AICc wins a series.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np

#: Least and greatest alpha, beta, gamma and phi.
LOWER, UPPER = np.array([1e-4, 1e-4, 1e-4, 0.8]), np.array([0.9999, 0.9999, 0.9999, 0.98])
LONGEST_SEASON = 24
TOLERANCE, MOST_STEPS = 1e-8, 4000
#: Where only the best form counts: steps at which lanes are given up, and how far their AICc then lies above the best.
#: About one and a half times what any lane of eight published series and their replicas still gained afterwards.
GIVE_UP = {100: 240.0, 200: 150.0, 300: 100.0, 500: 60.0, 800: 45.0, 1200: 20.0, 2000: 9.0}

#: Error, trend, season: every pairing but additive errors with a multiplicative season.
FAMILIES = tuple((e, t, s) for e in "AM" for t in ("N", "A", "Ad") for s in "NAM" if (e, s) != ("A", "M"))


def family_name(family: tuple[str, str, str]) -> str:
    return f"ETS({','.join(family)})"


def admissible(y: np.ndarray, m: int, families=FAMILIES) -> list[tuple[str, str, str]]:
    """Forms that the data allow: positive values for products, a season that fits, fewer parameters than points."""
    positive = y.min() > 0
    seasonal = 1 < m <= LONGEST_SEASON and len(y) > 2 * m
    return [
        f for f in families
        if (positive or (f[0] == "A" and f[2] != "M")) and (seasonal or f[2] == "N") and _size(f, m) + 1 < len(y) - 1
    ]


def _size(family: tuple[str, str, str], m: int) -> int:
    _, trend, season = family
    return 2 + 2 * (trend != "N") + (trend == "Ad") + (m if season != "N" else 0)


def _first_seasons(y: np.ndarray, m: int, kind: str) -> np.ndarray:
    """Seasonal states from a classical decomposition, those of the first cycle."""
    half = m // 2
    weights = np.ones(m) / m if m % 2 else np.concatenate([[0.5], np.ones(m - 1), [0.5]]) / m
    centred = np.convolve(y, weights, "valid")
    own = y[half : half + len(centred)]
    rest = own - centred if kind == "A" else own / centred
    place = (np.arange(len(rest)) + half) % m
    with np.errstate(all="ignore"):
        means = np.bincount(place, rest, m) / np.bincount(place, minlength=m)
    means = np.where(np.isfinite(means), means, 0.0 if kind == "A" else 1.0)
    return means - means.mean() if kind == "A" else np.maximum(means / means.mean(), 0.01)


def _start(y: np.ndarray, family: tuple[str, str, str], m: int) -> np.ndarray:
    """A first guess: smoothing parameters, level, slope, and all seasonal states but the last."""
    _, trend, season = family
    seasons = _first_seasons(y, m, season) if season != "N" else np.zeros(0)
    flat = y
    if season != "N":
        tiled = np.resize(seasons, len(y))
        flat = y - tiled if season == "A" else y / tiled
    head = flat[: min(max(10, 2 * m if season != "N" else 10), len(y))]
    alpha = LOWER[0] + 0.2 * (UPPER[0] - LOWER[0]) / max(1, m)  # of the series' season, whatever the form
    out = [alpha]
    if trend != "N":
        out.append(LOWER[1] + 0.1 * (alpha - LOWER[1]))
    if season != "N":
        out.append(LOWER[2] + 0.05 * (min(UPPER[2], 1 - alpha) - LOWER[2]))
    if trend == "Ad":
        out.append(LOWER[3] + 0.99 * (UPPER[3] - LOWER[3]))
    if trend == "N":
        out.append(head.mean())
    else:
        slope, level = np.polyfit(np.arange(1.0, len(head) + 1), head, 1)
        out += [level, slope or 1e-8]
    return np.concatenate([out, seasons[:-1]])


@dataclass
class Lanes:
    """Lanes of one seasonal type; parameters sit in fixed columns, absent ones are masked."""

    y: np.ndarray  # lanes x points
    m: int
    season: str
    trend: np.ndarray  # has a slope
    damped: np.ndarray
    product: np.ndarray  # multiplicative errors
    free: np.ndarray = field(init=False)  # lanes x columns that the search may move

    def __post_init__(self):
        n = len(self.y)
        states = self.m - 1 if self.season != "N" else 0
        self.free = np.ones((n, 6 + states), bool)
        self.free[:, 1] = self.free[:, 5] = self.trend
        self.free[:, 2] = self.season != "N"
        self.free[:, 3] = self.damped

    def columns(self, family: tuple[str, str, str]) -> list[int]:
        _, trend, season = family
        cols = [0] + [1] * (trend != "N") + [2] * (season != "N") + [3] * (trend == "Ad") + [4] + [5] * (trend != "N")
        return cols + list(range(6, self.free.shape[1]))

    def run(self, p: np.ndarray, lanes: np.ndarray, keep: bool = False):
        """One-step forecasts through time; criterion, and with ``keep`` also fits and last states."""
        y = np.ascontiguousarray(self.y[lanes].T)
        n = len(y)
        alpha, beta, gamma = p[:, 0].copy(), np.where(self.trend[lanes], p[:, 1], 0.0), p[:, 2].copy()
        phi = np.where(self.damped[lanes], p[:, 3], 1.0)
        level, slope = p[:, 4].copy(), np.where(self.trend[lanes], p[:, 5], 0.0)
        if self.season != "N":
            seasons = np.empty((self.m, len(p)))
            seasons[:-1] = p[:, 6:].T
            seasons[-1] = (self.m if self.season == "M" else 0) - p[:, 6:].sum(axis=1)
        error = np.empty((n, len(p)))
        drift, q, step = np.empty(len(p)), np.empty(len(p)), np.empty(len(p))
        with np.errstate(all="ignore"):
            for t in range(n):  # every state moves by its share of one error; nothing is allocated
                e = error[t]
                np.multiply(phi, slope, out=drift)
                np.add(level, drift, out=q)
                shock = e
                if self.season == "N":
                    np.subtract(y[t], q, out=e)
                else:
                    s = seasons[t % self.m]
                    if self.season == "A":
                        np.subtract(y[t], q, out=e)
                        e -= s
                        np.multiply(gamma, e, out=step)
                    else:
                        np.multiply(q, s, out=step)
                        np.subtract(y[t], step, out=e)
                        shock = e / s
                        np.divide(e, q, out=step)
                        step *= gamma
                    s += step
                np.multiply(alpha, shock, out=step)
                np.add(q, step, out=level)
                np.multiply(beta, shock, out=step)
                np.add(drift, step, out=slope)
            fits = y - error
            product = self.product[lanes]
            if product.any():
                error = np.where(product, error / fits, error)
            squares = (error * error).sum(axis=0)
            value = n * np.log(np.maximum(squares, 1e-300))
            if product.any():
                value = value + np.where(product, 2 * np.log(np.abs(fits)).sum(axis=0), 0.0)
        value = np.where(np.isfinite(value), value, np.inf)
        if not keep:
            return value
        return value, fits.T, level, slope, seasons.T if self.season != "N" else None, squares

    def cost(self, p: np.ndarray, lanes: np.ndarray) -> np.ndarray:
        """The criterion; infinite outside the usual bounds."""
        alpha, beta, gamma, phi = p[:, 0], p[:, 1], p[:, 2], p[:, 3]
        ok = (alpha >= LOWER[0]) & (alpha <= UPPER[0])
        t, d = self.trend[lanes], self.damped[lanes]
        ok &= ~t | ((beta >= LOWER[1]) & (beta <= np.minimum(UPPER[1], alpha)))
        ok &= ~d | ((phi >= LOWER[3]) & (phi <= UPPER[3]))
        if self.season != "N":
            ok &= (gamma >= LOWER[2]) & (gamma <= np.minimum(UPPER[2], 1 - alpha))
            if self.season == "M":
                ok &= (p[:, 6:].min(axis=1) > 0) & (p[:, 6:].sum(axis=1) < self.m)
        out = np.full(len(p), np.inf)
        if ok.any():
            out[ok] = self.run(p[ok], lanes[ok])
        return out


def search(lanes: Lanes, start: np.ndarray, most: int = MOST_STEPS, tol: float = TOLERANCE, hopeless: Callable | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Batched Nelder-Mead; best points and their costs, infinite for lanes that ``hopeless(step, lanes, costs)`` gives up."""
    count, dims = start.shape
    best_x, best_f = start.copy(), np.full(count, np.inf)
    live = np.arange(count)
    simplex = np.repeat(start[:, None, :], dims + 1, axis=1)
    scale = np.abs(start)
    for d in range(dims):
        move = np.where(scale[:, d] > 0, 0.05 * start[:, d], 1e-4)
        if d == 0 or d == 2:
            move = np.full(count, 0.1)
        elif d == 1:
            move = 0.5 * start[:, 1]
        elif d == 3:
            move = np.full(count, -0.05)
        elif d == 5:
            move = np.maximum(0.1 * scale[:, 5], 0.005 * scale[:, 4])
        elif d >= 6:
            move = np.full(count, 0.05) if lanes.season == "M" else 0.02 * scale[:, 4]
        simplex[:, d + 1, d] += np.where(lanes.free[:, d], move, 0.0)
    used = np.concatenate([np.ones((count, 1), bool), lanes.free], axis=1)
    values = np.full((count, dims + 1), np.inf)
    for v in range(dims + 1):
        who = np.flatnonzero(used[:, v])
        values[who, v] = lanes.cost(simplex[who, v], who)
    size = lanes.free.sum(axis=1)
    total = (simplex * used[:, :, None]).sum(axis=1)  # kept up to date, as summing anew is most of a step

    for step in range(most):
        k = np.arange(len(live))
        masked = np.where(used, values, -np.inf)
        hi = masked.argmax(axis=1)
        lo = np.where(used, values, np.inf).argmin(axis=1)
        f_hi, f_lo = values[k, hi], values[k, lo]
        masked[k, hi] = -np.inf
        f_next = masked.max(axis=1)
        if step % 10 == 0:
            with np.errstate(all="ignore"):
                done = ~(np.abs(f_hi - f_lo) > tol * (np.abs(f_lo) + tol)) | ~np.isfinite(f_lo)
            best_x[live[done]], best_f[live[done]] = simplex[k[done], lo[done]], f_lo[done]
            if hopeless and step in GIVE_UP:
                done |= hopeless(step, live, f_lo)
            if done.any():
                go = ~done
                live, simplex, values, used, size, total = live[go], simplex[go], values[go], used[go], size[go], total[go]
                if not len(live):
                    break
                continue
        worst = simplex[k, hi]
        centre = (total - worst) / size[:, None]
        first = centre + (centre - worst)
        f_first = lanes.cost(first, live)
        expand = f_first < f_lo
        accept = ~expand & (f_first < f_next)
        outside = ~expand & ~accept & (f_first < f_hi)
        inside = ~expand & ~accept & ~outside
        factor = np.where(expand, 2.0, np.where(outside, 0.5, -0.5))
        second = centre + factor[:, None] * (centre - worst)
        f_second = np.full(len(live), np.inf)
        more = np.flatnonzero(~accept)
        if len(more):
            f_second[more] = lanes.cost(second[more], live[more])
        take = (expand & (f_second < f_first)) | (outside & (f_second <= f_first)) | (inside & (f_second < f_hi))
        keep = accept | (expand & ~take)
        simplex[k[take], hi[take]], values[k[take], hi[take]] = second[take], f_second[take]
        simplex[k[keep], hi[keep]], values[k[keep], hi[keep]] = first[keep], f_first[keep]
        total += np.where(take[:, None], second - worst, np.where(keep[:, None], first - worst, 0.0))
        shrink = np.flatnonzero(~take & ~keep)
        if len(shrink):
            base = simplex[shrink, lo[shrink]][:, None, :]
            simplex[shrink] = np.where(used[shrink][:, :, None], base + 0.5 * (simplex[shrink] - base), simplex[shrink])
            row, col = np.nonzero(used[shrink])
            who = shrink[row]
            other = col != lo[who]
            values[who[other], col[other]] = lanes.cost(simplex[who[other], col[other]], live[who[other]])
            total[shrink] = (simplex[shrink] * used[shrink][:, :, None]).sum(axis=1)
    if len(live):
        k = np.arange(len(live))
        lo = np.where(used, values, np.inf).argmin(axis=1)
        best_x[live], best_f[live] = simplex[k, lo], values[k, lo]
    return best_x, best_f


@dataclass(frozen=True)
class Fit:
    """One fitted lane."""

    family: tuple[str, str, str]
    aicc: float
    n_params: int
    sigma2: float
    fitted: np.ndarray
    params: np.ndarray
    level: float
    slope: float
    phi: float
    seasons: np.ndarray | None  # in the order of time % m
    n: int

    @property
    def method(self) -> str:
        return family_name(self.family)

    def forecast(self, h: int) -> np.ndarray:
        steps = np.arange(1, h + 1)
        out = self.level + (np.cumsum(self.phi**steps) * self.slope if self.family[1] != "N" else 0.0)
        if self.seasons is not None:
            s = self.seasons[(self.n + steps - 1) % len(self.seasons)]
            out = out + s if self.family[2] == "A" else out * s
        return np.asarray(out, float) + np.zeros(h)


def fit_families(series: np.ndarray, m: int, families=FAMILIES, most: int = MOST_STEPS, starts: int = 1, only_best: bool = False) -> list[list[Fit]]:
    """All admissible fits of each row of ``series`` (equal lengths), by AICc; each search begins ``starts`` times.

    With ``only_best``, forms that fall far behind the best one of their series are given up on the way.
    """
    series = np.asarray(series, float)
    n = series.shape[1]
    best_aicc = np.full(len(series), np.inf)
    out: list[list[Fit]] = [[] for _ in series]
    jobs = [(k, f) for k, y in enumerate(series) for f in admissible(y, m, families)]
    for season in "NAM":
        own = [(k, f) for k, f in jobs if f[2] == season]
        if not own:
            continue
        rows = np.array([k for k, _ in own])
        lanes = Lanes(series[rows], m, season, np.array([f[1] != "N" for _, f in own]), np.array([f[1] == "Ad" for _, f in own]), np.array([f[0] == "M" for _, f in own]))
        start = np.zeros(lanes.free.shape)
        for i, (k, f) in enumerate(own):
            start[i, lanes.columns(f)] = _start(series[k], f, m)
        sizes = np.array([_size(f, m) + 1 for _, f in own])
        with np.errstate(divide="ignore"):
            penalty = np.where(n > sizes + 1, 2 * sizes + 2 * sizes * (sizes + 1) / (n - sizes - 1), np.inf)

        def hopeless(step: int, live: np.ndarray, cost: np.ndarray) -> np.ndarray:
            aicc = cost + penalty[live]
            np.minimum.at(best_aicc, rows[live], aicc)
            return aicc > best_aicc[rows[live]] + GIVE_UP[step]

        best, value = start, np.full(len(own), np.inf)
        for _ in range(starts):
            best, value = search(lanes, best, most, hopeless=hopeless if only_best else None)
        np.minimum.at(best_aicc, rows, value + penalty)
        _, fits, level, slope, seasons, squares = lanes.run(best, np.arange(len(own)), keep=True)
        for i, (k, f) in enumerate(own):
            size, aicc = int(sizes[i]), value[i] + penalty[i]
            if np.isfinite(aicc):
                phi = best[i, 3] if f[1] == "Ad" else 1.0
                out[k].append(Fit(f, float(aicc), size, float(squares[i] / max(1, n - size + 1)), fits[i], best[i][lanes.free[i]], float(level[i]), float(slope[i]), float(phi), None if seasons is None else seasons[i], n))
    return [sorted(found, key=lambda x: x.aicc) for found in out]
