"""Tails of distributions and rank tests for small numbers of groups."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def chi2_tail(x: float, dof: float) -> float:
    """Upper tail, by the series or the continued fraction of the incomplete gamma function."""
    a, x = dof / 2, x / 2
    if x <= 0:
        return 1.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1 - front * total)
    b, tiny = x + 1 - a, 1e-300
    c, d = 1 / tiny, 1 / b
    h = d
    for k in range(1, 1000):
        step = -k * (k - a)
        b += 2
        d = 1 / (step * d + b or tiny)
        c = b + step / c or tiny
        h *= c * d
        if abs(c * d - 1) < 1e-16:
            break
    return front * h


def student_two_sided(t: float, dof: float) -> float:
    """By the continued fraction of the incomplete beta function."""
    x = dof / (dof + t * t)
    a, b = dof / 2, 0.5
    if x >= 1:
        return 1.0

    def fraction(a: float, b: float, x: float) -> float:
        tiny = 1e-300
        c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or tiny)
        h = d
        for m in range(1, 1000):
            for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1 / (1 + step * d or tiny)
                c = 1 + step / c or tiny
                h *= c * d
            if abs(c * d - 1) < 1e-16:
                break
        return h

    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * fraction(b, a, 1 - x) / b


def least_detectable_rho(n: int, alpha: float = 0.05, power: float = 0.8) -> float:
    normal = NormalDist()
    return (normal.inv_cdf(1 - alpha / 2) + normal.inv_cdf(power)) / math.sqrt(n - 3)


def average_ranks(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, float)
    _, back, times = np.unique(x, return_inverse=True, return_counts=True)
    last = np.cumsum(times)
    return ((last - times + 1 + last) / 2)[back]


def friedman(ranks_by_row: np.ndarray) -> tuple[float, float]:
    """Statistic with the correction for ties, and its p value; ``ranks_by_row`` is series x strategies."""
    n, k = ranks_by_row.shape
    if k < 3:
        raise ValueError("Friedman's test compares three groups at least")
    ties = sum((c**3 - c).sum() for c in (np.unique(r, return_counts=True)[1] for r in ranks_by_row))
    raw = 12 / (n * k * (k + 1)) * (ranks_by_row.sum(axis=0) ** 2).sum() - 3 * n * (k + 1)
    value = raw / (1 - ties / (n * k * (k * k - 1)))
    return float(value), chi2_tail(value, k - 1)


def hochberg(p: np.ndarray) -> np.ndarray:
    """Step-up adjusted p values."""
    order = np.argsort(-np.asarray(p), kind="stable")
    out = np.empty(len(p))
    out[order] = np.minimum(1, np.minimum.accumulate(np.asarray(p)[order] * np.arange(1, len(p) + 1)))
    return out


def wilcoxon(a: np.ndarray, b: np.ndarray) -> tuple[float, float]:
    """Signed-rank statistic and two-sided p: exact for 50 or fewer untied differences, else the normal tail."""
    d = np.asarray(a, float) - np.asarray(b, float)
    d = d[d != 0]
    n = len(d)
    if not n:
        return 0.0, 1.0
    ranks = average_ranks(np.abs(d))
    w = float(min(ranks[d > 0].sum(), ranks[d < 0].sum()))
    times = np.unique(np.abs(d), return_counts=True)[1]
    if n <= 50 and (times == 1).all():
        ways = np.zeros(n * (n + 1) // 2 + 1)
        ways[0] = 1
        for r in range(1, n + 1):
            ways[r:] = ways[r:] + ways[:-r]
        return w, float(min(1.0, 2 * ways[: int(w) + 1].sum() / 2.0**n))
    variance = n * (n + 1) * (2 * n + 1) / 24 - (times**3 - times).sum() / 48
    return w, normal_two_sided((w - n * (n + 1) / 4) / math.sqrt(variance))


def spearman(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    rho = float(np.corrcoef(average_ranks(x), average_ranks(y))[0, 1])
    n = len(x)
    return rho, 0.0 if abs(rho) >= 1 else student_two_sided(rho * math.sqrt((n - 2) / (1 - rho * rho)), n - 2)


def ks_two_sample(a: np.ndarray, b: np.ndarray) -> tuple[float, float]:
    """Largest gap between two empirical distributions, and its asymptotic p value."""
    a, b = np.sort(a), np.sort(b)
    both = np.concatenate([a, b])
    gap = float(np.abs(np.searchsorted(a, both, "right") / len(a) - np.searchsorted(b, both, "right") / len(b)).max())
    z = gap * math.sqrt(len(a) * len(b) / (len(a) + len(b)))
    return gap, min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * (k * z) ** 2) for k in range(1, 101)))) if z > 0.2 else 1.0


def adjusted_rand(a: np.ndarray, b: np.ndarray) -> float:
    """Agreement of two labellings beyond chance."""
    table = np.unique(np.stack([a, b]), axis=1, return_counts=True)[1]
    pairs = lambda c: (c * (c - 1) / 2).sum()
    rows, cols = pairs(np.unique(a, return_counts=True)[1]), pairs(np.unique(b, return_counts=True)[1])
    chance = rows * cols / max(1, len(a) * (len(a) - 1) / 2)
    most = (rows + cols) / 2
    return 1.0 if most == chance else float((pairs(table) - chance) / (most - chance))
