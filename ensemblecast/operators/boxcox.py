"""Box-Cox transforms and the choice of their exponent from block statistics."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np

#: Exponents below this count as zero (the logarithm).
ZERO = 1e-12
TINY = np.finfo(float).tiny


def minimize_bounded(f: Callable[[float], float], lo: float, hi: float, tol: float = 1e-6, most: int = 500) -> float:
    """Brent's minimiser on an interval: a parabola through three points, else a golden section."""
    golden, eps = (3 - math.sqrt(5)) / 2, math.sqrt(np.finfo(float).eps)
    best = second = third = lo + golden * (hi - lo)
    f_best = f_second = f_third = f(best)
    move = before = 0.0
    for _ in range(most):
        middle, near = (lo + hi) / 2, eps * abs(best) + tol / 3
        if abs(best - middle) <= 2 * near - (hi - lo) / 2:
            break
        parabola = False
        if abs(before) > near:
            r = (best - second) * (f_best - f_third)
            q = (best - third) * (f_best - f_second)
            top, bottom = (best - third) * q - (best - second) * r, 2 * (q - r)
            top, bottom = (-top, bottom) if bottom > 0 else (top, -bottom)
            last, before = before, move
            if bottom and abs(top) < abs(bottom * last / 2) and bottom * (lo - best) < top < bottom * (hi - best):
                move, parabola = top / bottom, True
                at = best + move
                if at - lo < 2 * near or hi - at < 2 * near:
                    move = math.copysign(near, middle - best if middle != best else 1.0)
        if not parabola:
            before = (hi if best < middle else lo) - best
            move = golden * before
        at = best + (move if abs(move) >= near else math.copysign(near, move or 1.0))
        value = f(at)
        if value <= f_best:
            lo, hi = (best, hi) if at >= best else (lo, best)
            third, f_third, second, f_second, best, f_best = second, f_second, best, f_best, at, value
        else:
            lo, hi = (at, hi) if at < best else (lo, at)
            if value <= f_second or second == best:
                third, f_third, second, f_second = second, f_second, at, value
            elif value <= f_third or third in (best, second):
                third, f_third = at, value
    return best


def guerrero_objective(x: np.ndarray, season_length: int) -> Callable[[float], float] | None:
    """Coefficient of variation of block sd / mean**(1 - lambda); None with under two blocks."""
    x = np.asarray(x, float)
    period = max(2, season_length)
    count = len(x) // period
    if len(x) <= 2 * season_length or count < 2:
        return None
    blocks = x[len(x) - count * period :].reshape(count, period)
    mean, sd = blocks.mean(axis=1), blocks.std(axis=1, ddof=1)

    def variation(lam: float) -> float:
        with np.errstate(all="ignore"):
            ratio = sd / mean ** (1 - lam)
            return float(ratio.std(ddof=1) / ratio.mean())

    return variation


def guerrero_lambda(x: np.ndarray, season_length: int = 1, lower: float = 0.0, upper: float = 1.0) -> float:
    """The exponent in (lower, upper) that makes block variation most even; 1 for short series."""
    variation = guerrero_objective(x, season_length)
    return 1.0 if variation is None else float(minimize_bounded(variation, lower, upper))


def boxcox(x: np.ndarray, lam: float) -> np.ndarray:
    x = np.asarray(x, float)
    if abs(lam) < ZERO:
        return np.log(x)
    return (np.sign(x) * np.abs(x) ** lam - 1) / lam


def inv_boxcox(x: np.ndarray, lam: float) -> tuple[np.ndarray, int]:
    """The inverse, and how many values had to be clipped to stay positive."""
    x = np.asarray(x, float)
    if abs(lam) < ZERO:
        return np.exp(x), 0
    base = lam * x + 1
    return np.maximum(base, TINY) ** (1 / lam), int((base <= 0).sum())
