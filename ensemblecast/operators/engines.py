"""Base learners behind one batch protocol: rows of equal length in, forecasts out."""

from __future__ import annotations

from dataclasses import dataclass
from typing import NamedTuple, Protocol, runtime_checkable

import numpy as np

from ensemblecast.operators import ets

FALLBACK = "naive-fallback"


class Forecasts(NamedTuple):
    mean: np.ndarray  # rows x h
    fitted: np.ndarray | None  # rows x points
    methods: list[str]
    fallback: np.ndarray


@runtime_checkable
class Engine(Protocol):
    """Stateless: the result depends on the arguments only, whatever the batch."""

    season_length: int

    def forecast(self, series: np.ndarray, h: int, with_fitted: bool = False) -> Forecasts: ...


def _last(series: np.ndarray, h: int) -> np.ndarray:
    return np.repeat(series[:, -1:], h, axis=1)


class NaiveEngine:
    def __init__(self, season_length: int = 1):
        self.season_length = season_length

    def forecast(self, series: np.ndarray, h: int, with_fitted: bool = False) -> Forecasts:
        series = np.asarray(series, float)
        fitted = np.hstack([np.full((len(series), 1), np.nan), series[:, :-1]]) if with_fitted else None
        return Forecasts(_last(series, h), fitted, ["naive"] * len(series), np.zeros(len(series), bool))


class SeasonalNaiveEngine:
    """The last season again; the last value for series under a season."""

    def __init__(self, season_length: int):
        self.season_length = season_length

    def forecast(self, series: np.ndarray, h: int, with_fitted: bool = False) -> Forecasts:
        series = np.asarray(series, float)
        lag = self.season_length if series.shape[1] >= self.season_length else 1
        mean = series[:, series.shape[1] - lag + np.arange(h) % lag]
        fitted = np.hstack([np.full((len(series), lag), np.nan), series[:, :-lag]]) if with_fitted else None
        return Forecasts(mean, fitted, [f"snaive({lag})"] * len(series), np.zeros(len(series), bool))


class Rung(NamedTuple):
    """One attempt of the ladder: forms, the season they are searched with, and the method's name (None: the form's own)."""

    families: tuple[tuple[str, str, str], ...]
    season_length: int
    method: str | None


@dataclass(frozen=True)
class Smoothed:
    """What a series is forecast by: a form found on a rung of the ladder, or its last value below the lowest."""

    form: ets.Fit | None
    method: str
    fallback: bool
    y: np.ndarray

    def ahead(self, h: int) -> tuple[np.ndarray, bool]:
        """The forecast, and whether the last value had to stand in for it because it isn't finite throughout."""
        mean = self.form.forecast(h) if self.form is not None else None
        if mean is None or not np.isfinite(mean).all():
            return np.full(h, self.y[-1]), True
        return mean, False

    @property
    def fitted(self) -> np.ndarray:
        return np.append(np.nan, self.y[:-1]) if self.form is None else self.form.fitted


class ETSEngine:
    """The best exponential-smoothing form by AICc; simple smoothing, then the last value, if none works."""

    def __init__(self, season_length: int, families=ets.FAMILIES, most: int = ets.MOST_STEPS, starts: int = 1):
        self.season_length, self.families, self.most, self.starts = season_length, families, most, starts
        self.ladder = (Rung(families, season_length, None), Rung((("A", "N", "N"),), 1, "ETS-ANN-fallback"))

    def _climb(self, series: np.ndarray) -> list[Smoothed]:
        """Rows of equal length, each on the first rung where a form's next value is a number.

        A rung searches all rows that are still open at once.
        """
        forms = np.full(len(series), None, object)
        level = np.full(len(series), len(self.ladder))
        searchable = np.isfinite(series).all(axis=1) if series.shape[1] > 3 else np.zeros(len(series), bool)
        for k, rung in enumerate(self.ladder):
            lanes = np.flatnonzero(searchable & (level > k))
            if not len(lanes):
                break
            for lane, ranked in zip(lanes, ets.fit_families(series[lanes], rung.season_length, rung.families, self.most, self.starts, only_best=True)):
                best = next(iter(ranked), None)
                if best is not None and np.isfinite(best.forecast(1)).all():
                    forms[lane], level[lane] = best, k
        names = [*(r.method for r in self.ladder), FALLBACK]
        return [Smoothed(f, names[k] or f.method, k > 0, y) for f, k, y in zip(forms, level, series)]

    def fit(self, y: np.ndarray) -> Smoothed:
        return self._climb(np.asarray(y, float)[None])[0]

    def predict(self, fitted: Smoothed, h: int) -> np.ndarray:
        return fitted.ahead(h)[0]

    def forecast(self, series: np.ndarray, h: int, with_fitted: bool = False) -> Forecasts:
        lanes = self._climb(np.asarray(series, float))
        means, stand_ins = zip(*(lane.ahead(h) for lane in lanes))
        fallback = np.array([lane.fallback for lane in lanes]) | np.array(stand_ins)
        return Forecasts(np.stack(means), np.stack([lane.fitted for lane in lanes]) if with_fitted else None, [lane.method for lane in lanes], fallback)


ENGINES = {"naive": NaiveEngine, "snaive": SeasonalNaiveEngine, "ets": ETSEngine}


def build_engine(name: str, season_length: int) -> Engine:
    """By name: naive, snaive, ets."""
    if name not in ENGINES:
        raise ValueError(f"unknown engine {name!r}; one of {sorted(ENGINES)}")
    return ENGINES[name](season_length)
