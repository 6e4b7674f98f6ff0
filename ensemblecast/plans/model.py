"""The estimator: bootstrap, validate, select, fit, combine; one series, its members over many tasks.

Members, their forecasts and errors are tables; the driver sees the series, the numbers of the chosen members and their
forecasts, which are the result.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ensemblecast.operators import bootstrap
from ensemblecast.operators.selection import AGGREGATORS, METRICS, Artifacts, Clusters, Strategy
from ensemblecast.plans import experiment
from ensemblecast.session import cut


@dataclass(frozen=True)
class Forecast:
    point: np.ndarray
    ensemble: np.ndarray  # members x h
    info: dict

    def quantile(self, q) -> np.ndarray:
        """Spread of the members; not a calibrated interval."""
        return np.quantile(self.ensemble, q, axis=0)


class BaggedForecaster:
    """``fit(y)`` chooses members on a held-out tail; ``predict(h)`` fits those alone and combines them."""

    def __init__(
        self, spark: SparkSession, season_length: int, members: int = 1000, n_select: int = 100, selection: Strategy | None = None,
        aggregator: str | Callable = "median", metric: str = "mape", h_val: int | None = None, block: int | None = None, seed: int | None = None,
        engine: str = "ets", parts: int | None = None, **knobs,
    ):
        if isinstance(aggregator, str) and aggregator not in AGGREGATORS:
            raise ValueError(f"unknown aggregator {aggregator!r}; one of {sorted(AGGREGATORS)}")
        if metric not in METRICS:
            raise ValueError(f"unknown validation metric {metric!r}; one of {sorted(METRICS)}")
        self.spark, self.season_length, self.members, self.n_select = spark, season_length, members, n_select
        self.selection, self.aggregator, self.metric = selection or Clusters(), aggregator, metric
        self.h_val, self.block, self.seed, self.engine, self.parts, self.knobs = h_val, block, seed, engine, parts, knobs
        self.info_: dict | None = None

    def fit(self, y) -> BaggedForecaster:
        y, m = np.asarray(y, float), self.season_length
        if y.ndim != 1 or not np.isfinite(y).all():
            raise ValueError("a series has one dimension and finite values only")
        n = len(y)
        h_val = self.h_val or min(2 * m if m > 1 else 10, (n - 1) // 2)
        seed = np.random.SeedSequence().entropy if self.seed is None else self.seed  # every task draws the same stream
        members, block, chosen, n_select = self.members, self.block, self.selection, self.n_select
        parts = self.parts or self.spark.sparkContext.defaultParallelism
        series = self.spark.createDataFrame([("y", m, 1, int(h_val), y.tolist())], "uid string, m int, h int, h_val int, y_train array<double>")
        pool = experiment.pool(series, members, None, block, parts, -(-members // parts), stream=lambda *_: np.random.default_rng(seed))
        told = pool.agg(F.max("lam").alias("lam"), F.sum("n_clipped").alias("n_clipped")).first()
        self.info_ = {"lambda": told["lam"], "n_clipped": told["n_clipped"], "h_val": h_val, "engine": self.engine}
        if self.h_val is None and h_val < max(4, m):
            warnings.warn(f"{n} points are too few to validate on; members are drawn at random", stacklevel=2)
            rng = bootstrap.after_pool(n, members, m, np.random.default_rng(seed), block)
            self.members_ = cut(pool)
            self.selected_ = np.sort(rng.choice(members, min(n_select, members), replace=False))
            self.info_ |= {"selection": "fallback_random", "n_val_fallbacks": 0, "n_members": len(self.selected_)}
            return self
        if not 0 < h_val < n - h_val:
            raise ValueError(f"a tail of {h_val} doesn't fit {n} points")
        tails = experiment.forecasts(pool, self.engine, final=False, dealt=True, **self.knobs)
        self.members_ = cut(experiment.with_errors(tails, series, self.metric))

        def choose(frame: pd.DataFrame) -> pd.DataFrame:
            frame = frame.sort_values("member")
            made = Artifacts(np.stack(frame["y"]), np.stack(frame["val_fc"]), np.asarray(frame["actual"].iloc[0]), frame["val_err"].to_numpy(float))
            members_, k = chosen.select(made, n_select, bootstrap.after_pool(n, members, m, np.random.default_rng(seed), block))
            return pd.DataFrame({"member": members_, "k": k, "fallbacks": int(frame["val_fallback"].sum())})

        # the pool has ``members`` rows at most
        rows = self.members_.groupBy("uid").applyInPandas(choose, "member int, k int, fallbacks int").orderBy("member").collect()
        self.selected_ = np.array([r["member"] for r in rows])
        self.info_ |= {"selection": chosen.name, "n_val_fallbacks": rows[0]["fallbacks"], "n_members": len(rows)} | ({"k_chosen": rows[0]["k"]} if rows[0]["k"] else {})
        return self

    def predict(self, h: int) -> Forecast:
        if self.info_ is None:
            raise RuntimeError("fit first")
        own = self.members_.where(F.col("member").isin(self.selected_.tolist())).select("uid", "m", F.lit(h).alias("h"), F.lit(0).alias("h_val"), "member", "y")
        made = experiment.forecasts(own, self.engine, validate=False, parts=self.parts, **self.knobs)
        rows = made.select("member", "fc", "fallback").orderBy("member").collect()
        ensemble = np.array([r["fc"] for r in rows])
        combine = AGGREGATORS[self.aggregator] if isinstance(self.aggregator, str) else self.aggregator
        try:
            point = combine(ensemble, axis=0)
        except TypeError:
            point = combine(ensemble)
        return Forecast(np.asarray(point), ensemble, self.info_ | {"n_final_fallbacks": sum(r["fallback"] for r in rows)})
