"""Strategy specifications ``name[:aggregator]`` as text."""

from __future__ import annotations

from typing import NamedTuple

from ensemblecast.operators import selection as S


class Spec(NamedTuple):
    label: str
    strategy: S.Strategy | None  # None: member 0 alone
    aggregator: str


def parse(text: str) -> Spec:
    """original, topk, random, none, none<N>, greedy, portfolio, cluster-<k|auto>, paper-<k|auto>; the median by default."""
    name, colon, aggregator = text.partition(":")
    aggregator = aggregator or "median"
    if aggregator not in S.AGGREGATORS:
        raise ValueError(f"unknown aggregator {aggregator!r}; one of {sorted(S.AGGREGATORS)}")
    plain = {"original": lambda: None, "topk": S.TopK, "random": S.Random, "none": S.FirstN, "portfolio": S.Portfolio, "greedy": lambda: S.Greedy(aggregator)}
    kind, dash, k = name.partition("-")
    if name in plain:
        strategy = plain[name]()
    elif name.startswith("none") and name[4:].isdigit():
        strategy = S.FirstN(int(name[4:]))
    elif kind in ("cluster", "paper") and (k == "auto" or k.removeprefix("k").isdigit()):
        clusters = k if k == "auto" else int(k.removeprefix("k"))
        strategy = S.Clusters(clusters) if kind == "cluster" else S.Clusters.published(clusters)
    else:
        raise ValueError(f"unknown strategy {text!r}")
    return Spec(text if colon or aggregator == "median" else f"{name}:{aggregator}", strategy, aggregator)
