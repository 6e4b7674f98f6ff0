"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ensemblecast.session import cut


def _round(edges: DataFrame, large: bool) -> DataFrame:
    """Hang neighbours on the least of each node's neighbourhood."""
    if large:
        links = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        links = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    # as a table, so that the neighbours of a node that has very many can be split when they are joined
    least = cut(links.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("root")))
    hung = links.join(least, "a")
    if large:
        out = hung.where("b > a").select(F.col("b").alias("a"), F.col("root").alias("b"))
    else:
        out = hung.select(F.col("b").alias("a"), F.col("root").alias("b")).unionByName(least.select("a", F.col("root").alias("b")))
    return out.where("a != b").distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges(a long, b long)``; the root is the least node of its component."""
    current, before = cut(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()), None
    for _ in range(most_rounds):
        now = current.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == before or not now[0]:
            break
        before = now
        current = cut(_round(cut(_round(current, True)), False))
    else:
        raise RuntimeError(f"components didn't settle in {most_rounds} rounds")
    return current.select(F.col("a").alias("node"), F.col("b").alias("root"))
