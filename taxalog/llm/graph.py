"""Connected components of a table of links."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxalog.storage import stored


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(member, smallest member) of each group that the links ``a``-``b`` connect, without the smallest itself."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[:len(a)], ends[len(a):]
    low = np.arange(len(nodes))
    while True:
        least = np.minimum(low[x], low[y])
        new = low.copy()
        np.minimum.at(new, low[x], least)
        np.minimum.at(new, low[y], least)
        new = new[new]
        if (new == low).all():
            break
        low = new
    away = low != np.arange(len(nodes))
    return nodes[away], nodes[low[away]]


def components(links: DataFrame, max_rounds: int = 100) -> DataFrame:
    """``node``, ``component`` (its smallest reachable node) of every node in ``links`` (a, b: long).

    Alternates large-star and small-star rounds: every node hangs its larger
    neighbours, then its smaller ones, below the smallest that it knows. Each
    round shuffles the links twice and writes them to the shared folder, so the
    plan stays short and a lost executor costs one round at most. Only the
    counts of a round reach the driver. Nodes without a link are not returned;
    links with a null end and links of a node with itself are ignored.
    """
    links = links.where("a IS NOT NULL AND b IS NOT NULL AND a != b")
    links = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links, before = stored(links, "links"), None
    for _ in range(max_rounds):
        both = links.union(links.select("b", "a"))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = (both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .where("a != b").distinct())
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = (small.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b")
                 .union(least.select("a", F.col("m").alias("b"))).distinct())
        links = stored(small, "links")
        now = links.agg(F.count("*"), F.count_distinct("a"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"links not settled after {max_rounds} rounds")
    return (links.select(F.col("a").alias("node"), F.col("b").alias("component"))
            .union(links.select("b", "b").distinct()))
