"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deltascreen.llm.common import join_heavy, stage


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest node reachable from each of ``n`` local nodes over the links ``(a, b)``."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        root = root[root]
        if (root == before).all():
            return root


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``edges(a, b)``; component is its smallest node.

    Each round hangs the larger neighbours of every node, then the smaller ones, below the
    smallest; rounds are logarithmic in the longest path. Minima are combined before the shuffle
    and joined back to the edges; edges of a heavy hub stay where they are (``join_heavy``). Self links and
    repeated links are allowed, null ends are not links; an empty table gives an empty result.
    """
    now = stage(_ordered(edges), "links")
    size = _mark(now)
    while size[0]:
        now = stage(_small_star(stage(_large_star(now), "links")), "links")
        if (after := _mark(now)) == size:
            break
        size = after
    found = now.select(F.col("high").alias("node"), F.col("low").alias("component"))
    return found.unionByName(now.select(F.col("low").alias("node"), F.col("low").alias("component"))).distinct()


def _ordered(edges: DataFrame) -> DataFrame:
    return (
        edges.where("a <> b")
        .select(F.greatest("a", "b").alias("high"), F.least("a", "b").alias("low"))
        .distinct()
    )


def _mark(links: DataFrame):
    mark = F.sum(F.xxhash64("high", "low") % F.lit(1 << 40))
    return tuple(links.agg(F.count("*"), mark).first())


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("low").alias("high"), F.col("high").alias("low")))
    least = both.groupBy(F.col("high").alias("hub")).agg(F.min("low").alias("least"))
    least = stage(least.select(F.col("hub").alias("low"), F.least("hub", "least").alias("least")), "least-neighbours")
    # neighbours above the hub move to the least node that the hub sees
    moved = join_heavy(links, least, "low").select("high", F.col("least").alias("low"))
    return moved.where("high <> low").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    least = stage(links.groupBy("high").agg(F.min("low").alias("least")), "least-neighbours")
    moved = join_heavy(links, least, "high").select(F.col("low").alias("high"), F.col("least").alias("low"))
    return moved.where("high <> low").unionByName(least.select("high", F.col("least").alias("low"))).distinct()
