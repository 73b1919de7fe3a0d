"""Entries that know their group, and the one table of sums that every grouped mean is rolled up from.

``qc.normalise`` reads counts and cells in one join and can carry the cell's group columns along
(``carry=GROUP``). What comes behind it reads the stored entries alone: no later operator meets cells by
``cell_id`` again. ``moments`` adds the entries up once, to the finest groups; a partial sum leaves every
task, so a hot feature or group is no single task. Group sums, group means, Welch statistics and count
moments are sums of its rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GROUP = ["bin", "condition", "half", "batch"]


def carries(entries: DataFrame, keys: list[str]) -> bool:
    """Whether the entries hold the group columns themselves."""
    return set(keys) <= set(entries.columns)


def moments(entries: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Sums and sums of squares of ``x`` and ``cnt`` and the entries of every (group, feature)."""
    x, c = F.col("x"), F.col("cnt").cast("double")
    return entries.groupBy(*(keys or GROUP), "gene").agg(
        F.sum(x).alias("sx"), F.sum(x * x).alias("sxx"), F.count(F.lit(1)).alias("nnz"), F.sum(c).alias("sc"), F.sum(c * c).alias("scc"))


def roll_up(sums: DataFrame, keys: list[str]) -> DataFrame:
    """The same sums for coarser groups."""
    return sums.groupBy(*keys, "gene").agg(*[F.sum(c).alias(c) for c in ("sx", "sxx", "nnz", "sc", "scc")])
