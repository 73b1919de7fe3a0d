"""Highly variable features: variance-stabilised selection on raw counts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from deltascreen.operators.entries import carries, roll_up
from deltascreen.operators.scale import spread

SPAN = 0.3


def moments(counts: DataFrame, cells: DataFrame, genes: DataFrame, batch: str, sums: DataFrame | None = None) -> DataFrame:
    """Zero-inclusive mean and sample variance of the counts per batch and feature.

    From the stored ``sums`` of ``entries.moments`` where they are given; else the counts are added up.
    """
    c = F.col("cnt").cast("double")
    if sums is not None:
        sums = roll_up(sums, [batch]).select(batch, "gene", F.col("sc").alias("s"), F.col("scc").alias("q"))
    else:
        placed = counts if carries(counts, [batch]) else counts.join(cells.select("cell_id", batch), "cell_id")
        sums = placed.groupBy(batch, "gene").agg(F.sum(c).alias("s"), F.sum(c * c).alias("q"))
    sizes = cells.groupBy(batch).agg(F.count(F.lit(1)).alias("n"))
    mean = F.coalesce("s", F.lit(0.0)) / F.col("n")
    var = (F.coalesce("q", F.lit(0.0)) - F.col("n") * mean * mean) / F.greatest(F.col("n") - 1, F.lit(1))
    return (
        spread(sizes, genes, "gene")
        .join(sums, [batch, "gene"], "left")
        .select(batch, "gene", "n", mean.alias("mean"), var.alias("var"))
    )


def local_quadratic(x: np.ndarray, y: np.ndarray, span: float = SPAN) -> np.ndarray:
    """Tricube-weighted local quadratic fit evaluated at every x."""
    n = len(x)
    k = max(min(n, int(np.floor(n * span + 1e-5))), min(n, 4))
    order = np.argsort(x, kind="stable")
    xs, ys = x[order], y[order]
    fit = np.empty(n)
    for i in range(n):
        gap = np.abs(xs - xs[i])
        reach = np.partition(gap, k - 1)[k - 1]
        w = np.clip(1.0 - (gap / max(reach, 1e-12)) ** 3, 0.0, None) ** 3
        use = w > 0
        d = xs[use] - xs[i]
        a = np.stack([np.ones_like(d), d, d * d], axis=1)
        sw = np.sqrt(w[use])
        fit[i] = np.linalg.lstsq(a * sw[:, None], ys[use] * sw, rcond=None)[0][0]
    out = np.empty(n)
    out[order] = fit
    return out


def _fit_trend(pdf: pd.DataFrame) -> pd.DataFrame:
    ok = (pdf["var"] > 0) & (pdf["mean"] > 0)
    sd = np.ones(len(pdf))
    if ok.sum() > 0:
        x = np.log10(pdf.loc[ok, "mean"].to_numpy(float))
        y = np.log10(pdf.loc[ok, "var"].to_numpy(float))
        sd[ok.to_numpy()] = np.sqrt(10.0 ** local_quadratic(x, y))
    return pdf.assign(reg_std=sd)


def select_hvg(
    counts: DataFrame, cells: DataFrame, genes: DataFrame, n_top: int = 8192, batch: str | None = None,
    sums: DataFrame | None = None,
) -> DataFrame:
    """All features with their rank, normalised variance and the ``hvg`` flag.

    The trend fit sees one row per feature of the bounded panel; the clipped variance is again a
    plain aggregate over the counts. With a batch column the selection runs per batch and the
    features are merged by how many batches select them, then by median rank.
    """
    key = batch or "__one"
    used = cells.select("cell_id", (F.col(batch) if batch else F.lit("all")).alias(key))
    if batch is None:  # one batch: entries of the cells, or all stored sums
        counts = counts.join(used.select("cell_id"), "cell_id", "left_semi").withColumn(key, F.lit("all")) if sums is None else counts.withColumn(key, F.lit("all"))
        sums = None if sums is None else sums.withColumn(key, F.lit("all"))
    stats = moments(counts, used, genes, key, sums)
    schema = f"{key} string, gene string, n bigint, mean double, var double, reg_std double"
    trend = stats.groupBy(key).applyInPandas(_fit_trend, schema)
    clip_at = F.sqrt(F.col("n").cast("double")) * F.col("reg_std") + F.col("mean")
    joined = (
        (counts if carries(counts, [key]) else counts.join(used, "cell_id"))
        .join(trend.select(key, "gene", clip_at.alias("clip")), [key, "gene"])
        .select(key, "gene", F.least(F.col("cnt").cast("double"), F.col("clip")).alias("c"))
    )
    sums = joined.groupBy(key, "gene").agg(F.sum("c").alias("cs"), F.sum(F.col("c") * F.col("c")).alias("cq"))
    n, mu = F.col("n").cast("double"), F.col("mean")
    norm = (n * mu * mu + F.coalesce("cq", F.lit(0.0)) - 2.0 * mu * F.coalesce("cs", F.lit(0.0))) / (
        (n - 1.0) * F.col("reg_std") * F.col("reg_std")
    )
    per = trend.join(sums, [key, "gene"], "left").select(
        key, "gene", F.when(F.col("var") > 0, norm).otherwise(0.0).alias("vn")
    )
    # rounding keeps the rank stable against summation order
    ranked = per.withColumn(
        "r", F.row_number().over(W.partitionBy(key).orderBy(F.round("vn", 9).desc(), "gene"))
    )
    merged = ranked.groupBy("gene").agg(
        F.avg("vn").alias("variance_norm"),
        F.count_if(F.col("r") <= n_top).alias("n_selected"),
        F.median(F.when(F.col("r") <= n_top, F.col("r"))).alias("median_rank"),
    )
    best_first = W.partitionBy(F.lit(1)).orderBy(
        F.col("median_rank").asc_nulls_last(), F.col("n_selected").desc(), "gene"
    )
    return merged.withColumn("rank", F.row_number().over(best_first)).select(
        "gene", "rank", "variance_norm", "n_selected", (F.col("rank") <= n_top).alias("hvg")
    )
