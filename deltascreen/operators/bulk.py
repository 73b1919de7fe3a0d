"""Grouped means that count implicit zeros, deltas, and masked means over training pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from deltascreen.functions import labels
from deltascreen.operators.entries import roll_up
from deltascreen.operators.qc import full_coverage
from deltascreen.operators.scale import spread

MIN_CELLS = 4


def number_genes(genes: DataFrame) -> DataFrame:
    """Feature axis with its position in the order of the names."""
    place = F.row_number().over(W.orderBy("gene")) - 1
    return genes.where("gene IS NOT NULL").select("gene").distinct().withColumn("gene_ord", place)


def grouped_sum(expr: DataFrame, groups: DataFrame, keys: list[str], value: str = "x") -> DataFrame:
    """Sum and sum of squares per group and feature in one pass (partial sums before the shuffle)."""
    v = F.col(value)
    return (
        expr.select("cell_id", "gene", value)
        .join(groups.select("cell_id", *keys), "cell_id")
        .groupBy(*keys, "gene")
        .agg(F.sum(v).alias("sx"), F.sum(v * v).alias("sxx"), F.count(F.lit(1)).alias("nnz"))
    )


def group_sizes(cells: DataFrame, keys: list[str]) -> DataFrame:
    return cells.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_cells"))


def dense_means(sizes: DataFrame, sums: DataFrame, keys: list[str], genes: DataFrame) -> DataFrame:
    """Mean over all cells of the group, absent entries being zero."""
    grid = spread(sizes, genes, "gene")
    return grid.join(sums, [*keys, "gene"], "left").select(
        *keys, "gene", (F.coalesce("sx", F.lit(0.0)) / F.col("n_cells")).alias("m"), "n_cells"
    )


def control_bulk(expr: DataFrame, cells: DataFrame, genes: DataFrame, sums: DataFrame | None = None) -> DataFrame:
    """Control mean per bin and feature, from the stored ``sums`` of ``entries.moments`` where they are given."""
    is_ctrl = labels.is_control(F.col("condition"))
    ctrl = cells.where(is_ctrl)
    own = grouped_sum(expr, ctrl, ["bin"]) if sums is None else roll_up(sums.where(is_ctrl), ["bin"])
    return dense_means(group_sizes(ctrl, ["bin"]), own, ["bin"], genes)


def half_bulk(
    expr: DataFrame, cells: DataFrame, genes: DataFrame, min_cells: int = MIN_CELLS, sums: DataFrame | None = None,
) -> DataFrame:
    """Mean per (bin, ko, half, gene) for labels with enough cells in both halves of every bin."""
    keys = ["bin", "ko", "half"]
    covered = full_coverage(cells, min_cells)
    kept = cells.withColumnRenamed("condition", "ko").join(covered, "ko", "left_semi")
    if sums is None:
        own = grouped_sum(expr, kept, keys)
    else:
        own = roll_up(sums.withColumnRenamed("condition", "ko").join(covered, "ko", "left_semi"), keys)
    return dense_means(group_sizes(kept, keys), own, keys, genes)


def deltas(bulk: DataFrame, ctrl: DataFrame) -> DataFrame:
    """Deltas against control: all cells (count-weighted halves) and each half."""
    first, second = F.col("half") == "first_half", F.col("half") == "second_half"
    pick = lambda cond, col: F.max(F.when(cond, F.col(col)))
    wide = bulk.groupBy("bin", "ko", "gene").agg(
        pick(first, "m").alias("m1"), pick(second, "m").alias("m2"),
        pick(first, "n_cells").alias("n1"), pick(second, "n_cells").alias("n2"),
    )
    whole = (F.col("m1") * F.col("n1") + F.col("m2") * F.col("n2")) / (F.col("n1") + F.col("n2"))
    return wide.join(ctrl.select("bin", "gene", F.col("m").alias("c")), ["bin", "gene"]).select(
        "bin", "ko", "gene",
        (whole - F.col("c")).alias("d_all"),
        (F.col("m1") - F.col("c")).alias("d_first"),
        (F.col("m2") - F.col("c")).alias("d_second"),
        whole.alias("m_all"),
        F.col("c").alias("ctrl"),
    )


def on_pairs(table: DataFrame, pairs: DataFrame) -> DataFrame:
    """Rows of a (bin, ko, gene) table for the given fold pairs."""
    return pairs.join(table, ["bin", "ko"])


def mean_per_bin(table: DataFrame, train: DataFrame, value: str = "d_all") -> DataFrame:
    return on_pairs(table, train).groupBy("scenario", "fold", "bin", "gene").agg(
        F.avg(value).alias("m_bin")
    )


def mean_per_ko(table: DataFrame, train: DataFrame, value: str = "d_all") -> DataFrame:
    return on_pairs(table, train).groupBy("scenario", "fold", "ko", "gene").agg(
        F.avg(value).alias("m_ko")
    )


def mean_all(table: DataFrame, train: DataFrame, value: str = "d_all") -> DataFrame:
    return on_pairs(table, train).groupBy("scenario", "fold", "gene").agg(F.avg(value).alias("m_all"))


def masked_means(table: DataFrame, train: DataFrame, value: str = "d_all") -> DataFrame:
    """Per-bin, per-label and global training means from one scan (grouping sets)."""
    fold = ["scenario", "fold"]
    sets = [[*fold, "bin", "gene"], [*fold, "ko", "gene"], [*fold, "gene"]]
    return on_pairs(table, train).groupingSets(sets, "scenario", "fold", "bin", "ko", "gene").agg(
        F.avg(value).alias("mean"), F.count(F.lit(1)).alias("n_pairs")
    )
