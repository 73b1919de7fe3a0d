"""The three end-to-end jobs: preprocess a screen, benchmark predictors, report normalised scores.

Each stage is a table under ``root``, stamped with its parameters; a rerun with the same
parameters reads the finished stages.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deltascreen.functions import labels
from deltascreen.operators import bulk, deg, entries, hvg, meta, metrics, predictors, qc, sampling, splits
from deltascreen.plans import catalogue
from deltascreen.sources import store


@dataclass(frozen=True)
class Recipe:
    dataset: str
    depth_column: str | None = None
    batch_column: str | None = "batch"
    guide_column: str | None = None
    min_genes: int = 200
    mito_max: float | None = None
    mito_column: str | None = None
    min_gene_cells: int = 3
    n_hvg: int = catalogue.DEFAULT_N_HVG
    floor: int = 12
    control_cap: int = 8192
    pert_cap: int | None = None
    half_seed: int = 42
    n_folds: int = 5
    scenarios: list[str] = field(default_factory=lambda: list(splits.SCENARIOS))


def preprocess(spark: SparkSession, counts: DataFrame, cells: DataFrame, recipe: Recipe, root: str) -> dict[str, DataFrame]:
    """Raw counts and cells -> panel expression, halves, folds, group means, deltas, effects, weights.

    Feature selection comes before the draw, so the panel does not depend on it.
    """
    parameters = asdict(recipe)
    inputs = [store.content_stamp(counts), store.content_stamp(cells)]
    stage = lambda name, build, required: store.stamped_stage(spark, root, name, parameters, build, required, inputs)
    cleaned = qc.clean_cells(cells)
    depth_totals = qc.cell_totals(counts)
    n_targets = None
    if recipe.guide_column:
        n_targets = F.size(labels.guide_targets(F.col(recipe.guide_column)))
    with_depth = qc.resolve_depth(cleaned, recipe.depth_column, depth_totals)
    retention = stage(
        "retention",
        lambda: qc.enforce(qc.count_retention(cleaned, depth_totals, recipe.depth_column)), ["retention"])
    # without a mitochondrial feature the shipped fraction serves; without either the gate is not applied
    counted = not counts.where(qc.is_mito(F.col("gene"))).limit(1).isEmpty()
    gated = counted or recipe.mito_column is not None
    fractions = qc.mito_fraction(counts, with_depth)
    if recipe.mito_column is not None:
        shipped = qc.shipped_fraction(cleaned, recipe.mito_column)
        if counted:
            fractions = qc.require_agreement(fractions, shipped)
        else:
            fractions = qc.with_shipped(fractions, shipped)
    flags = stage("qc_flags", lambda: qc.qc_flags(
        with_depth, qc.require_fractions(fractions), recipe.min_genes,
        recipe.mito_max, n_targets, apply_mito=gated), ["pass_genes"])
    audit = qc.require_audit(qc.qc_audit(flags, recipe.guide_column is not None, gated))
    audit = stage("qc_audit", lambda: audit, ["gate"])
    kept = qc.qc_keep(flags)
    kept_counts = counts.join(kept.select("cell_id"), "cell_id", "left_semi")
    targets = qc.target_genes(kept)

    def panel() -> DataFrame:
        seen = qc.filter_genes(kept_counts, targets, recipe.min_gene_cells).select("gene", "is_target")
        ranked = hvg.select_hvg(
            kept_counts.join(seen.select("gene"), "gene", "left_semi"), kept, seen, recipe.n_hvg, recipe.batch_column)
        flagged = seen.join(ranked.select("gene", "hvg"), "gene")
        return qc.panel(flagged).join(bulk.number_genes(qc.panel(flagged)), "gene")

    genes = stage("genes", panel, ["hvg", "is_target", "gene_ord"])
    drawn = stage("cells", lambda: sampling.assign_halves(
        sampling.downsample(kept, recipe.floor, recipe.control_cap, recipe.pert_cap), ["bin", "condition"],
        recipe.half_seed), ["half"])
    carried = ["bin", "condition", "half"]
    expr = stage("expr", lambda: qc.normalise(
        counts.join(genes.select("gene"), "gene", "left_semi"), drawn, depth="depth", carry=carried), ["x", *carried])
    sums = stage("sums", lambda: entries.moments(expr, carried), ["sx"])
    ctrl = stage("ctrl", lambda: bulk.control_bulk(expr, drawn, genes, sums), ["m"])
    halves = stage("bulk", lambda: bulk.half_bulk(expr, drawn, genes, sums=sums), ["m"])
    delta = stage("deltas", lambda: bulk.deltas(halves, ctrl), ["d_all"])
    pairs = delta.select("bin", "ko").distinct()
    folds = stage("pair_split", lambda: splits.all_pair_splits(pairs, recipe.n_folds).where(
        F.col("scenario").isin(recipe.scenarios)), ["label"])
    effects = stage("deg", lambda: deg.rank_test(expr, drawn, genes, kos=delta.select("ko").distinct()), ["padj"])
    weights = stage("weights", lambda: deg.gene_weights(effects.where("half = 'all'")), ["w"])
    return {
        "retention": retention, "audit": audit, "genes": genes, "cells": drawn, "expr": expr, "ctrl": ctrl,
        "bulk": halves, "deltas": delta, "pair_split": folds, "deg": effects, "weights": weights,
    }


def benchmark(
    spark: SparkSession, tables: dict[str, DataFrame], dataset: str, root: str, selector: str = "all",
    names: list[str] | None = None, mode: str = "fill", top_k: int = catalogue.TOP_K, min_set: int = 5,
    relation: DataFrame | None = None,
) -> DataFrame:
    """Fit, predict and score every selected predictor; predictions and scores are stored per
    (dataset, scenario, fold, predictor) and only recomputed partitions are replaced."""
    split = tables["pair_split"]
    screen = predictors.Screen(
        tables["deltas"], tables["ctrl"], tables["genes"], split, deg.interpolation_alpha(tables["deg"]))
    predicted = predictors.run_all(predictors.select_predictors(selector), screen).withColumn("dataset", F.lit(dataset))
    store.save_predictions(
        store.checked_predictions(predicted, tables["deltas"], tables["deltas"], tables["genes"]), f"{root}/predictions")
    stored = store.load_predictions(spark, f"{root}/predictions", tables["genes"], dataset=dataset)
    scores = metrics.score(
        stored.drop("dataset"), tables["deltas"], screen.rect, tables["weights"],
        names or [m.name for m in catalogue.headline_metrics()], splits.test_pairs(split), mode, top_k, min_set,
        relation, tables["ctrl"])
    roster = predictors.roster(spark)
    ran = roster.where(F.col("predictor").isin(predictors.select_predictors(selector))).select("scenario", "predictor")
    ran = split.select("scenario", "fold").distinct().join(ran, "scenario").withColumn("dataset", F.lit(dataset))
    store.upsert_scores(scores.withColumn("dataset", F.lit(dataset)), f"{root}/metrics", roster, ran)
    return store.read_scores(spark, f"{root}/metrics", roster)


def report(
    spark: SparkSession, scores: DataFrame, hardest: bool = False, keys: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Saturation, captured fraction and their clean summaries, from the stored scores.

    ``keys(bin, ko)``, the labels with a signal, choose the hardest baseline; all labels do where there are none.
    """
    table = catalogue.metric_table(spark)
    baselines = None
    if hardest:
        baselines = meta.hardest_baseline(scores, table, keys).where("is_hardest").select(
            *meta.dataset_key(scores), "scenario", F.col("predictor").alias("baseline_predictor"))
    cf = meta.captured_fraction(scores, table, baselines)
    bs = meta.baseline_saturation(scores, table, baselines)
    return {
        "bs": bs, "cf": cf,
        "bs_summary": meta.summarise(bs, "bs", [*meta.dataset_key(scores), "baseline_predictor", "metric"]),
        "cf_summary": meta.summarise(cf, "cf", [*meta.dataset_key(scores), "predictor", "baseline_predictor", "metric"]),
        "coverage": meta.coverage_summary(scores),
    }
