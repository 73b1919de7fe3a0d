"""Flagship query: from raw tables to scored predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from deltascreen.operators import bulk, metrics, predictors, splits
from deltascreen.operators.scale import cut
from deltascreen.plans.registry import rounded
from deltascreen.sources.testbed import Testbed


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalise, split halves, aggregate, assign folds, predict the bin mean, score it.

    Tables that later steps read more than once are written on the way: the normalised entries,
    the cells with their halves, and the (small) group means.
    """
    tb = Testbed(spark, sf_dir)
    expr, cells = tb.stage("expr"), tb.stage("half_cells")
    ctrl = cut(bulk.control_bulk(expr, tb.qc_cells, tb.genes, tb.stage("sums")), "ctrl")
    deltas = cut(bulk.deltas(bulk.half_bulk(expr, cells, tb.genes, sums=tb.stage("sums")), ctrl), "deltas")
    genes = ctrl.select("gene").distinct()
    split = cut(splits.unseen_pert(deltas.select("bin", "ko").distinct(), 5), "folds")
    screen = predictors.Screen(deltas, ctrl, genes, split)
    predictions = predictors.run("Mean-over-perturbations", screen)
    frame = metrics.score_frame(predictions, deltas, screen.rect)
    scores = metrics.row_metrics(
        frame, ["mse", "mae", "pearson"], slices=[metrics.Slice("")])
    return rounded(scores, "value")
