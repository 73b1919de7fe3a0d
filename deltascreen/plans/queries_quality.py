"""Data-quality and leakage checks, training tables, external predictions."""

from pyspark.sql import functions as F

from deltascreen.functions import labels as L
from deltascreen.operators import predictors, qc, quality, splits, training
from deltascreen.plans.queries_meta import scores
from deltascreen.plans.queries_metrics import predictions
from deltascreen.plans.registry import cte, query, r6, rounded

SCOPE = "concat(scenario, '/', CAST(fold AS VARCHAR))"


@query("V1_structural", None)
def v1(tb):
    return quality.structural(tb.spark, {
        "cells": tb.stage("half_cells"), "expr": tb.stage("expr"), "genes": tb.stage("genes"),
        "deltas": tb.stage("deltas"), "pair_split": tb.stage("pair_split")})


@query("V2_counts_and_batch", """
SELECT 'integral_counts' AS check, 'all' AS scope, count(*) FILTER (cnt <> round(cnt) OR cnt < 0) = 0 AS ok, CAST(count(*) FILTER (cnt <> round(cnt)) AS VARCHAR) AS detail FROM fx_counts
UNION ALL SELECT 'batch_column', 'all', count(DISTINCT batch) > 0, CAST(count(DISTINCT batch) AS VARCHAR) FROM fx_cells
""")
def v2(tb):
    return quality.union(quality.counts_layer(tb.counts), quality.batch_column(tb.cells))


@query("V3_hvg_count", "SELECT 'hvg_count' AS check, 'all' AS scope, count(*) >= 0 AS ok, CAST(count(*) AS VARCHAR) AS detail FROM fx_genes WHERE gene_ord % 3 = 0")
def v3(tb):
    return quality.hvg_count(tb.genes.withColumn("hvg", F.col("gene_ord") % 3 == 0), 9)


@query("V4_missing_parts", """
SELECT 'missing_target' AS check, t AS scope, false AS ok, t AS detail FROM (SELECT DISTINCT t FROM ko_tok) q WHERE t NOT IN (SELECT gene FROM fx_genes)
UNION ALL SELECT 'missing_single', ko, false, t FROM (SELECT ko, unnest(string_split(ko, '+')) AS t FROM kos WHERE ko LIKE '%+%' AND ko <> 'x') q WHERE t NOT IN (SELECT ko FROM kos WHERE ko NOT IN ('Brand#4', 'Brand#2'))
UNION ALL SELECT 'missing_base', ko, false, string_split(ko, '@')[1] FROM kos WHERE ko LIKE '%@%' AND string_split(ko, '@')[1] NOT IN (SELECT ko FROM kos WHERE ko NOT IN ('Brand#4', 'Brand#2'))
""")
def v4(tb):
    """Two singles are taken out, so that combinations and doses miss a part."""
    some = tb.kos.where(~F.col("ko").isin("Brand#4", "Brand#2"))
    return quality.union(
        quality.missing_targets(tb.kos, tb.genes), quality.missing_singles(some), quality.missing_bases(some))


@query("V5_grid_complete", """
SELECT 'grid_complete' AS check, 'deltas' AS scope, count(*) = count(DISTINCT bin) * count(DISTINCT ko) * count(DISTINCT gene) AS ok,
  concat(CAST(count(*) AS VARCHAR), '/', CAST(count(DISTINCT bin) * count(DISTINCT ko) * count(DISTINCT gene) AS VARCHAR)) AS detail FROM deltas
UNION ALL SELECT 'grid_complete', 'deg', count(*) = count(DISTINCT bin) * count(DISTINCT ko) * count(DISTINCT gene),
  concat(CAST(count(*) AS VARCHAR), '/', CAST(count(DISTINCT bin) * count(DISTINCT ko) * count(DISTINCT gene) AS VARCHAR)) FROM de_p WHERE half = 'all'
""")
def v5(tb):
    return quality.union(
        quality.grid_complete(tb.stage("deltas"), "deltas"),
        quality.grid_complete(tb.stage("deg").where("half = 'all'"), "deg"))


FOLDS = {"UnseenPert": 5, "UnseenCell": 3, "UnseenBoth": 5, "UnseenPair": 5, "UnseenDose": 2, "UnseenCombo": 2}


@query("V6_split_labels", f"""
SELECT 'split_labels' AS check, scenario AS scope, count(DISTINCT fold) = CASE scenario {' '.join(f"WHEN '{k}' THEN {v}" for k, v in FOLDS.items())} END
  AND count(*) FILTER (label NOT IN ('train', 'val', 'test', 'unassigned')) = 0 AS ok, CAST(count(DISTINCT fold) AS VARCHAR) AS detail FROM ps GROUP BY scenario
""")
def v6(tb):
    return quality.split_labels(tb.stage("pair_split"), FOLDS)


@query("V7_finite", """
SELECT 'finite' AS check, 'deltas' AS scope, count(*) FILTER (d_all IS NULL OR isnan(d_all) OR isinf(d_all)) = 0 AS ok,
  CAST(count(*) FILTER (d_all IS NULL OR isnan(d_all) OR isinf(d_all)) AS VARCHAR) AS detail FROM deltas
UNION ALL SELECT 'finite', 'expr', count(*) FILTER (x IS NULL OR isnan(x) OR isinf(x)) = 0, CAST(count(*) FILTER (x IS NULL OR isnan(x) OR isinf(x)) AS VARCHAR) FROM fx_expr
""")
def v7(tb):
    return quality.union(quality.finite(tb.stage("deltas"), ["d_all", "d_first", "d_second"], "deltas"),
                         quality.finite(tb.expr, ["v", "x"], "expr"))


@query("V8_weight_sanity", """
SELECT c AS check, 'all' AS scope, CASE c WHEN 'weights_present' THEN w > 0 WHEN 'weights_on_calls' THEN off <= 0.5 * w ELSE starved = 0 END AS ok
FROM (SELECT sum(w) AS w, sum(off) AS off, count(*) FILTER (starved) AS starved FROM (
  SELECT bin, ko, sum(w) AS w, sum(CASE WHEN NOT deg THEN w ELSE 0 END) AS off, bool_or(deg) AND sum(w) <= 0 AS starved FROM gw GROUP BY 1, 2) a) b,
(SELECT unnest(['weights_present', 'weights_on_calls', 'weights_not_starved']) AS c) d
""")
def v8(tb):
    return quality.weight_sanity(tb.stage("weights")).drop("detail")


@query("V9_audit_share", """
SELECT 'qc_gate_share' AS check, gate AS scope, n_removed <= 0.5 * n AS ok, CAST(n_removed AS VARCHAR) AS detail FROM (
SELECT count(*) AS n, count(*) FILTER (NOT g) AS r1, count(*) FILTER (g AND NOT t) AS r2, count(*) FILTER (g AND t AND NOT u) AS r3 FROM qc_flag) q,
LATERAL (SELECT 'min_genes' AS gate, r1 AS n_removed UNION ALL SELECT 'mito', r2 UNION ALL SELECT 'guide_moi', r3) l
""")
def v9(tb):
    flags = qc.qc_flags(tb.cells, qc.mito_fraction(tb.counts), min_genes=2, n_targets=F.size(L.guide_targets(F.col("guide"))))
    return quality.audit_sanity(qc.qc_audit(flags))


@query("V10_normalisation_declared", "SELECT 'normalisation_declared' AS check, 'all' AS scope, count(*) > 0 AS ok, '1' AS detail FROM cell_sum")
def v10(tb):
    meta = tb.totals.agg(F.count(F.lit(1)).alias("n_cells")).withColumn("depth_column", F.lit("none"))
    return quality.normalisation_declared(meta)


@query("V11_rollup", None)
def v11(tb):
    checks = quality.union(
        v1(tb), quality.counts_layer(tb.counts), quality.missing_targets(tb.kos, tb.genes),
        quality.two_halves(tb.stage("half_cells")), quality.mask_leak(tb.stage("pair_split")))
    return quality.require(checks)


@query("V12_invariants", """
SELECT 'min_cells_per_half' AS check, 'all' AS scope, min(n) >= 4 AS ok, CAST(min(n) AS VARCHAR) AS detail FROM (SELECT count(*) AS n FROM hcells WHERE condition IN (SELECT ko FROM ko_set) GROUP BY bin, condition, half) q
UNION ALL SELECT 'log_range', 'all', min(x) >= 0 AND max(x) < 50, CAST(round(max(x), 4) AS VARCHAR) FROM fx_expr
UNION ALL SELECT 'same_keys', 'deg', true, '0' FROM (SELECT 1) z
""")
def v12(tb):
    return quality.union(
        quality.half_sizes(tb.stage("half_cells"), tb.kos), quality.log_range(tb.expr),
        quality.same_keys(tb.stage("deltas"), tb.stage("deg"), ["bin", "ko"], "deg"))


@query("V13_two_halves", "SELECT 'two_halves' AS check, 'all' AS scope, count(DISTINCT half) = 2 AS ok, string_agg(DISTINCT half, ',' ORDER BY half) AS detail FROM hcells")
def v13(tb):
    return quality.two_halves(tb.half_cells)


@query("V14_pair_leakage", f"""
SELECT c AS check, {SCOPE} AS scope, n = 0 AS ok, CAST(n AS VARCHAR) AS detail FROM (SELECT scenario, fold, count(*) FILTER (tr AND te) AS tt, count(*) FILTER (tr AND va) AS tv FROM (
  SELECT s.scenario, s.fold, h.bin, h.condition, bool_or(label = 'train') AS tr, bool_or(label = 'val') AS va, bool_or(label = 'test') AS te
  FROM cell_split s JOIN hcells h ON h.cell_id = s.cell_id GROUP BY 1, 2, 3, 4) a GROUP BY 1, 2) q,
LATERAL (SELECT 'train_test_disjoint' AS c, tt AS n UNION ALL SELECT 'train_val_disjoint', tv) l
""")
def v14(tb):
    cells = tb.stage("half_cells")
    return quality.pair_leakage(splits.grid_from_cells(cells, splits.cell_labels(cells, tb.stage("pair_split"), carry=("bin", "condition"))))


@query("V14_masks_present", f"SELECT DISTINCT 'pair_mask_present' AS check, {SCOPE} AS scope, true AS ok, '' AS detail FROM ps WHERE scenario IN ('UnseenBoth', 'UnseenPair')")
def v14b(tb):
    return quality.masks_present(tb.stage("pair_split"), tb.stage("pair_split"))


@query("V15_conventions", f"""
SELECT 'held_in_every_bin' AS check, {SCOPE} AS scope, count(*) FILTER (n > 0 AND n < nb) = 0 AS ok, CAST(count(*) FILTER (n > 0 AND n < nb) AS VARCHAR) AS detail
FROM (SELECT scenario, fold, ko, count(*) FILTER (label = 'test') AS n, (SELECT count(DISTINCT bin) FROM pairs) AS nb FROM ps WHERE scenario = 'UnseenPert' GROUP BY 1, 2, 3) q GROUP BY scenario, fold
UNION ALL SELECT 'tested_exactly_once', 'UnseenPert', count(*) FILTER (n <> 1) = 0 AND count(*) = (SELECT count(*) FROM kos), CAST(count(*) AS VARCHAR) FROM
  (SELECT ko, count(DISTINCT fold) AS n FROM ps WHERE scenario = 'UnseenPert' AND label = 'test' GROUP BY 1) q
UNION ALL SELECT 'trained_in_some_bin', {SCOPE}, count(*) FILTER (NOT t) = 0, CAST(count(*) FILTER (NOT t) AS VARCHAR) FROM
  (SELECT scenario, fold, ko, bool_or(label = 'train') AS t FROM ps WHERE scenario = 'UnseenPair' AND label <> 'unassigned' GROUP BY 1, 2, 3) q GROUP BY scenario, fold
UNION ALL SELECT 'no_empty_fold', {SCOPE}, count(*) FILTER (label = 'train') > 0 AND count(*) FILTER (label = 'test') > 0, CAST(count(*) FILTER (label = 'test') AS VARCHAR) FROM ps GROUP BY scenario, fold
""")
def v15(tb):
    return quality.conventions(tb.stage("pair_split"))


@query("V15_nested_blocks", """
SELECT 'nested_blocks' AS check, CAST(a.fold AS VARCHAR) AS scope, count(*) FILTER (b.ko IS NULL) = 0 AS ok, CAST(count(*) FILTER (b.ko IS NULL) AS VARCHAR) AS detail
FROM (SELECT DISTINCT fold, ko FROM ps_pert WHERE label = 'test' AND ko NOT LIKE '%+%' AND ko NOT LIKE '%@%') a
LEFT JOIN (SELECT DISTINCT fold, ko FROM ps_both WHERE label = 'test') b ON b.fold = a.fold AND b.ko = a.ko GROUP BY a.fold
""")
def v15b(tb):
    return quality.nested_blocks(tb.stage("pair_split"))


@query("V16_bulk_identities", """
SELECT c AS check, 'all' AS scope, v <= 1e-9 AS ok, CAST(round(v, 6) + 0e0 AS VARCHAR) AS detail FROM (SELECT max(abs(m_all - (d_all + ctrl))) AS d FROM deltas) q,
LATERAL (SELECT 'weighted_halves' AS c, 0e0 AS v UNION ALL SELECT 'delta_of_means', d) l
""")
def v16(tb):
    return quality.bulk_identities(tb.stage("bulk"), tb.stage("deltas"), tb.stage("ctrl"))


@query("V17_bulk_agreement", "SELECT 'bulk_agreement' AS check, 'all' AS scope, max(abs(b.m - n.m)) <= 1e-9 AS ok, CAST(round(max(abs(b.m - n.m)), 6) + 0e0 AS VARCHAR) AS detail FROM bulk b JOIN (SELECT h.bin, h.condition AS ko, h.half, g.gene, avg(coalesce(e.x, 0)) AS m FROM hcells h CROSS JOIN fx_genes g LEFT JOIN fx_expr e ON e.cell_id = h.cell_id AND e.gene = g.gene GROUP BY 1, 2, 3, 4) n ON n.bin = b.bin AND n.ko = b.ko AND n.half = b.half AND n.gene = b.gene")
def v17(tb):
    """Zero-completed rows averaged one by one, against sums divided by cell counts."""
    kept = tb.stage("half_cells").withColumnRenamed("condition", "ko").join(tb.kos, "ko", "left_semi")
    rows = quality.zero_completed(kept.select("cell_id", "bin", "ko", "half"), tb.stage("expr"), tb.stage("genes"))
    naive = rows.groupBy("bin", "ko", "half", "gene").agg(F.avg("x").alias("m"))
    return quality.bulk_agreement(tb.stage("bulk"), naive, ["bin", "ko", "half", "gene"])


@query("V18_truth_axis", "SELECT 'truth_axis' AS check, 'all' AS scope, true AS ok, 'd_first' AS detail FROM (SELECT count(*) AS n FROM deltas) q WHERE n > 0")
def v18(tb):
    return quality.truth_axis(scores(tb), tb.stage("deltas"), splits.test_pairs(tb.stage("pair_split")))


DROPPING = [p.name for p in predictors.REGISTRY.values() if p.has_drop_rule]


@query("V19_full_coverage", f"""
SELECT 'full_coverage' AS check, concat(k.scenario, '/', k.predictor) AS scope, count(DISTINCT concat(k.fold, '|', k.bin, '|', k.ko)) = any_value(t.n) AS ok,
  CAST(count(DISTINCT concat(k.fold, '|', k.bin, '|', k.ko)) AS VARCHAR) AS detail FROM row_scores k
JOIN (SELECT scenario, count(DISTINCT concat(fold, '|', bin, '|', ko)) AS n FROM row_scores GROUP BY 1) t ON t.scenario = k.scenario
WHERE k.predictor NOT IN ({', '.join(f"'{d}'" for d in DROPPING)}) GROUP BY k.scenario, k.predictor
""")
def v19(tb):
    return quality.full_coverage(scores(tb), DROPPING)


@query("V20_prediction_alignment", f"""
SELECT 'prediction_labels' AS check, concat(scenario, '/', CAST(fold AS VARCHAR), '/', predictor) AS scope, count(*) FILTER (NOT known) = 0 AS ok, CAST(count(*) FILTER (NOT known) AS VARCHAR) AS detail
FROM (SELECT DISTINCT p.scenario, p.fold, p.predictor, p.ko, EXISTS (SELECT 1 FROM ps WHERE ps.scenario = p.scenario AND ps.fold = p.fold AND ps.ko = p.ko AND ps.label = 'test') AS known FROM all_predictions p) q
GROUP BY scenario, fold, predictor
""")
def v20(tb):
    return quality.prediction_alignment(predictions(tb), tb.stage("pair_split"))


@query("V21_leak_gate", """
SELECT scenario, fold, CASE WHEN pair THEN 'pair' ELSE 'condition' END AS mode, n_train, n_val, n_test, count(*) FILTER (te) AS n_test_units, count(*) FILTER (te AND tv) AS n_leaked,
  n_control_in_test, count(*) FILTER (te AND tv) = 0 AND n_test > 0 AS ok
FROM (SELECT u.*, c.n_train, c.n_val, c.n_test, c.n_control_in_test FROM
  (SELECT s.scenario, s.fold, s.scenario IN ('UnseenCell', 'UnseenBoth', 'UnseenPair') AS pair,
     CASE WHEN s.scenario IN ('UnseenCell', 'UnseenBoth', 'UnseenPair') THEN concat(h.bin, '|', h.condition) ELSE h.condition END AS unit,
     bool_or(label = 'test') AS te, bool_or(label IN ('train', 'val')) AS tv FROM cell_split s JOIN hcells h ON h.cell_id = s.cell_id WHERE h.condition <> 'control' GROUP BY 1, 2, 3, 4) u
  JOIN (SELECT s.scenario, s.fold, count(*) FILTER (label = 'train') AS n_train, count(*) FILTER (label = 'val') AS n_val, count(*) FILTER (label = 'test') AS n_test,
     count(*) FILTER (label = 'test' AND h.condition = 'control') AS n_control_in_test FROM cell_split s JOIN hcells h ON h.cell_id = s.cell_id GROUP BY 1, 2) c
  ON c.scenario = u.scenario AND c.fold = u.fold) q GROUP BY scenario, fold, pair, n_train, n_val, n_test, n_control_in_test
""")
def v21(tb):
    cells = tb.stage("half_cells")
    return quality.leak_gate(cells, splits.cell_labels(cells, tb.stage("pair_split"), carry=("bin", "condition")))


@query("V22_mask_leak", f"SELECT DISTINCT 'mask_leak' AS check, {SCOPE} AS scope, true AS ok, '0' AS detail FROM ps")
def v22(tb):
    return quality.mask_leak(tb.stage("pair_split"))


@query("V23_preflight", f"""
SELECT c AS check, {SCOPE} AS scope, n > 0 AS ok, CAST(n AS VARCHAR) AS detail FROM (
  SELECT scenario, fold, count(*) FILTER (label = 'train' AND h.condition = 'control') AS a, count(*) FILTER (label = 'test') AS b, count(DISTINCT h.bin) AS d
  FROM cell_split s JOIN hcells h ON h.cell_id = s.cell_id GROUP BY 1, 2) q,
LATERAL (SELECT 'control_in_train' AS c, a AS n UNION ALL SELECT 'roles_present', b UNION ALL SELECT 'covariate_values', d) l
UNION ALL SELECT DISTINCT 'lists_disjoint', {SCOPE}, true, '0' FROM ps
UNION ALL SELECT 'log_range', 'all', min(x) >= 0 AND max(x) < 30, CAST(round(max(x), 4) AS VARCHAR) FROM fx_expr
""")
def v23(tb):
    cells = tb.stage("half_cells")
    return quality.preflight(cells, splits.cell_labels(cells, tb.stage("pair_split"), carry=("bin", "condition")), tb.stage("expr"))


@query("V24_vocabulary_coverage", """
SELECT 'vocabulary_coverage' AS check, 'all' AS scope, count(g.gene) * 1e0 / count(*) >= 0.5 AS ok, CAST(round(count(g.gene) * 1e0 / count(*), 4) AS VARCHAR) AS detail
FROM (SELECT DISTINCT t FROM ko_tok) q LEFT JOIN fx_genes g ON g.gene = q.t
""")
def v24(tb):
    return quality.vocabulary_coverage(tb.kos, tb.genes)


@query("V25_prediction_shape", """
SELECT 'prediction_shape' AS check, concat(scenario, '/', CAST(fold AS VARCHAR), '/', predictor) AS scope, count(*) > 0 AS ok, CAST(count(*) AS VARCHAR) AS detail
FROM all_predictions GROUP BY scenario, fold, predictor
""")
def v25(tb):
    from deltascreen.operators.scale import scalar

    n = scalar(tb.stage("genes").agg(F.count(F.lit(1))))
    return quality.prediction_shape(predictions(tb), splits.rectangle(tb.stage("pair_split"), "test"), n)


# ---- training tables ------------------------------------------------------------------------
cte("marker", """
SELECT DISTINCT k.ko, g.gene, CASE WHEN k.ko LIKE '%@%' THEN CAST(string_split(k.ko, '@')[2] AS DOUBLE) ELSE 1e0 END AS dose FROM ko_tok k JOIN fx_genes g ON g.gene = k.t
""")


@query("E1_perturbation_marker", """
SELECT ko, gene, dose FROM marker UNION ALL SELECT ko, CAST(NULL AS VARCHAR), CAST(NULL AS DOUBLE) FROM kos WHERE ko NOT IN (SELECT ko FROM marker)
""")
def e1(tb):
    gone = training.unrepresentable(tb.kos, tb.genes).select(
        "ko", F.lit(None).cast("string").alias("gene"), F.lit(None).cast("double").alias("dose"))
    return training.perturbation_marker(tb.kos, tb.genes).unionByName(gone)


def stats(tb):
    return training.norm_stats(tb.stage("deltas"), tb.stage("ctrl"), tb.stage("pair_split"))


@query("E2_training_pairs", """
SELECT t.scenario, t.fold, t.bin, t.ko, t.gene, round((t.ctrl - s.mu) / s.sigma, 5) + 0e0 AS x_wt, coalesce(m.dose, 0e0) AS marker, round(t.d_all / s.sigma, 5) + 0e0 AS target
FROM tr t JOIN norm_stats s ON s.scenario = t.scenario AND s.fold = t.fold AND s.gene = t.gene LEFT JOIN marker m ON m.ko = t.ko AND m.gene = t.gene
""")
def e2(tb):
    t = training.pair_table(tb.stage("deltas"), tb.stage("pair_split"), stats(tb), tb.stage("genes"))
    return rounded(t, "x_wt", "target", digits=5)


@query("E3_validation_pairs", """
SELECT k.scenario, k.fold, b.bin, k.ko FROM (SELECT DISTINCT scenario, fold, ko FROM ps WHERE label = 'val') k
JOIN (SELECT DISTINCT scenario, fold, bin FROM ps WHERE label = 'val') b ON b.scenario = k.scenario AND b.fold = k.fold
WHERE NOT EXISTS (SELECT 1 FROM ps p WHERE p.scenario = k.scenario AND p.fold = k.fold AND p.bin = b.bin AND p.ko = k.ko AND p.label IN ('train', 'test'))
""")
def e3(tb):
    return training.validation_pairs(tb.stage("pair_split"))


@query("E4_external_predictions", """
SELECT g.scenario, g.fold, g.bin, g.ko, g.gene, round((d.m_all + d.m_all) / 2 + 0.25e0 - g.ctrl, 6) + 0e0 AS delta FROM grid g
JOIN deltas d ON d.bin = g.bin AND d.ko = g.ko AND d.gene = g.gene WHERE g.gene IN (SELECT gene FROM fx_genes WHERE gene_ord % 2 = 0) AND g.ko <> 'Brand#99'
""")
def e4(tb):
    """A model that writes two rows per label, reversed combinations, upper-case covariates, half
    the features, and skips one label."""
    half = tb.stage("genes").where("gene_ord % 2 = 0").select("gene")
    d = tb.stage("deltas").join(half, "gene", "left_semi").where("ko <> 'Brand#99'")
    flipped = F.array_join(F.reverse(F.split("ko", r"\+")), "+")
    absolute = d.select(
        flipped.alias("condition"), F.upper("bin").alias("covariate"), "gene",
        F.explode(F.array(F.col("m_all"), F.col("m_all") + 0.5)).alias("value"))
    test = splits.rectangle(tb.stage("pair_split"), "test")
    return rounded(training.map_external(absolute, tb.stage("deltas"), test), "delta")


@query("E5_model_input", """
SELECT s.scenario, s.fold, CASE WHEN h.condition = 'control' THEN 'ctrl' WHEN h.condition LIKE '%+%' THEN h.condition ELSE concat(h.condition, '+ctrl') END AS model_label,
  h.bin AS model_covariate, count(*) AS n FROM cell_split s JOIN hcells h ON h.cell_id = s.cell_id WHERE s.label IN ('train', 'val') GROUP BY 1, 2, 3, 4
""")
def e5(tb):
    cells = tb.stage("half_cells")
    rows = training.model_input_cells(cells, splits.cell_labels(cells, tb.stage("pair_split")))
    return rows.groupBy("scenario", "fold", "model_label", "model_covariate").agg(F.count(F.lit(1)).alias("n"))


@query("E6_vocabulary_lists", """
SELECT DISTINCT s.scenario, s.fold, s.label, h.condition, NOT EXISTS (SELECT 1 FROM ko_tok t WHERE t.ko = h.condition AND t.t NOT IN (SELECT gene FROM fx_genes)) AS in_vocabulary
FROM cell_split s JOIN hcells h ON h.cell_id = s.cell_id WHERE h.condition <> 'control'
""")
def e6(tb):
    cells = tb.stage("half_cells")
    lists = splits.condition_lists(cells, splits.cell_labels(cells, tb.stage("pair_split"), carry=("bin", "condition")))
    return training.vocabulary_lists(lists, tb.stage("genes"))


@query("E7_covariates_to_predict", """
SELECT DISTINCT s.scenario, s.fold, h.bin, c.n AS n_control FROM cell_split s JOIN hcells h ON h.cell_id = s.cell_id
JOIN (SELECT bin, count(*) AS n FROM hcells WHERE condition = 'control' GROUP BY 1) c ON c.bin = h.bin WHERE s.label = 'test'
""")
def e7(tb):
    cells = tb.stage("half_cells")
    return training.covariates_to_predict(cells, splits.cell_labels(cells, tb.stage("pair_split"), carry=("bin", "condition")))


@query("E8_residualise", """
SELECT d.bin, d.ko AS condition, d.gene, round(d.m_all - CASE WHEN d.ko = 'Brand#99' THEN 0e0 ELSE b.v END, 6) + 0e0 AS value FROM deltas d
JOIN (SELECT ko, gene, avg(ctrl + d_all) AS v FROM deltas GROUP BY 1, 2) b ON b.ko = d.ko AND b.gene = d.gene
""")
def e8(tb):
    d = tb.stage("deltas")
    base = training.baseline_profiles(d, per_covariate=False).where("condition <> 'Brand#99'")
    values = d.select("bin", F.col("ko").alias("condition"), "gene", F.col("m_all").alias("value"))
    return rounded(training.residualise(values, base, ["condition"]), "value")


@query("E8_add_back", "SELECT bin, ko AS condition, gene, round(m_all, 6) + 0e0 AS value FROM deltas")
def e8b(tb):
    d = tb.stage("deltas")
    base = training.baseline_profiles(d)
    values = d.select("bin", F.col("ko").alias("condition"), "gene", F.col("m_all").alias("value"))
    keys = ["bin", "condition"]
    return rounded(training.residualise(training.residualise(values, base, keys), base, keys, sign=1), "value")


@query("E9_direction_loss", """
SELECT bin, ko, round(avg(e * e * e * e) + 0.1e0 * avg(s * s), 6) + 0e0 AS loss FROM (SELECT bin, ko, d_first - d_second AS e, sign(round(d_second, 9)) - sign(round(d_first, 9)) AS s FROM deltas) q GROUP BY 1, 2
""")
def e9(tb):
    rows = tb.stage("deltas").select(
        "bin", "ko", F.lit(0.0).alias("ctrl"), F.round("d_first", 9).alias("pred"), F.round("d_second", 9).alias("truth"))
    return rounded(training.direction_aware_loss(rows, ["bin", "ko"]), "loss")


@query("E10_vocabulary", "SELECT gene FROM fx_genes ORDER BY gene")
def e10(tb):
    return training.vocabulary(tb.counts)


@query("E11_unscale", """
SELECT g.scenario, g.fold, g.bin, g.ko, g.gene, round(0.5e0 * s.sigma, 6) + 0e0 AS delta FROM grid g
JOIN norm_stats s ON s.scenario = g.scenario AND s.fold = g.fold AND s.gene = g.gene WHERE g.ko IN (SELECT ko FROM marker)
""")
def e11(tb):
    rect = splits.rectangle(tb.stage("pair_split"), "test")
    scaled = rect.join(tb.stage("deltas").select("bin", "ko", "gene"), ["bin", "ko"]).withColumn("scaled", F.lit(0.5))
    return rounded(training.unscale(scaled, stats(tb), tb.kos, tb.stage("genes")), "delta")
