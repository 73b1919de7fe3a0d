"""Normalised scores, filters, summaries, coverage and set operations."""

from pyspark.sql import functions as F

from deltascreen.operators import meta, metrics, splits
from deltascreen.plans import catalogue
from deltascreen.plans.queries_metrics import HEADLINE, K, LOWER, MIN_SET, predictions, scores
from deltascreen.plans.registry import cte, query, r6, rounded

H = f"metric NOT IN ({LOWER})"
BASE_MAP = " ".join(f"WHEN '{s}' THEN '{b}'" for s, b in catalogue.DEFAULT_BASELINE.items())


def table(tb):
    return catalogue.metric_table(tb.spark)


cte("ctl", f"""
SELECT p.*, n.value AS m_neg, n.n_genes_valid AS n_neg, q.value AS m_pos, b.value AS m_base, b.predictor AS baseline_predictor, p.{H} AS h,
  CASE WHEN p.{H} THEN 1e0 ELSE 0e0 END AS perfect
FROM kept_scores p
JOIN kept_scores n ON n.predictor = 'Zero' AND n.scenario = p.scenario AND n.fold = p.fold AND n.bin = p.bin AND n.ko = p.ko AND n.metric = p.metric
JOIN kept_scores q ON q.predictor = 'Interp-duplicate' AND q.scenario = p.scenario AND q.fold = p.fold AND q.bin = p.bin AND q.ko = p.ko AND q.metric = p.metric
JOIN kept_scores b ON b.predictor = CASE p.scenario {BASE_MAP} END AND b.scenario = p.scenario AND b.fold = p.fold AND b.bin = p.bin AND b.ko = p.ko AND b.metric = p.metric
""")
cte("cf", """
SELECT *, CASE WHEN h THEN (m_base - m_neg) / (m_pos - m_neg + 1e-8) ELSE (m_neg - m_base) / (m_neg - m_pos + 1e-8) END AS bs,
  CASE WHEN abs(m_pos - m_neg) >= 1e-12 THEN CASE WHEN h THEN (value - m_base) / (m_pos - m_neg) ELSE (m_base - value) / (m_neg - m_pos) END END AS cf,
  CASE WHEN h THEN (m_pos - m_neg) / (perfect - m_neg + 1e-6) ELSE (m_neg - m_pos) / (m_neg - perfect + 1e-6) END AS drf FROM ctl
""")
CK = "predictor, scenario, fold, bin, ko, metric"
cte("clean", "SELECT * FROM cf WHERE drf > 0.2 AND CASE WHEN h THEN m_pos >= m_neg ELSE m_pos <= m_neg END")


def cf(tb):
    return tb.stage("cf", lambda: meta.captured_fraction(scores(tb), table(tb)))


CF_COLUMNS = ["predictor", "scenario", "fold", "bin", "ko", "metric"]


@query("B1_dynamic_range", f"SELECT {CK}, round(drf, 5) + 0e0 AS drf FROM cf")
def b1(tb):
    return cf(tb).select(*CF_COLUMNS, r6("drf", 5).alias("drf"))


@query("B2_baseline_saturation", "SELECT scenario, fold, bin, ko, metric, baseline_predictor, round(bs, 5) + 0e0 AS bs FROM cf WHERE predictor = baseline_predictor")
def b2(tb):
    out = meta.baseline_saturation(scores(tb), table(tb))
    return out.select("scenario", "fold", "bin", "ko", "metric", "baseline_predictor", r6("bs", 5).alias("bs"))


@query("B3_captured_fraction", f"SELECT {CK}, round(cf, 5) + 0e0 AS cf, round(bs, 5) + 0e0 AS bs FROM cf")
def b3(tb):
    out = meta.captured_fraction(scores(tb), table(tb))
    return out.select(*CF_COLUMNS, r6("cf", 5).alias("cf"), r6("bs", 5).alias("bs"))


CAND = " UNION ALL ".join(f"SELECT '{s}' AS scenario, '{c}' AS predictor, {i} AS place"
                          for s, cs in catalogue.CANDIDATE_BASELINES.items() for i, c in enumerate(cs))
cte("cand", CAND)


def hardest_sql(source):
    """Ranked candidates of every scenario, and the fallback of a scenario in which nothing can be ranked."""
    return f"""
SELECT scenario, predictor, avg_rank, row_number() OVER (PARTITION BY scenario ORDER BY avg_rank, place) = 1 AS is_hardest FROM (
  SELECT scenario, predictor, place, avg(r) AS avg_rank FROM (
    SELECT *, row_number() OVER (PARTITION BY scenario, metric ORDER BY m DESC, place) AS r FROM (
      SELECT k.scenario, k.metric, k.predictor, c.place, round(CASE WHEN k.metric = 'mse_weighted' THEN -1 ELSE 1 END * median(k.value), 9) AS m
      FROM {source} k JOIN cand c ON c.scenario = k.scenario AND c.predictor = k.predictor
      WHERE k.metric IN ('mse_weighted', 'pearson_weighted', 'ccc_weighted', 'gsea_up', 'gsea_down') GROUP BY 1, 2, 3, 4) a) b GROUP BY 1, 2, 3) r
UNION ALL SELECT k.scenario, CASE WHEN count(c.place) = 0 OR bool_or(k.predictor = CASE k.scenario {BASE_MAP} END AND c.place IS NOT NULL)
    THEN CASE k.scenario {BASE_MAP} END ELSE min_by(k.predictor, c.place) END, NULL, true
  FROM row_scores k LEFT JOIN cand c ON c.scenario = k.scenario AND c.predictor = k.predictor
  WHERE NOT EXISTS (SELECT 1 FROM {source} r JOIN cand d ON d.scenario = r.scenario AND d.predictor = r.predictor WHERE r.scenario = k.scenario
    AND r.metric IN ('mse_weighted', 'pearson_weighted', 'ccc_weighted', 'gsea_up', 'gsea_down')) GROUP BY k.scenario
"""


cte("hardest", hardest_sql("row_scores"))
cte("signal_scores", """
SELECT * FROM row_scores k WHERE EXISTS (SELECT 1 FROM fx_signal s WHERE s.e_test_p < 0.05 AND s.bin = k.bin
  AND list_sort(string_split(s.ko, '+')) = list_sort(string_split(k.ko, '+')))
""")
cte("signal_hardest", hardest_sql("signal_scores"))


@query("B4_hardest_on_signal", "SELECT scenario, predictor, round(avg_rank, 6) + 0e0 AS avg_rank, is_hardest FROM signal_hardest")
def b4c(tb):
    """Only the labels that pass the energy test rank; a scenario without any falls back."""
    return rounded(meta.hardest_baseline(scores(tb), table(tb), meta.pass_keys(tb.signal, "etest")), "avg_rank")


@query("B4_hardest_baseline", """
SELECT scenario, predictor, round(avg_rank, 6) + 0e0 AS avg_rank, is_hardest FROM hardest
""")
def b4(tb):
    return rounded(meta.hardest_baseline(scores(tb), table(tb)), "avg_rank")


@query("B4_saturation_vs_hardest", f"""
SELECT b.scenario, b.fold, b.bin, b.ko, b.metric, b.predictor AS baseline_predictor,
  round(CASE WHEN b.{H} THEN (b.value - n.value) / (q.value - n.value + 1e-8) ELSE (n.value - b.value) / (n.value - q.value + 1e-8) END, 5) + 0e0 AS bs
FROM kept_scores b JOIN hardest h ON h.is_hardest AND h.scenario = b.scenario AND h.predictor = b.predictor
JOIN kept_scores n ON n.predictor = 'Zero' AND n.scenario = b.scenario AND n.fold = b.fold AND n.bin = b.bin AND n.ko = b.ko AND n.metric = b.metric
JOIN kept_scores q ON q.predictor = 'Interp-duplicate' AND q.scenario = b.scenario AND q.fold = b.fold AND q.bin = b.bin AND q.ko = b.ko AND q.metric = b.metric
""")
def b4b(tb):
    winners = meta.hardest_baseline(scores(tb), table(tb)).where("is_hardest").select(
        "scenario", F.col("predictor").alias("baseline_predictor"))
    out = meta.baseline_saturation(scores(tb), table(tb), winners)
    return out.select("scenario", "fold", "bin", "ko", "metric", "baseline_predictor", r6("bs", 5).alias("bs"))


@query("B5_clean_filter", f"SELECT {CK} FROM clean WHERE n_genes_valid >= 10")
def b5(tb):
    return meta.filter_min_genes(meta.filter_drf(meta.filter_pos_ge_neg(cf(tb)))).select(*CF_COLUMNS)


cte("cuts", "SELECT bin, quantile_disc(snr, 0.5) AS snr, quantile_disc(rho, 0.5) AS pearson, quantile_disc(e_distance, 0.5) AS edist FROM fx_signal GROUP BY 1")


def cutoffs(tb):
    """Cut-offs as the JSON file holds them: one map from bin to limits."""
    mid = lambda c: F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {c})")
    per = tb.signal.groupBy("bin").agg(mid("snr").alias("snr"), mid("rho").alias("pearson"), mid("e_distance").alias("edist"))
    entry = F.struct("bin", F.struct("snr", "pearson", "edist"))
    return meta.explode_cutoffs(per.agg(F.map_from_entries(F.collect_list(entry)).alias("bins")))


CANON = "array_to_string(list_sort(string_split(s.ko, '+')), '+')"


@query("B6_signal_keys", f"""
SELECT 'etest' AS kind, s.bin, {CANON} AS ko FROM fx_signal s WHERE e_test_p < 0.05
UNION ALL SELECT 'snr', s.bin, {CANON} FROM fx_signal s JOIN cuts c ON c.bin = s.bin WHERE s.snr > c.snr
UNION ALL SELECT 'rho', s.bin, {CANON} FROM fx_signal s JOIN cuts c ON c.bin = s.bin WHERE s.rho > c.pearson
UNION ALL SELECT 'edist', s.bin, {CANON} FROM fx_signal s JOIN cuts c ON c.bin = s.bin WHERE s.e_distance > c.edist
UNION ALL SELECT 'fixed', s.bin, {CANON} FROM fx_signal s WHERE s.snr > 1.0
UNION ALL SELECT 'nsr_or_rho', s.bin, {CANON} FROM fx_signal s JOIN cuts c ON c.bin = s.bin WHERE s.snr > c.snr OR s.rho > c.pearson
""")
def b6(tb):
    cut, out = cutoffs(tb), None
    for kind in ("etest", "snr", "rho", "edist", "nsr_or_rho"):
        part = meta.pass_keys(tb.signal, kind, cut).withColumn("kind", F.lit(kind))
        out = part if out is None else out.unionByName(part)
    return out.unionByName(meta.pass_keys(tb.signal, "snr", threshold=1.0).withColumn("kind", F.lit("fixed"))).select("kind", "bin", "ko")


@query("J2_restrict_by_keys", f"""
SELECT {CK} FROM kept_scores k WHERE EXISTS (SELECT 1 FROM fx_signal s JOIN cuts c ON c.bin = s.bin WHERE s.bin = k.bin AND s.ko = k.ko AND (s.snr > c.snr OR s.rho > c.pearson))
""")
def j2(tb):
    return meta.restrict_by_keys(scores(tb), meta.pass_keys(tb.signal, "nsr_or_rho", cutoffs(tb))).select(*CF_COLUMNS)


cte("ov", """
SELECT scenario, bin, ko FROM (SELECT scenario, bin, ko, count(DISTINCT predictor) AS n FROM row_scores GROUP BY 1, 2, 3) a
JOIN (SELECT scenario AS s2, count(DISTINCT predictor) AS t FROM row_scores GROUP BY 1) b ON b.s2 = a.scenario WHERE n = t
""")


@query("B7_overlap", "SELECT scenario, bin, ko FROM ov")
def b7(tb):
    return meta.overlap(scores(tb), ["scenario"])


def summary_sql(source, value, groups, medians=""):
    """Summaries leave out the pooled rows."""
    g = ", ".join(groups)
    source = f"(SELECT * FROM {source} WHERE ko <> '{catalogue.GLOBAL}') z"
    bins = f"(SELECT DISTINCT bin FROM {source})"
    on = " AND ".join(f"s.{x} = w.{x}" for x in groups)
    wg = ", ".join(f"w.{x}" for x in groups)
    return f"""
SELECT {wg}, w.view, coalesce(s.n, 0) AS n, round(s.mean, 5) + 0e0 AS mean, round(s.median, 5) + 0e0 AS median, round(s.std, 5) + 0e0 AS std{medians}
FROM (SELECT * FROM (SELECT DISTINCT {g} FROM {source}) a CROSS JOIN (SELECT bin AS view FROM {bins} b UNION ALL SELECT 'combined') v) w
LEFT JOIN (SELECT {g}, coalesce(bin, 'combined') AS view, count({value}) AS n, avg({value}) AS mean, median({value}) AS median, stddev_samp({value}) AS std,
    CAST(median(n_genes_valid) AS DOUBLE) AS n_genes, CAST(median(n_genes_native) AS DOUBLE) AS n_genes_native
  FROM {source} GROUP BY GROUPING SETS (({g}, bin), ({g}))) s ON {on} AND s.view = w.view"""


@query("A8_summary_cf", summary_sql("clean", "cf", ["scenario", "predictor", "metric"]))
def a8(tb):
    out = meta.summarise(cf(tb), "cf", ["scenario", "predictor", "metric"])
    return rounded(out, "mean", "median", "std", digits=5)


cte("both_modes", """
SELECT *, 'fill' AS missing_genes, 'full' AS pert_set FROM kept_scores UNION ALL SELECT *, 'drop', 'full' FROM kept_scores
UNION ALL SELECT k.*, 'fill', 'overlapping' FROM kept_scores k JOIN ov ON ov.scenario = k.scenario AND ov.bin = k.bin AND ov.ko = k.ko
UNION ALL SELECT k.*, 'drop', 'overlapping' FROM kept_scores k JOIN ov ON ov.scenario = k.scenario AND ov.bin = k.bin AND ov.ko = k.ko
""")


@query("B8_metric_distributions", summary_sql(
    "both_modes", "value", ["scenario", "predictor", "metric", "missing_genes", "pert_set"],
    ", s.n_genes, s.n_genes_native").replace("coalesce(s.n, 0) AS n,", "coalesce(s.n, 0) AS n_perturbations,"))
def b8(tb):
    """The closed-form predictors emit every feature, so both modes have the same rows here."""
    split = tb.stage("pair_split")
    drop = metrics.score(
        predictions(tb), tb.stage("deltas"), splits.rectangle(split, "test"), tb.stage("weights"),
        HEADLINE, splits.test_pairs(split), "drop", K, MIN_SET)
    out = meta.metric_distributions(scores(tb), drop)
    return rounded(out, "mean", "median", "std", digits=5)


@query("B9_on_overlap", f"SELECT {CK}, round(cf, 5) + 0e0 AS cf FROM cf WHERE EXISTS (SELECT 1 FROM ov WHERE ov.scenario = cf.scenario AND ov.bin = cf.bin AND ov.ko = cf.ko)")
def b9(tb):
    shared = meta.overlap(scores(tb), ["scenario"])
    return meta.on_overlap(cf(tb), shared).select(*CF_COLUMNS, r6("cf", 5).alias("cf"))


@query("A11_coverage_summary", """
SELECT k.scenario, k.predictor, count(DISTINCT concat(k.bin, '|', k.ko)) AS handled, any_value(t.n) - count(DISTINCT concat(k.bin, '|', k.ko)) AS not_handled,
  round(count(DISTINCT concat(k.bin, '|', k.ko)) * 1e0 / any_value(t.n), 4) AS frac
FROM row_scores k JOIN (SELECT scenario, count(DISTINCT concat(bin, '|', ko)) AS n FROM row_scores GROUP BY 1) t ON t.scenario = k.scenario GROUP BY 1, 2
""")
def a11(tb):
    return meta.coverage_summary(scores(tb))


cte("facts", """
SELECT k.ko, (SELECT count(*) FROM ko_tok t WHERE t.ko = k.ko) AS nt, (SELECT count(*) FROM ko_tok t JOIN fx_genes g ON g.gene = t.t WHERE t.ko = k.ko) AS nk,
  len(string_split(k.ko, '+')) AS np, (SELECT count(*) FROM kos o WHERE list_contains(string_split(k.ko, '+'), o.ko)) AS npres,
  (SELECT count(*) FROM kos o WHERE o.ko = string_split(k.ko, '@')[1]) AS nb FROM kos k
""")
cte("ko_tok", "SELECT ko, trim(unnest(string_split(replace(string_split(ko, '@')[1], ';', '+'), '+'))) AS t FROM kos")
cte("roster_names", "SELECT unnest(['Additive', 'BilinearRidge', 'GlobalEpistasis', 'LatentAdditive', 'Matching-mean', 'Ridge', 'Scaled-delta', 'TargetScaling', 'TargetZero', 'Zero']) AS predictor")
cte("forecast", """
SELECT predictor, ko, CASE
  WHEN predictor = 'BilinearRidge' THEN CASE WHEN nt > 1 THEN 'single_gene_only' WHEN nk < nt THEN 'target_not_in_panel' END
  WHEN predictor = 'LatentAdditive' THEN CASE WHEN nk < nt OR nk = 0 THEN 'target_not_in_panel' END
  WHEN predictor IN ('TargetScaling', 'TargetZero') THEN CASE WHEN nk = 0 THEN 'target_not_in_panel' END
  WHEN predictor IN ('Additive', 'Matching-mean', 'GlobalEpistasis') THEN CASE WHEN np <> 2 THEN 'combo_arity' WHEN npres < 2 THEN 'combo_component_missing' END
  WHEN predictor = 'Scaled-delta' THEN CASE WHEN ko NOT LIKE '%@%' THEN 'combo_arity' WHEN nb = 0 THEN 'combo_component_missing' END END AS reason
FROM facts CROSS JOIN roster_names
""")
NAMES = ["Additive", "BilinearRidge", "GlobalEpistasis", "LatentAdditive", "Matching-mean", "Ridge", "Scaled-delta",
         "TargetScaling", "TargetZero", "Zero"]


def forecast(tb):
    names = tb.spark.createDataFrame([(n,) for n in NAMES], "predictor string")
    return meta.handles(tb.kos, tb.stage("genes"), names)


@query("B11_handles", "SELECT predictor, ko, reason IS NULL AS ok, reason FROM forecast")
def b11(tb):
    return forecast(tb)


@query("B10_coverage", """
SELECT d.scenario, d.bin, d.ko, d.fold, array_to_string(d.hb, ',') AS handled_by, len(d.hb) = len(e.all_p) AS in_overlap,
  array_to_string(list_transform(list_filter(e.all_p, lambda p: NOT list_contains(d.hb, p)), lambda p: concat(p, '=',
    coalesce(list_filter(f.rs, lambda r: r.predictor = p)[1].reason, 'no_valid_prediction'))), ',') AS reasons
FROM (SELECT scenario, bin, ko, min(fold) AS fold, list_sort(list(DISTINCT predictor)) AS hb FROM row_scores GROUP BY 1, 2, 3) d
JOIN (SELECT scenario, list_sort(list(DISTINCT predictor)) AS all_p FROM row_scores GROUP BY 1) e ON e.scenario = d.scenario
LEFT JOIN (SELECT ko, list({'predictor': predictor, 'reason': reason}) FILTER (reason IS NOT NULL) AS rs FROM forecast GROUP BY 1) f ON f.ko = d.ko
""")
def b10(tb):
    c = meta.coverage(scores(tb), forecast(tb))
    entries = F.transform(F.map_entries("not_handled_by"), lambda e: F.concat(e.key, F.lit("="), e.value.reason))
    return c.select("scenario", "bin", "ko", "fold", F.array_join("handled_by", ",").alias("handled_by"), "in_overlap",
                    F.coalesce(F.array_join(F.array_sort(entries), ","), F.lit("")).alias("reasons"))


@query("B10_coverage_json", None)
def b10b(tb):
    return meta.coverage_json(meta.coverage(scores(tb), forecast(tb)))


# ---- joins and set operations not covered above ---------------------------------------------
@query("J1_control_join", f"SELECT {CK}, round(m_neg, 6) + 0e0 AS m_neg, round(m_pos, 6) + 0e0 AS m_pos, round(m_base, 6) + 0e0 AS m_base, n_neg FROM ctl")
def j1(tb):
    out = meta.with_controls(scores(tb), table(tb))
    return rounded(out, "m_neg", "m_pos", "m_base").select(*CF_COLUMNS, "m_neg", "m_pos", "m_base", "n_neg")


@query("J11_fallback_mean", """
SELECT r.scenario, r.fold, r.bin, a.gene, round(coalesce(b.m, a.m), 6) + 0e0 AS mean FROM (SELECT DISTINCT scenario, fold, bin FROM rect) r
JOIN mean_all a ON a.scenario = r.scenario AND a.fold = r.fold LEFT JOIN mean_bin b ON b.scenario = r.scenario AND b.fold = r.fold AND b.bin = r.bin AND b.gene = a.gene
""")
def j11(tb):
    from deltascreen.operators import bulk

    split = tb.stage("pair_split")
    train, fold = splits.train_pairs(split), ["scenario", "fold"]
    bins = splits.rectangle(split, "test").select(*fold, "bin").distinct()
    rows = bins.join(bulk.mean_all(tb.stage("deltas"), train), fold).join(
        bulk.mean_per_bin(tb.stage("deltas"), train), [*fold, "bin", "gene"], "left")
    return rows.select(*fold, "bin", "gene", r6(F.coalesce("m_bin", "m_all")).alias("mean"))


@query("U1_gene_intersection", """
SELECT gene FROM (SELECT DISTINCT gene FROM fx_counts k JOIN fx_cells c ON c.cell_id = k.cell_id WHERE c.bin = 'bin_O'
INTERSECT SELECT DISTINCT gene FROM fx_counts k JOIN fx_cells c ON c.cell_id = k.cell_id WHERE c.bin = 'bin_F') q
""")
def u1(tb):
    has = tb.counts.join(tb.cells.select("cell_id", "bin"), "cell_id")
    of = lambda b: has.where(F.col("bin") == b).select("gene")
    return of("bin_O").intersect(of("bin_F"))


@query("U3_missing_targets", """
SELECT DISTINCT trim(t) AS gene FROM (SELECT unnest(string_split(replace(string_split(condition, '@')[1], ';', '+'), '+')) AS t FROM fx_cells WHERE condition <> 'control') q
EXCEPT SELECT gene FROM fx_genes
""")
def u3(tb):
    from deltascreen.operators import qc

    return qc.target_genes(tb.cells).subtract(tb.genes.select("gene"))


@query("flagship_unseen_pert", f"""
SELECT scenario, fold, predictor, bin, ko, metric, round(value, 6) + 0e0 AS value, CAST(25 AS BIGINT) AS n_genes_valid, CAST(25 AS BIGINT) AS n_genes_native
FROM m_flag
""")
def flag(tb):
    from deltascreen.plans.flagship import flagship

    return flagship(tb.spark, tb.dir)


cte("flag_rows", """
SELECT 'Mean-over-perturbations' AS predictor, g.scenario, g.fold, g.bin, g.ko, g.gene, m.m AS p, g.d_first AS t FROM grid g
JOIN mean_bin m ON m.scenario = g.scenario AND m.fold = g.fold AND m.bin = g.bin AND m.gene = g.gene WHERE g.scenario = 'UnseenPert'
""")
cte("m_flag", """
SELECT predictor, scenario, fold, bin, ko, 'mse' AS metric, avg((p - t) * (p - t)) AS value FROM flag_rows GROUP BY 1, 2, 3, 4, 5
UNION ALL SELECT predictor, scenario, fold, bin, ko, 'mae', avg(abs(p - t)) FROM flag_rows GROUP BY 1, 2, 3, 4, 5
UNION ALL SELECT predictor, scenario, fold, bin, ko, 'pearson', corr(p, t) FROM flag_rows GROUP BY 1, 2, 3, 4, 5
""")
