"""Label, string and scalar functions; per-row quality gates and normalisation."""

from pyspark.sql import functions as F

from deltascreen.functions import labels as L
from deltascreen.functions import numeric as N
from deltascreen.operators import qc
from deltascreen.operators.scale import scalar
from deltascreen.plans.registry import cte, long, query, r6, rounded

TOKENS = "list_transform(string_split(replace(string_split({c}, '@')[1], ';', '+'), '+'), lambda t: trim(t))"
TARGETS = "list_filter(" + TOKENS + ", lambda t: t <> '')"

cte("clean_lbl", """
SELECT cell_id, condition_raw,
  CASE WHEN lower(trim(condition_raw)) IN ('', 'nan', '*', '?', 'none', 'null') THEN NULL
       WHEN lower(trim(condition_raw)) IN ('control', 'ctrl', 'non-targeting') THEN 'control'
       WHEN len(list_filter(toks, lambda t: lower(t) IN ('', 'nan', '*', '?', 'none', 'null'))) > 0 THEN NULL
       ELSE concat(array_to_string(list_sort(toks), '+'), dose) END AS label
FROM (SELECT cell_id, condition_raw,
        list_transform(string_split(string_split(condition_raw, '@')[1], '+'),
          lambda t: regexp_replace(trim(t), '_[0-9]+$', '')) AS toks,
        CASE WHEN condition_raw LIKE '%@%' THEN concat('@', substr(condition_raw, instr(condition_raw, '@') + 1))
             ELSE '' END AS dose FROM fx_cells) q
""")


@query("F1_clean_label", "SELECT cell_id, label FROM clean_lbl")
def f1(tb):
    return tb.cells.select("cell_id", L.clean_label(F.col("condition_raw")).alias("label"))


@query("F2_is_control", """
SELECT condition_raw, lower(trim(condition_raw)) IN ('control', 'ctrl', 'non-targeting') AS is_control,
  condition_raw IN ('control', 'ctrl', 'non-targeting') OR contains(lower(condition_raw), 'ctrl') AS is_control_loose,
  count(*) AS n FROM fx_cells GROUP BY 1, 2, 3
""")
def f2(tb):
    c = F.col("condition_raw")
    return tb.cells.groupBy(
        "condition_raw", L.is_control(c).alias("is_control"), L.is_control_loose(c).alias("is_control_loose")
    ).agg(F.count(F.lit(1)).alias("n"))


@query("F3_arity", f"""
SELECT condition, CAST(CASE WHEN condition = 'control' THEN 0 ELSE len({TARGETS.format(c='condition')}) END AS INT) AS arity,
  count(*) AS n FROM fx_cells GROUP BY 1, 2
""")
def f3(tb):
    return tb.cells.groupBy("condition", L.label_arity(F.col("condition")).alias("arity")).agg(
        F.count(F.lit(1)).alias("n")
    )


@query("F4_target_tokens", f"""
SELECT condition, unnest({TARGETS.format(c='condition')}) AS target, count(*) AS n FROM fx_cells GROUP BY 1, 2
""")
def f4(tb):
    return tb.cells.select("condition", F.explode(L.target_tokens(F.col("condition"))).alias("target")).groupBy(
        "condition", "target"
    ).agg(F.count(F.lit(1)).alias("n"))


@query("F5_dose", """
SELECT condition, CASE WHEN condition LIKE '%@%' THEN coalesce(TRY_CAST(string_split(condition, '@')[-1] AS DOUBLE), 1e0)
    ELSE 1e0 END AS dose,
  CASE WHEN condition LIKE '%@%' THEN TRY_CAST(string_split(condition, '@')[2] AS DOUBLE) END AS strict_dose,
  array_to_string(string_split(string_split(condition, '@')[1], '+'), ',') AS targets,
  CASE WHEN condition LIKE '%@%' THEN string_split(condition, '@')[1] END AS base, count(*) AS n
FROM fx_cells GROUP BY ALL
""")
def f5(tb):
    c = F.col("condition")
    return tb.cells.groupBy(
        "condition", L.dose_of(c).alias("dose"), L.strict_dose(c).alias("strict_dose"),
        F.array_join(L.dose_targets(c), ",").alias("targets"), L.dose_base(c).alias("base"),
    ).agg(F.count(F.lit(1)).alias("n"))


@query("F6_combo_key", """
SELECT condition_raw, array_to_string(list_sort(string_split(condition_raw, '+')), '+') AS combo, count(*) AS n
FROM fx_cells GROUP BY 1, 2
""")
def f6(tb):
    return tb.cells.groupBy("condition_raw", L.combo_key(F.col("condition_raw")).alias("combo")).agg(
        F.count(F.lit(1)).alias("n")
    )


@query("F7_combo_key_with_guides", """
SELECT lbl, array_to_string(list_sort(string_split(
    regexp_replace(regexp_replace(lbl, '[+]([0-9]+)([+]|$)', '_\\1\\2'), '[+]([0-9]+)([+]|$)', '_\\1\\2'), '+')), '+') AS combo,
  count(*) AS n
FROM (SELECT concat(condition_raw, '+', CAST(cell_id % 3 AS VARCHAR)) AS lbl FROM fx_cells) q GROUP BY 1, 2
""")
def f7(tb):
    lbl = F.concat("condition_raw", F.lit("+"), (F.col("cell_id") % 3).cast("string"))
    return tb.cells.select(lbl.alias("lbl")).groupBy(
        "lbl", L.combo_key_with_guides(F.col("lbl")).alias("combo")
    ).agg(F.count(F.lit(1)).alias("n"))


@query("F8_singles", """
SELECT DISTINCT condition AS ko FROM fx_cells
WHERE condition <> 'control' AND condition NOT LIKE '%+%' AND condition NOT LIKE '%@%' ORDER BY 1
""")
def f8(tb):
    c = F.col("condition")
    return tb.cells.where(~L.is_control(c) & L.is_single(c)).select(c.alias("ko")).distinct().orderBy("ko")


@query("F9_guide_targets", """
SELECT guide, CASE WHEN lower(trim(guide)) IN ('', 'nan', 'none', 'null') THEN NULL ELSE
  array_to_string(list_sort(list_distinct(list_filter(
    list_transform(string_split(guide, ';'), lambda t: regexp_replace(trim(t), '_[0-9]+$', '')),
    lambda t: t <> 'NO_SITE' AND t <> ''))), ',') END AS targets, count(*) AS n
FROM fx_cells GROUP BY 1, 2
""")
def f9(tb):
    t = L.guide_targets(F.col("guide"))
    text = F.when(t.isNotNull(), F.array_join(F.array_sort(t), ","))
    return tb.cells.groupBy("guide", text.alias("targets")).agg(F.count(F.lit(1)).alias("n"))


@query("F10_guide_class", """
SELECT o_orderpriority AS class, CAST(CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1
  WHEN '3-MEDIUM' THEN 2 END AS INT) AS n_targets, count(*) AS n FROM orders GROUP BY 1, 2
""")
def f10(tb):
    mapping = {"1-URGENT": 0, "2-HIGH": 1, "3-MEDIUM": 2}
    return tb.table("orders").groupBy(
        F.col("o_orderpriority").alias("class"),
        L.guide_class_count(F.col("o_orderpriority"), mapping).alias("n_targets"),
    ).agg(F.count(F.lit(1)).alias("n"))


@query("F11_source_rules", """
SELECT raw, CASE WHEN raw LIKE '(%' THEN 'control' ELSE string_split(raw, '_')[1] END AS prefix_rule,
  replace(raw, '_', '+') AS combo_rule, flags, count(*) AS n
FROM (SELECT CASE WHEN cell_id % 9 = 0 THEN '(mod)' ELSE condition_raw END AS raw,
        CASE WHEN cell_id % 3 = 0 THEN 'control' WHEN cell_id % 3 = 1 THEN
          concat(least('NegCtrl1', condition), '+', greatest('NegCtrl1', condition)) ELSE condition END AS flags
      FROM fx_cells) q GROUP BY ALL
""")
def f11(tb):
    m = F.col("cell_id") % 3
    raw = F.when(F.col("cell_id") % 9 == 0, "(mod)").otherwise(F.col("condition_raw"))
    flags = L.condition_from_flags(
        (m == 0).cast("int"), (m == 1).cast("int"), (m == 2).cast("int"), F.lit("NegCtrl1"), F.col("condition")
    )
    return tb.cells.select(raw.alias("raw"), flags.alias("flags")).groupBy(
        "raw", L.parenthesised_control(F.col("raw")).alias("prefix_rule"),
        L.underscore_combo(F.col("raw")).alias("combo_rule"), "flags",
    ).agg(F.count(F.lit(1)).alias("n"))


@query("F12_source_filter", """
SELECT o_orderpriority, count(*) AS n FROM orders
WHERE o_orderstatus = 'O' AND lower(o_orderpriority) IN ('1-urgent', '5-low') GROUP BY 1
""")
def f12(tb):
    o = tb.table("orders")
    keep = (F.col("o_orderstatus") == "O") & F.lower("o_orderpriority").isin("1-urgent", "5-low")
    return o.where(keep).groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query("F13_elementwise_error", """
SELECT bin, ko, gene, round((d_first - d_second) * (d_first - d_second), 6) + 0e0 AS sq,
  round(abs(d_first - d_second), 6) + 0e0 AS ab,
  CAST(sign(round(d_first, 9)) = sign(round(d_second, 9)) AS INT) * 1e0 AS agree FROM deltas
""")
def f13(tb):
    p, t = F.col("d_first"), F.col("d_second")
    return tb.stage("deltas").select(
        "bin", "ko", "gene", r6(N.squared_error(p, t)).alias("sq"), r6(N.absolute_error(p, t)).alias("ab"),
        N.sign_agreement(F.round(p, 9), F.round(t, 9)).alias("agree"),
    )


@query("F14_log1p", "SELECT cell_id, gene, round(x, 6) + 0e0 AS x FROM fx_expr")
def f14(tb):
    return tb.expr.select("cell_id", "gene", r6("x").alias("x"))


@query("F15_model_labels", """
SELECT condition, m AS model_label, array_to_string(list_filter(string_split(m, '+'), lambda t: t <> 'ctrl'), ',') AS back,
  count(*) AS n
FROM (SELECT condition, CASE WHEN condition = 'control' THEN 'ctrl' WHEN condition LIKE '%+%' THEN condition
        ELSE concat(condition, '+ctrl') END AS m FROM fx_cells) q GROUP BY ALL
""")
def f15(tb):
    m = L.to_model_label(F.col("condition"))
    return tb.cells.select("condition", m.alias("model_label")).groupBy(
        "condition", "model_label", F.array_join(L.from_model_label(F.col("model_label")), ",").alias("back")
    ).agg(F.count(F.lit(1)).alias("n"))


@query("F16_gene_masks", """
SELECT d.bin, d.ko, CAST(sum(CASE WHEN abs(d_all) > 0.05 THEN 1 ELSE 0 END) AS BIGINT) AS n_effect,
  CAST(sum(CASE WHEN r.dst IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_subtree
FROM deltas d LEFT JOIN fx_relation r ON r.src = d.ko AND r.dst = d.gene GROUP BY 1, 2
""")
def f16(tb):
    rel = tb.relation.select(F.col("src").alias("ko"), F.col("dst").alias("gene"), F.lit(True).alias("inside"))
    return tb.stage("deltas").join(rel, ["ko", "gene"], "left").groupBy("bin", "ko").agg(
        F.count_if(N.effect_mask(F.col("d_all"), 0.05)).alias("n_effect"),
        F.count_if("inside").alias("n_subtree"),
    )


# ---- quality gates -----------------------------------------------------------------------
@query("Q1_label_audit", """
SELECT CASE WHEN label IS NULL THEN 'sentinel' ELSE 'cleaned' END AS category, condition_raw AS label,
  count(*) AS count, CASE WHEN label IS NULL THEN 'dropped: empty or sentinel token'
    ELSE concat('renamed to ', label) END AS reason
FROM clean_lbl c WHERE c.label IS NULL OR c.label <> condition_raw GROUP BY c.label, condition_raw
""")
def q1(tb):
    return qc.label_audit(tb.cells)


@query("Q1_clean_cells", "SELECT label AS condition, count(*) AS n FROM clean_lbl WHERE label IS NOT NULL GROUP BY 1")
def q1b(tb):
    return qc.clean_cells(tb.cells).groupBy("condition").agg(F.count(F.lit(1)).alias("n"))


@query("Q2_row_sums", "SELECT cell_id, total, n_genes FROM cell_sum")
def q2(tb):
    return tb.totals.select("cell_id", "total", "n_genes")


@query("Q3_integrality", """
SELECT 'cnt' AS layer, count(*) AS n_entries, CAST(sum(CASE WHEN cnt <> round(cnt) THEN 1 ELSE 0 END) AS BIGINT) AS n_not_integral
FROM fx_counts UNION ALL
SELECT 'x', count(*), CAST(sum(CASE WHEN x <> round(x) THEN 1 ELSE 0 END) AS BIGINT) FROM fx_expr
""")
def q3(tb):
    a = qc.integrality(tb.counts).withColumn("layer", F.lit("cnt"))
    return a.unionByName(qc.integrality(tb.expr, "x").withColumn("layer", F.lit("x")))


def _with_depths(tb):
    """Declared depths: a panel source ships twice the row sum, one candidate is constant."""
    t = F.col("total").cast("double")
    base = tb.cells.select("cell_id").join(tb.totals.select("cell_id", t.alias("total")), "cell_id")
    return base.select(
        "cell_id", F.lit(100.0).alias("UMI_count"), (F.col("total") * 2).alias("ncounts"),
        F.col("total").alias("nCount_RNA"),
    )


@query("Q4_resolve_depth", """
SELECT count(*) AS n, round(sum(depth), 6) + 0e0 AS total, round(min(depth), 6) + 0e0 AS low FROM
(SELECT total * 2e0 AS depth FROM cell_sum) q
""")
def q4(tb):
    d = qc.resolve_depth(_with_depths(tb), "ncounts")
    return d.agg(F.count(F.lit(1)).alias("n"), r6(F.sum("depth")).alias("total"), r6(F.min("depth")).alias("low"))


@query("Q5_count_retention", """
SELECT candidate, n_bad, is_constant, round(retention, 6) + 0e0 AS retention FROM (
SELECT 'UMI_count' AS candidate, CAST(0 AS BIGINT) AS n_bad, true AS is_constant, median(total / 100.0e0) AS retention FROM cell_sum
UNION ALL SELECT 'nCount_RNA', 0, false, median(total / (total * 1e0)) FROM cell_sum
UNION ALL SELECT 'ncounts', 0, false, median(total / (total * 2e0)) FROM cell_sum) q
""")
def q5(tb):
    return rounded(
        qc.depth_profile(_with_depths(tb), tb.totals, ["UMI_count", "nCount_RNA", "ncounts"]), "retention"
    )


@query("Q5_retention_choice", """
SELECT 'nCount_RNA' AS depth_column, round(median(total / (total * 1e0)), 6) + 0e0 AS retention,
  CAST(NULL AS VARCHAR) AS problem FROM cell_sum
""")
def q5b(tb):
    return rounded(
        qc.count_retention(_with_depths(tb), tb.totals, None, ["UMI_count", "nCount_RNA", "ncounts"]), "retention"
    )


@query("Q6_normalise", """
SELECT k.cell_id, k.gene, round(k.cnt * 1e4 / (s.total * 2e0), 6) + 0e0 AS v FROM fx_counts k JOIN cell_sum s ON s.cell_id = k.cell_id
""")
def q6(tb):
    d = qc.resolve_depth(_with_depths(tb), "ncounts")
    return qc.normalise(tb.counts, d).select("cell_id", "gene", r6("v").alias("v"))


cte("mito", """
SELECT cell_id, sum(CASE WHEN gene LIKE 'MT-%' OR gene LIKE 'MT\\_%' ESCAPE '\\' THEN cnt ELSE 0 END) / CAST(sum(cnt) AS DOUBLE) AS f,
  count(*) AS n_genes FROM fx_counts GROUP BY 1
""")
cte("mito_cut", """
SELECT med, mad * 1.4826e0 AS mad, least(greatest(med + 3 * mad * 1.4826e0, 0.1e0), 0.2e0) AS cutoff
FROM (SELECT m.med, median(abs(f - m.med)) AS mad FROM mito, (SELECT median(f) AS med FROM mito WHERE n_genes >= 2) m
      WHERE n_genes >= 2 GROUP BY 1) q
""")


@query("Q7_mito_fraction", "SELECT cell_id, round(f, 6) + 0e0 AS mito_frac FROM mito")
def q7(tb):
    f = qc.require_fractions(qc.mito_fraction(tb.counts))
    return f.select("cell_id", r6("mito_frac").alias("mito_frac"))


@query("Q7_cross_check", """
SELECT round(a, 6) + 0e0 AS computed, round(b, 6) + 0e0 AS shipped, CASE WHEN a > 0 AND b > 0 THEN round(a / b, 6) + 0e0 END AS ratio,
  CASE WHEN a > 0 AND b > 0 THEN a / b BETWEEN 0.67 AND 1.5 END AS ok
FROM (SELECT median(f) AS a FROM mito) x, (SELECT median(l_discount) AS b FROM lineitem) y
""")
def q7b(tb):
    shipped = tb.table("lineitem").select(F.col("l_orderkey").alias("cell_id"), F.col("l_discount").alias("pct"))
    s = qc.shipped_fraction(shipped, "pct")
    return rounded(
        qc.cross_check_fraction(qc.mito_fraction(tb.counts), s), "computed", "shipped", "ratio"
    )


@query("Q8_shipped_fraction", """
SELECT l_orderkey AS cell_id, round(sum(CASE WHEN m <= 1 THEN q ELSE q / 100e0 END), 6) + 0e0 AS s
FROM (SELECT l_orderkey, CAST(l_quantity AS DOUBLE) AS q, max(CAST(l_quantity AS DOUBLE)) OVER () AS m FROM lineitem) t GROUP BY 1
""")
def q8(tb):
    shipped = tb.table("lineitem").select(F.col("l_orderkey").alias("cell_id"), F.col("l_quantity").alias("pct"))
    return qc.shipped_fraction(shipped, "pct").groupBy("cell_id").agg(r6(F.sum("shipped")).alias("s"))


@query("Q9_mito_threshold", """
SELECT round(med, 6) + 0e0 AS median, round(mad, 6) + 0e0 AS mad, round(cutoff, 6) + 0e0 AS cutoff FROM mito_cut
""")
def q9(tb):
    f = qc.mito_fraction(tb.counts).where(F.col("n_genes") >= 2)
    return rounded(qc.mito_threshold(f), "median", "mad", "cutoff")


cte("guide_n", f"""
SELECT cell_id, condition, CASE WHEN guide = 'nan' THEN NULL WHEN guide LIKE 'NO%' THEN 0 ELSE 3 END AS n_targets,
  CASE WHEN condition = 'control' THEN 0 ELSE len({TARGETS.format(c='condition')}) END AS arity FROM fx_cells
""")


@query("Q10_guide_violation", """
SELECT count(*) AS n_cells, CAST(sum(CASE WHEN n_targets IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_unassigned,
  CAST(sum(CASE WHEN n_targets > arity THEN 1 ELSE 0 END) AS BIGINT) AS n_violations FROM guide_n
""")
def q10(tb):
    return qc.guide_summary(qc.guide_check(tb.cells, F.size(L.guide_targets(F.col("guide")))))


cte("qc_flag", """
SELECT c.cell_id, coalesce(m.n_genes, 0) >= 2 AS g, coalesce(m.f, 0) < k.cutoff AS t,
  NOT coalesce(n.n_targets > n.arity, false) AS u
FROM fx_cells c LEFT JOIN mito m ON m.cell_id = c.cell_id JOIN guide_n n ON n.cell_id = c.cell_id CROSS JOIN mito_cut k
""")


@query("Q11_qc_audit", """
SELECT n_before, n_after, gate, true AS applied, n_removed,
  CASE WHEN gate = 'mito' AND n_removed > 0.5 * greatest(at2, 1) THEN 'error'
       WHEN gate = 'mito' AND n_removed > 0.2 * greatest(at2, 1) THEN 'warning' ELSE 'ok' END AS status
FROM (SELECT count(*) AS n_before, count(*) FILTER (g AND t AND u) AS n_after, count(*) FILTER (NOT g) AS r1,
        count(*) FILTER (g AND NOT t) AS r2, count(*) FILTER (g AND t AND NOT u) AS r3, count(*) FILTER (g) AS at2
      FROM qc_flag) q,
LATERAL (SELECT 'min_genes' AS gate, r1 AS n_removed UNION ALL SELECT 'mito', r2 UNION ALL SELECT 'guide_moi', r3) l
""")
def q11(tb):
    flags = qc.qc_flags(
        tb.cells, qc.mito_fraction(tb.counts), min_genes=2, n_targets=F.size(L.guide_targets(F.col("guide")))
    )
    return qc.qc_audit(flags)


@query("Q11_qc_cells", "SELECT cell_id FROM qc_flag WHERE g AND t AND u")
def q11b(tb):
    flags = qc.qc_flags(
        tb.cells, qc.mito_fraction(tb.counts), min_genes=2, n_targets=F.size(L.guide_targets(F.col("guide")))
    )
    return qc.qc_keep(flags).select("cell_id")


@query("Q11_fixed_cutoff", """
SELECT count(*) AS n FROM fx_cells c LEFT JOIN mito m ON m.cell_id = c.cell_id
WHERE coalesce(m.n_genes, 0) >= 2 AND coalesce(m.f, 0) < 0.15
""")
def q11c(tb):
    flags = qc.qc_flags(tb.cells, qc.mito_fraction(tb.counts), min_genes=2, mito_max=0.15)
    return qc.qc_keep(flags).agg(F.count(F.lit(1)).alias("n"))


cte("targets", f"""
SELECT DISTINCT unnest({TARGETS.format(c='condition')}) AS gene FROM (SELECT DISTINCT condition FROM fx_cells WHERE condition <> 'control') q
""")


@query("Q12_gene_filter", """
SELECT gene, n AS n_cells, gene IN (SELECT gene FROM targets) AS is_target
FROM (SELECT gene, count(DISTINCT cell_id) AS n FROM fx_counts GROUP BY 1) q
WHERE n >= (SELECT count(DISTINCT cell_id) * 15 // 100 FROM fx_counts) OR gene IN (SELECT gene FROM targets)
""")
def q12(tb):
    seen = tb.counts.select("cell_id").distinct().count()
    return qc.filter_genes(tb.counts, qc.target_genes(tb.cells), min_cells=seen * 15 // 100)


@query("Q13_targets", """
SELECT g.gene, g.gene_ord, t.gene IS NOT NULL AS is_target FROM fx_genes g LEFT JOIN targets t ON t.gene = g.gene
UNION ALL SELECT gene, -1, true FROM targets WHERE gene NOT IN (SELECT gene FROM fx_genes)
""")
def q13(tb):
    t = qc.target_genes(tb.cells)
    hit = qc.annotate_targets(tb.genes, t).select("gene", "gene_ord", "is_target")
    miss = qc.missing_targets(tb.genes, t).select("gene", F.lit(-1).alias("gene_ord"), F.lit(True).alias("is_target"))
    return hit.unionByName(miss)


@query("Q15_panel", """
SELECT gene, hvg, is_target FROM (SELECT g.gene, g.gene_ord % 3 = 0 AS hvg, t.gene IS NOT NULL AS is_target
  FROM fx_genes g LEFT JOIN targets t ON t.gene = g.gene) q WHERE hvg OR is_target
""")
def q15(tb):
    g = qc.annotate_targets(tb.genes, qc.target_genes(tb.cells)).withColumn("hvg", F.col("gene_ord") % 3 == 0)
    return qc.panel(g).select("gene", "hvg", "is_target")


@query("Q17_full_coverage", "SELECT ko FROM ko_set")
def q17(tb):
    return qc.full_coverage(tb.half_cells)


@query("Q17_covered_cells", """
SELECT condition, count(*) AS n FROM hcells WHERE condition = 'control' OR condition IN (SELECT ko FROM ko_set) GROUP BY 1
""")
def q17b(tb):
    h = tb.stage("half_cells")
    return qc.restrict_to_coverage(h, qc.full_coverage(h)).groupBy("condition").agg(F.count(F.lit(1)).alias("n"))


@query("Q18_shared_perts", """
SELECT condition AS ko FROM (SELECT condition, bin, count(*) AS n FROM fx_cells WHERE condition <> 'control'
  AND bin IN ('bin_O', 'bin_F') GROUP BY 1, 2 HAVING count(*) >= 25) q GROUP BY 1 HAVING count(*) = 2
""")
def q18(tb):
    two = tb.cells.where(F.col("bin").isin("bin_O", "bin_F"))
    return qc.full_coverage(two, min_cells=25, by_half=False)


@query("Q19_subset", """
SELECT e.gene, count(*) AS n, round(sum(e.x), 6) + 0e0 AS sx FROM fx_expr e JOIN fx_genes g ON g.gene = e.gene
JOIN fx_cells c ON c.cell_id = e.cell_id WHERE g.gene_ord % 2 = 0 AND c.bin = 'bin_F' GROUP BY 1
""")
def q19(tb):
    s = qc.subset(tb.expr, tb.cells.where("bin = 'bin_F'"), tb.genes.where("gene_ord % 2 = 0"))
    return s.groupBy("gene").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("x")).alias("sx"))
