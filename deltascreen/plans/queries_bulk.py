"""Grouped sums, group means, deltas and differential effect."""

from pyspark.sql import functions as F

from deltascreen.functions import labels as L
from deltascreen.operators import bulk, deg, entries, hvg, splits
from deltascreen.plans.registry import cte, query, r6, rounded


@query("A1_grouped_sum", """
SELECT h.bin, h.condition, e.gene, round(sum(x), 6) + 0e0 AS sx, round(sum(x * x), 6) + 0e0 AS sxx, count(*) AS nnz
FROM fx_expr e JOIN hcells h ON h.cell_id = e.cell_id GROUP BY 1, 2, 3
""")
def a1(tb):
    return rounded(entries.roll_up(tb.stage("sums"), ["bin", "condition"]).drop("sc", "scc"), "sx", "sxx")


@query("A2_grouped_sum_sq", """
SELECT gene, round(sum(x), 6) + 0e0 AS sx, round(sum(x * x), 6) + 0e0 AS sxx, count(*) AS nnz, batch
FROM fx_expr e JOIN hcells h ON h.cell_id = e.cell_id GROUP BY gene, batch
""")
def a2(tb):
    return rounded(entries.roll_up(tb.stage("sums"), ["batch"]).drop("sc", "scc"), "sx", "sxx")


@query("A3_pseudobulk", "SELECT bin, ko, half, gene, round(m, 6) + 0e0 AS m, n_cells FROM bulk")
def a3(tb):
    return rounded(bulk.half_bulk(tb.stage("expr"), tb.stage("half_cells"), tb.genes, sums=tb.stage("sums")), "m")


@query("A3_control_bulk", "SELECT bin, gene, round(m, 6) + 0e0 AS m, n_cells FROM ctrl_bulk")
def a3b(tb):
    return rounded(bulk.control_bulk(tb.stage("expr"), tb.qc_cells, tb.genes, tb.stage("sums")), "m")


@query("A4_deltas", """
SELECT bin, ko, gene, round(d_all, 6) + 0e0 AS d_all, round(d_first, 6) + 0e0 AS d_first, round(d_second, 6) + 0e0 AS d_second,
  round(m_all, 6) + 0e0 AS m_all, round(ctrl, 6) + 0e0 AS ctrl FROM deltas
""")
def a4(tb):
    b = bulk.half_bulk(tb.stage("expr"), tb.stage("half_cells"), tb.genes, sums=tb.stage("sums"))
    d = bulk.deltas(b, bulk.control_bulk(tb.stage("expr"), tb.qc_cells, tb.genes, tb.stage("sums")))
    return rounded(d, "d_all", "d_first", "d_second", "m_all", "ctrl")


@query("A6_masked_means", """
SELECT t.scenario, t.fold, t.bin, t.ko, d.gene, round(avg(d.d_all), 6) + 0e0 AS mean, count(*) AS n_pairs
FROM train t JOIN deltas d ON d.bin = t.bin AND d.ko = t.ko
GROUP BY GROUPING SETS ((t.scenario, t.fold, t.bin, d.gene), (t.scenario, t.fold, t.ko, d.gene), (t.scenario, t.fold, d.gene))
""")
def a6(tb):
    return rounded(
        bulk.masked_means(tb.stage("deltas"), splits.train_pairs(tb.stage("pair_split"))), "mean"
    )


@query("A9_norm_stats", "SELECT scenario, fold, gene, round(mu, 6) + 0e0 AS mu, round(sigma, 6) + 0e0 AS sigma, n_samples FROM norm_stats")
def a9(tb):
    from deltascreen.operators import training

    return rounded(training.norm_stats(tb.stage("deltas"), tb.stage("ctrl"), tb.stage("pair_split")), "mu", "sigma")


@query("A12_value_counts", "SELECT bin, condition, half, count(*) AS n FROM hcells GROUP BY 1, 2, 3")
def a12(tb):
    return tb.half_cells.groupBy("bin", "condition", "half").agg(F.count(F.lit(1)).alias("n"))


# ---- differential effect -----------------------------------------------------------------
@query("T1_rank_test", """
SELECT bin, half, ko, gene, round(u, 6) + 0e0 AS u, round(z, 6) + 0e0 AS z, round(p, 6) + 0e0 AS p FROM de_p
""")
def t1(tb):
    stats = deg.rank_statistics(tb.stage("expr"), tb.stage("half_cells"), tb.stage("genes"), kos=tb.kos)
    return rounded(stats, "u", "z", "p").select("bin", "half", "ko", "gene", "u", "z", "p")


@query("T1_rank_test_continuity", """
SELECT bin, half, ko, gene, round(CASE WHEN var > 1e-9 THEN sign(z * sqrt(var)) * greatest(abs(z) * sqrt(var) - 0.5e0, 0e0) / sqrt(var)
  ELSE 0e0 END, 6) + 0e0 AS z FROM de_z
""")
def t1b(tb):
    stats = deg.rank_statistics(
        tb.stage("expr"), tb.stage("half_cells"), tb.stage("genes"), kos=tb.kos, continuity=True
    )
    return rounded(stats, "z").select("bin", "half", "ko", "gene", "z")


@query("T2_fold_change", "SELECT bin, half, ko, gene, round(fc, 6) + 0e0 AS fc, substituted FROM de_z")
def t2(tb):
    stats = deg.rank_statistics(tb.stage("expr"), tb.stage("half_cells"), tb.stage("genes"), kos=tb.kos)
    return rounded(stats, "fc").select("bin", "half", "ko", "gene", "fc", "substituted")


@query("T3_scores", """
SELECT bin, half, ko, gene, round(score, 6) + 0e0 AS log2fc,
  round(sign(score) * -log10(least(greatest(p, 1e-300), 1)), 6) + 0e0 AS signed FROM deg
""")
def t3(tb):
    d = tb.stage("deg")
    return d.select(
        "bin", "half", "ko", "gene", r6(deg.effect_score()).alias("log2fc"),
        r6(deg.effect_score("signed_neglog10p")).alias("signed"),
    )


cte("welch", """
SELECT bin, half, ko, gene, n, CASE WHEN vg + vr > 0 THEN (mg - mr) / sqrt(vg + vr) ELSE 0e0 END AS t,
  CASE WHEN vg * vg + vr * vr > 0 THEN (vg + vr) * (vg + vr) / ((vg * vg + vr * vr) / greatest(n - 1, 1)) ELSE greatest(2e0 * n - 2, 1) END AS df
FROM (SELECT *, s / n AS mg, (ts - s) / (tn - n) AS mr,
        (q / n - (s / n) * (s / n)) * n / (n - 1) / n AS vg,
        ((tq - q) / (tn - n) - ((ts - s) / (tn - n)) * ((ts - s) / (tn - n))) * (tn - n) / (tn - n - 1) / n AS vr
  FROM (SELECT g.bin, g.half, g.ko, g.gene, CAST(g.n AS DOUBLE) AS n, coalesce(x.s, 0) AS s, coalesce(x.q, 0) AS q,
          sum(g.n) OVER w * 1e0 AS tn, sum(coalesce(x.s, 0)) OVER w AS ts, sum(coalesce(x.q, 0)) OVER w AS tq
        FROM (SELECT h.bin, h.half, h.condition AS ko, gg.gene, count(*) AS n FROM hcells h CROSS JOIN fx_genes gg
              WHERE h.condition IN (SELECT ko FROM ko_set) GROUP BY 1, 2, 3, 4 HAVING count(*) >= 4) g
        LEFT JOIN (SELECT h.bin, h.half, h.condition AS ko, e.gene, sum(e.x) AS s, sum(e.x * e.x) AS q
              FROM fx_expr e JOIN hcells h ON h.cell_id = e.cell_id GROUP BY 1, 2, 3, 4) x
          ON x.bin = g.bin AND x.half = g.half AND x.ko = g.ko AND x.gene = g.gene
        WINDOW w AS (PARTITION BY g.bin, g.half, g.gene)) a) b
""")


@query("T4_welch_t", """
SELECT bin, half, ko, gene, round(t, 6) + 0e0 AS t, round(df, 5) + 0e0 AS df FROM welch
""")
def t4(tb):
    w = deg.welch_statistics(tb.stage("expr"), tb.stage("half_cells"), tb.stage("genes"), kos=tb.kos, moments=tb.stage("sums"))
    return w.select("bin", "half", "ko", "gene", r6("t").alias("t"), r6("df", 5).alias("df"))


@query("T4_welch_p")
def t4b(tb):
    w = deg.welch_test(tb.stage("expr"), tb.stage("half_cells"), tb.stage("genes"), kos=tb.kos, moments=tb.stage("sums"))
    return rounded(w, "t", "df", "p", "padj")


@query("T5_bh_rows", """
SELECT bin, half, ko, gene, round(least(1e0, min(p * m / rk) OVER (PARTITION BY bin, half, ko ORDER BY rk DESC
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 6) + 0e0 AS padj
FROM (SELECT *, count(*) OVER (PARTITION BY bin, half, ko) AS m,
        row_number() OVER (PARTITION BY bin, half, ko ORDER BY p, gene) AS rk FROM de_p) q
""")
def t5(tb):
    d = deg.bh_rows(tb.stage("deg").drop("padj"), ["bin", "half", "ko"])
    return rounded(d, "padj").select("bin", "half", "ko", "gene", "padj")


@query("T6_bh_pooled", "SELECT bin, half, ko, gene, round(padj, 6) + 0e0 AS padj FROM deg")
def t6(tb):
    d = deg.bh_pooled(tb.stage("deg").drop("padj"), ["bin", "half"], salt=["ko", "gene"])
    return rounded(d, "padj").select("bin", "half", "ko", "gene", "padj")


@query("T7_gene_weights", "SELECT bin, ko, gene, round(w, 6) + 0e0 AS w, deg, dir FROM gw")
def t7(tb):
    return rounded(deg.gene_weights(tb.called, alpha=0.2), "w")


@query("T8_minmax_weights", """
SELECT bin, ko, gene, round(pow((a - lo) / CASE WHEN hi > lo THEN hi - lo ELSE 1 END, 2), 6) + 0e0 AS w, padj < 0.05 AS deg,
  CAST(sign(round(score, 12)) AS INT) AS dir
FROM (SELECT *, abs(score) AS a, min(abs(score)) OVER (PARTITION BY bin, ko) AS lo, max(abs(score)) OVER (PARTITION BY bin, ko) AS hi
      FROM deg WHERE half = 'first_half') q
""")
def t8(tb):
    d = tb.stage("deg").where("half = 'first_half'").withColumn("score", F.round("score", 12))
    return rounded(deg.gene_weights_minmax(d), "w")


@query("T9_interp_alpha", """
SELECT bin, ko, gene, round(least(greatest(1 - padj, 0e0), 1e0), 6) + 0e0 AS alpha FROM deg WHERE half = 'second_half'
""")
def t9(tb):
    return rounded(deg.interpolation_alpha(tb.stage("deg")), "alpha")


@query("Q14_hvg")
def q14(tb):
    genes = hvg.select_hvg(tb.stage("expr"), tb.qc_cells, tb.genes, n_top=15, sums=tb.stage("sums"))
    return rounded(genes, "variance_norm")


@query("Q14_hvg_batched")
def q14b(tb):
    return rounded(hvg.select_hvg(tb.stage("expr"), tb.qc_cells, tb.genes, n_top=15, batch="batch", sums=tb.stage("sums")), "variance_norm")


@query("Q14_moments", """
SELECT batch, gene, round(s / n, 6) + 0e0 AS mean, round((q - n * (s / n) * (s / n)) / greatest(n - 1, 1), 5) + 0e0 AS var
FROM (SELECT b.batch, g.gene, any_value(b.n) * 1e0 AS n, coalesce(sum(m.cnt), 0) * 1e0 AS s, coalesce(sum(m.cnt * m.cnt), 0) * 1e0 AS q
  FROM (SELECT batch, count(*) AS n FROM qc_cells GROUP BY 1) b CROSS JOIN fx_genes g
  LEFT JOIN (SELECT h.batch, k.gene, k.cnt FROM fx_counts k JOIN qc_cells h ON h.cell_id = k.cell_id) m ON m.batch = b.batch AND m.gene = g.gene
  GROUP BY 1, 2) z
""")
def q14c(tb):
    m = hvg.moments(tb.counts, tb.qc_cells, tb.genes, "batch", tb.stage("sums"))
    return m.select("batch", "gene", r6("mean").alias("mean"), r6("var", 5).alias("var"))
