"""Metric kernels on the predictions of the closed-form predictors, and on the embeddings table."""

from pyspark.sql import functions as F

from deltascreen.operators import blocks, discrimination, lowrank, metrics, predictors, splits
from deltascreen.plans import catalogue
from deltascreen.plans.queries_predict import BENCHMARKED, screen
from deltascreen.plans.registry import cte, query, r6, rounded

TOP = catalogue.TOP_SUFFIX
K, MIN_SET = 10, 2
ROWKEY = "predictor, scenario, fold, bin, ko"
P = f"PARTITION BY {ROWKEY}"
HEADLINE = [m.name for m in catalogue.headline_metrics()]
LOWER = f"'mse', 'mse_weighted', 'mse{TOP}', 'cosine_rank', 'var_ratio_log_error'"  # lower is better
MASKED = "scenario NOT IN ('UnseenBoth', 'UnseenPair')"


def predictions(tb):
    return tb.stage("predictions", lambda: predictors.run_all(BENCHMARKED, screen(tb)))


def frame(tb):
    def build():
        split = tb.stage("pair_split")
        return metrics.score_frame(
            predictions(tb), tb.stage("deltas"), splits.rectangle(split, "test"), tb.stage("weights")
        )

    return tb.stage("frame", build)


cte("jobs", "SELECT DISTINCT predictor, scenario, fold FROM all_predictions")
cte("frame0", """
SELECT j.predictor, g.scenario, g.fold, g.bin, g.ko, g.gene, g.d_first AS t, coalesce(p.delta, 0e0) AS p,
  p.delta IS NOT NULL AS emitted, w.w, w.deg, w.dir
FROM jobs j JOIN grid g ON g.scenario = j.scenario AND g.fold = j.fold
JOIN gw w ON w.bin = g.bin AND w.ko = g.ko AND w.gene = g.gene
LEFT JOIN all_predictions p ON p.predictor = j.predictor AND p.scenario = g.scenario AND p.fold = g.fold
  AND p.bin = g.bin AND p.ko = g.ko AND p.gene = g.gene
""")
cte("fr", f"""
SELECT * FROM (SELECT *, bool_or(emitted) OVER ({P}) AS has_any, row_number() OVER ({P} ORDER BY abs(t) DESC, gene) AS rk,
  count(*) OVER ({P}) AS g, CAST(sum(CAST(emitted AS INT)) OVER ({P}) AS BIGINT) AS native FROM frame0) q WHERE has_any
""")
cte("slices", f"""
SELECT *, '' AS sfx, 1e0 AS wt FROM fr UNION ALL SELECT *, '_weighted', w FROM fr
UNION ALL SELECT *, '{TOP}', 1e0 FROM fr WHERE rk <= {K}
""")


def moment_cte(name, source):
    cte(name, f"""
SELECT {ROWKEY}, sfx, native, count(*) AS n, sum(wt) AS sw, greatest(sum(wt), 1e-8) AS ws, sum(wt * (p - t) * (p - t)) AS ee, sum(wt * abs(p - t)) AS ae,
  sum(wt * (p - mp) * (p - mp)) AS spp, sum(wt * (t - mt) * (t - mt)) AS stt, sum(wt * (p - mp) * (t - mt)) AS spt, any_value(mp) AS mp, any_value(mt) AS mt,
  sum(wt * t * t) AS tt, any_value(sdp) AS sdp, any_value(sdt) AS sdt
FROM (SELECT *, sum(wt * p) OVER w / greatest(sum(wt) OVER w, 1e-8) AS mp, sum(wt * t) OVER w / greatest(sum(wt) OVER w, 1e-8) AS mt
      FROM {source} WINDOW w AS ({P}, sfx)) q GROUP BY ALL
""".replace("GROUP BY ALL", f"GROUP BY {ROWKEY}, sfx, native"))


cte("slices2", "SELECT *, 1e0 AS sdp, 1e0 AS sdt FROM slices")
moment_cte("mom", "slices2")
cte("rank_slices", f"""
SELECT {ROWKEY}, gene, native, sfx, wt, sdp, sdt, rank() OVER (s ORDER BY hp) - 1 + (count(*) OVER (s2) - 1) / 2e0 AS p,
  rank() OVER (s ORDER BY ht) - 1 + (count(*) OVER (s3) - 1) / 2e0 AS t, m
FROM (SELECT *, CASE WHEN m THEN p ELSE -1.7976931348623157e308 END AS hp, CASE WHEN m THEN t ELSE -1.7976931348623157e308 END AS ht,
        stddev_samp(p) OVER ({P}, sfx) AS sdp, stddev_samp(t) OVER ({P}, sfx) AS sdt
      FROM (SELECT *, '' AS sfx, 1e0 AS wt, true AS m FROM fr UNION ALL SELECT *, '_weighted', w, true FROM fr
            UNION ALL SELECT *, '{TOP}', 1e0, rk <= {K} FROM fr) a) b
WINDOW s AS ({P}, sfx), s2 AS ({P}, sfx, hp), s3 AS ({P}, sfx, ht)
""")
cte("rank_kept", "SELECT * FROM rank_slices WHERE m")
moment_cte("rmom", "rank_kept")
PEARSON = "spt / greatest(sqrt(spp * stt), 1e-8)"
PARTS = {
    "mse": "SELECT *, concat('mse', sfx) AS metric, CASE WHEN sfx = '_weighted' THEN ee / ws ELSE ee / n END AS value FROM mom",
    "mae": "SELECT *, concat('mae', sfx) AS metric, CASE WHEN sfx = '_weighted' THEN ae / ws ELSE ae / n END AS value FROM mom",
    "pearson": f"SELECT *, concat('pearson', sfx) AS metric, {PEARSON} AS value FROM mom",
    "r2": "SELECT *, concat('r2', sfx) AS metric, greatest(1 - ee / greatest(stt, 1e-8), -1) AS value FROM mom",
    "r2_centered": "SELECT *, concat('r2_centered', sfx) AS metric, greatest(1 - ee / greatest(stt, 1e-8), -1) AS value FROM mom",
    "r2_uncentered": "SELECT *, concat('r2_uncentered', sfx) AS metric, 1 - ee / greatest(tt, 1e-8) AS value FROM mom",
    "ccc": """SELECT *, concat('ccc', sfx) AS metric, 2 * spt / ws / (spp / ws + stt / ws + (mp - mt) * (mp - mt) + 1e-8) AS value FROM mom""",
    "spearman": f"SELECT *, concat('spearman', sfx) AS metric, CASE WHEN sdp < 1e-8 OR sdt < 1e-8 THEN 0e0 ELSE {PEARSON} END AS value FROM rmom",
    "frac_correct_direction": f"""SELECT {ROWKEY}, native, count(*) AS n, 'frac_correct_direction' AS metric,
      sum(CASE WHEN dir <> 0 AND sign(p) = sign(dir) THEN 1 ELSE 0 END) * 1e0 / greatest(sum(CASE WHEN dir <> 0 THEN 1 ELSE 0 END), 1) AS value
      FROM fr GROUP BY {ROWKEY}, native""",
    "fold_change_gap": f"""SELECT {ROWKEY}, native, CAST(sum(n) AS BIGINT) AS n, 'fold_change_gap' AS metric, sum(m) / 4 AS value FROM (
      SELECT {ROWKEY}, native, lvl, count(*) AS n, avg(abs(p - t)) AS m FROM (SELECT *, CAST(abs(t) >= q1 AS INT) + CAST(abs(t) >= q2 AS INT) + CAST(abs(t) >= q3 AS INT) AS lvl
        FROM (SELECT *, max(abs(t)) FILTER (rk = g - floor(g * 0.25e0)) OVER ({P}) AS q1, max(abs(t)) FILTER (rk = g - floor(g * 0.5e0)) OVER ({P}) AS q2,
          max(abs(t)) FILTER (rk = g - floor(g * 0.75e0)) OVER ({P}) AS q3 FROM fr) a) b GROUP BY {ROWKEY}, native, lvl) c GROUP BY {ROWKEY}, native""",
    "effect_size_auroc": f"""SELECT {ROWKEY}, native, n, 'effect_size_auroc' AS metric,
      CASE WHEN n1 = 0 OR n1 = n THEN 0.5e0 ELSE (sr - n1 * (n1 - 1) / 2e0) / (n1 * (n - n1)) END AS value
      FROM (SELECT {ROWKEY}, native, count(*) AS n, sum(CASE WHEN abs(t) > 0.05 THEN 1 ELSE 0 END) AS n1, sum(CASE WHEN abs(t) > 0.05 THEN r ELSE 0 END) AS sr
        FROM (SELECT *, rank() OVER ({P} ORDER BY abs(p)) - 1 + (count(*) OVER ({P}, abs(p)) - 1) / 2e0 AS r FROM fr) a GROUP BY {ROWKEY}, native) b""",
}
for _name, _sign, _order in (("gsea_up", ">", "DESC"), ("gsea_down", "<", "ASC")):
    PARTS[_name] = f"""SELECT {ROWKEY}, native, count(*) AS n, '{_name}' AS metric, max(run) AS value FROM (
      SELECT *, sum(CASE WHEN hit THEN 1e0 / m ELSE -1e0 / greatest(g - m, 1) END) OVER ({P} ORDER BY p {_order}, gene ROWS UNBOUNDED PRECEDING) AS run
      FROM (SELECT *, sum(CAST(hit AS INT)) OVER ({P}) AS m FROM (SELECT *, deg AND t {_sign} 0 AS hit FROM fr) a) b WHERE m >= {MIN_SET}) c GROUP BY {ROWKEY}, native"""
COLS = f"{ROWKEY}, metric, round(value, 6) + 0e0 AS value, n AS n_genes_valid, native AS n_genes_native"


def _metric(number, bases, suffixes=("", "_weighted", TOP)):
    names = [b + s for b in bases for s in suffixes]
    listed = ", ".join(f"'{n}'" for n in names)
    sql = "\nUNION ALL\n".join(f"SELECT {COLS} FROM ({PARTS[b]}) z WHERE metric IN ({listed})" for b in bases)

    @query(f"M{number}_{bases[0]}", sql)
    def run(tb, names=names):
        out = metrics.row_metrics(frame(tb), names, "fill", K, MIN_SET, effect_threshold=0.05)
        return rounded(out, "value").select(
            *metrics.ROW, "metric", "value", "n_genes_valid", "n_genes_native"
        )


_metric(1, ["mse", "mae"])
_metric(2, ["pearson"])
_metric(3, ["r2_uncentered"])
_metric(4, ["r2", "r2_centered"])
_metric(5, ["ccc"])
_metric(6, ["spearman"])
_metric(7, ["frac_correct_direction"], ("",))
_metric(8, ["fold_change_gap"], ("",))
_metric(11, ["effect_size_auroc"], ("",))
_metric(12, ["gsea_up", "gsea_down"], ("",))

cte("var_ratio", """
SELECT predictor, scenario, fold, coalesce(quantile_disc(CASE WHEN vt >= 1e-4 THEN abs(ln(vp / (vt + 1e-8) + 1e-8)) END, 0.5), 0e0) AS value, count(*) AS n
FROM (SELECT predictor, scenario, fold, gene, var_samp(p) AS vp, var_samp(t) AS vt FROM frame0 GROUP BY 1, 2, 3, 4) q GROUP BY 1, 2, 3
""")


@query("M13_variance_ratio", "SELECT predictor, scenario, fold, round(value, 6) + 0e0 AS value, n AS n_genes FROM var_ratio")
def m13(tb):
    return rounded(metrics.variance_ratio(frame(tb)), "value")


@query("A10_masked_variance", f"""
SELECT {ROWKEY}, round(var_pop(CASE WHEN deg THEN t END), 6) + 0e0 AS v FROM fr GROUP BY {ROWKEY}
""")
def a10(tb):
    f = frame(tb)
    live = f.groupBy(*metrics.ROW).agg(F.bool_or("emitted").alias("some"), r6(F.var_pop(F.when(F.col("deg"), F.col("t")))).alias("v"))
    return live.where("some").drop("some")


@query("W1_midrank", f"""
SELECT {ROWKEY}, gene, rank() OVER ({P} ORDER BY round(p, 4)) - 1 + (count(*) OVER ({P}, round(p, 4)) - 1) / 2e0 AS r FROM frame0
""")
def w1(tb):
    f = frame(tb).withColumn("v", F.round("p", 4))
    return f.select(*metrics.ROW, "gene", metrics.midrank(F.col("v"), metrics.ROW).alias("r"))


@query("W2_top_k", f"SELECT {ROWKEY}, gene FROM fr WHERE rk <= {K}")
def w2(tb):
    from pyspark.sql import Window as W

    whole = W.partitionBy(*metrics.ROW)
    f = frame(tb).withColumn("some", F.max("emitted").over(whole)).where("some")
    top = F.row_number().over(whole.orderBy(F.abs("t").desc(), "gene")) <= K
    return f.withColumn("top", top).where("top").select(*metrics.ROW, "gene")


# ---- all-against-all: one row of the embeddings table is one profile --------------------------
cte("emb", """
SELECT CAST(vec_id AS VARCHAR) AS id, label, pos, CAST(v[pos] AS DOUBLE) AS t, CAST(nv[pos] AS DOUBLE) AS p FROM (
  SELECT e.vec_id, CAST(e.label AS VARCHAR) AS label, e.embedding AS v, n.embedding AS nv FROM embeddings e JOIN embeddings n
    ON n.vec_id = (e.vec_id + 1) % (SELECT count(*) FROM embeddings)) q CROSS JOIN (SELECT CAST(range AS INT) + 1 AS pos FROM range(64)) r
""")


def embedding_profiles(tb):
    """Truth is a vector, its prediction the next vector blended with it."""
    e = tb.table("embeddings")
    n = e.agg(F.count(F.lit(1))).scalar()
    as_double = lambda c: F.col(c).cast("array<double>")
    nxt = e.select(F.col("vec_id").alias("k"), as_double("embedding").alias("nv"))
    here = e.select("vec_id", F.col("label").cast("string").alias("label"), as_double("embedding").alias("t"),
                    ((F.col("vec_id") + 1) % n).alias("k"))
    return here.join(nxt, "k").select(
        F.col("vec_id").cast("string").alias("id"), "label", "t",
        F.zip_with("t", "nv", lambda a, b: a * 0.5 + b * 0.5).alias("p"))


cte("blend", "SELECT id, label, pos, t, 0.5e0 * t + 0.5e0 * p AS p FROM emb")
cte("nrm", "SELECT id, sqrt(sum(p * p)) + 1e-8 AS np, sqrt(sum(t * t)) + 1e-8 AS nt FROM blend GROUP BY 1")
cte("sims", """
SELECT a.id AS i, b.id AS j, sum(a.p / x.np * b.t / y.nt) AS cosine, sum(abs(a.p - b.t)) AS l1, sqrt(sum((a.p - b.t) * (a.p - b.t))) AS l2,
  sum(sign(a.p) * sign(b.t)) / ((sqrt(sum(abs(sign(a.p)))) + 1e-8) * (sqrt(sum(abs(sign(b.t)))) + 1e-8)) AS sgn
FROM blend a JOIN blend b ON a.pos = b.pos JOIN nrm x ON x.id = a.id JOIN nrm y ON y.id = b.id GROUP BY 1, 2
""")
BEATS = """
SELECT '{m}' AS metric, CAST(sum(CASE WHEN beats = 0 THEN 1 ELSE 0 END) AS DOUBLE) / count(*) AS value FROM (
  SELECT s.i, sum(CASE WHEN s.j <> s.i AND (s.d < o.d - 1e-9 OR (s.j < s.i AND abs(s.d - o.d) <= 1e-9)) THEN 1 ELSE 0 END) AS beats
  FROM (SELECT i, j, {d} AS d FROM sims) s JOIN (SELECT i, {d} AS d FROM sims WHERE i = j) o ON o.i = s.i GROUP BY 1) q
"""


@query("M9_pds", " UNION ALL ".join(BEATS.format(m=m, d=d) for m, d in (
    ("cosine", "1 - cosine"), ("l1", "l1"), ("l2", "l2"), ("sign_cosine", "1 - sgn"))))
def m9(tb):
    return discrimination.pds_by_metric(embedding_profiles(tb), [], ["cosine", "l1", "l2", "sign_cosine"])


@query("M10_cosine_rank", """
SELECT o.j AS id, round((sum(CASE WHEN s.i <> o.j AND s.cosine > o.cosine + 1e-9 THEN 1 ELSE 0 END)
  + sum(CASE WHEN s.i <> o.j AND abs(s.cosine - o.cosine) <= 1e-9 THEN 1 ELSE 0 END) / 2e0) / (count(*) - 1), 6) + 0e0 AS value
FROM sims s JOIN (SELECT j, cosine FROM sims WHERE i = j) o ON o.j = s.j GROUP BY 1
""")
def m10(tb):
    return rounded(discrimination.cosine_rank(embedding_profiles(tb), [], size=128), "value")


ENERGY = """
WITH xy AS (SELECT a.label, a.id AS i, b.id AS j, sqrt(sum((a.p - b.t) * (a.p - b.t))) AS d FROM blend a JOIN blend b ON a.pos = b.pos AND a.label = b.label GROUP BY 1, 2, 3),
xx AS (SELECT a.label, a.id AS i, b.id AS j, sqrt(sum((a.p - b.p) * (a.p - b.p))) AS d FROM blend a JOIN blend b ON a.pos = b.pos AND a.label = b.label GROUP BY 1, 2, 3),
yy AS (SELECT a.label, a.id AS i, b.id AS j, sqrt(sum((a.t - b.t) * (a.t - b.t))) AS d FROM blend a JOIN blend b ON a.pos = b.pos AND a.label = b.label GROUP BY 1, 2, 3)
SELECT c.label, round(2 * c.m - x.m - y.m, 6) + 0e0 AS value FROM (SELECT label, avg(d) AS m FROM xy GROUP BY 1) c
JOIN (SELECT label, avg(d) AS m FROM xx GROUP BY 1) x ON x.label = c.label JOIN (SELECT label, avg(d) AS m FROM yy GROUP BY 1) y ON y.label = c.label
"""


@query("M14_energy_distance", ENERGY)
def m14(tb):
    return rounded(discrimination.energy_distance(embedding_profiles(tb), ["label"]), "value")


@query("M15_energy_distance_pca")
def m15(tb):
    prof = embedding_profiles(tb)
    return rounded(discrimination.energy_distance(lowrank.project(prof, 10), []), "value")


@query("M9_pds_by_bin", None)
def m9b(tb):
    return rounded(metrics.pool_metrics(frame(tb), ["pds_cosine", "pds_l2", "pds_l1"]), "value")


cte("fnrm", f"SELECT {ROWKEY}, sqrt(sum(p * p)) + 1e-8 AS np, sqrt(sum(t * t)) + 1e-8 AS nt, bool_or(emitted) AS has_any, count(*) AS n, count(*) FILTER (emitted) AS native FROM frame0 GROUP BY {ROWKEY}")
cte("fsim", """
SELECT a.predictor, a.scenario, a.fold, a.bin, a.ko AS i, b.ko AS j, sum(a.p / x.np * b.t / y.nt) AS s
FROM frame0 a JOIN frame0 b ON a.predictor = b.predictor AND a.scenario = b.scenario AND a.fold = b.fold AND a.bin = b.bin AND a.gene = b.gene
JOIN fnrm x ON x.predictor = a.predictor AND x.scenario = a.scenario AND x.fold = a.fold AND x.bin = a.bin AND x.ko = a.ko
JOIN fnrm y ON y.predictor = b.predictor AND y.scenario = b.scenario AND y.fold = b.fold AND y.bin = b.bin AND y.ko = b.ko
GROUP BY 1, 2, 3, 4, 5, 6
""")


cte("crank", """
SELECT o.predictor, o.scenario, o.fold, o.bin, o.j AS ko, 'cosine_rank' AS metric, any_value(f.n) AS n_genes_valid, any_value(f.native) AS n_genes_native,
  (sum(CASE WHEN s.i <> o.j AND s.s > o.s + 1e-9 THEN 1 ELSE 0 END) + sum(CASE WHEN s.i <> o.j AND abs(s.s - o.s) <= 1e-9 THEN 1 ELSE 0 END) / 2e0)
    / greatest(count(*) - 1, 1) AS value
FROM fsim s JOIN (SELECT * FROM fsim WHERE i = j) o ON o.predictor = s.predictor AND o.scenario = s.scenario AND o.fold = s.fold AND o.bin = s.bin AND o.j = s.j
JOIN fnrm f ON f.predictor = o.predictor AND f.scenario = o.scenario AND f.fold = o.fold AND f.bin = o.bin AND f.ko = o.j
WHERE f.has_any GROUP BY 1, 2, 3, 4, 5
""")
cte("pds_bin", f"""
SELECT q.predictor, q.scenario, q.fold, q.bin, '{catalogue.GLOBAL}' AS ko, 'pds_cosine' AS metric, CAST(count(*) FILTER (beats = 0) AS DOUBLE) / count(*) AS value,
  any_value(g.n) AS n_genes_valid, any_value(g.n) AS n_genes_native
FROM (SELECT s.predictor, s.scenario, s.fold, s.bin, s.i, count(*) FILTER (s.j <> s.i AND (s.s > o.s + 1e-9 OR (s.j < s.i AND abs(s.s - o.s) <= 1e-9))) AS beats
  FROM fsim s JOIN (SELECT * FROM fsim WHERE i = j) o ON o.predictor = s.predictor AND o.scenario = s.scenario AND o.fold = s.fold AND o.bin = s.bin AND o.i = s.i
  GROUP BY 1, 2, 3, 4, 5) q
JOIN (SELECT predictor, scenario, fold, bin, max(n) AS n FROM fnrm GROUP BY 1, 2, 3, 4) g
  ON g.predictor = q.predictor AND g.scenario = q.scenario AND g.fold = q.fold AND g.bin = q.bin GROUP BY 1, 2, 3, 4
""")


@query("M10_cosine_rank_by_bin", f"SELECT {ROWKEY}, metric, n_genes_valid, n_genes_native, round(value, 6) + 0e0 AS value FROM crank")
def m10b(tb):
    return rounded(metrics.pool_metrics(frame(tb), ["cosine_rank"]), "value")


@query("W6_nearest_profile", """
SELECT id, ref, round(sim, 6) + 0e0 AS sim FROM (SELECT i AS id, j AS ref, s AS sim, row_number() OVER (PARTITION BY i ORDER BY round(s, 9) DESC, j) AS rk
FROM (SELECT a.id AS i, b.id AS j, sum(a.c * b.c) / sqrt(sum(a.c * a.c) * sum(b.c * b.c) + 1e-8) AS s
  FROM (SELECT id, pos, p - avg(p) OVER (PARTITION BY id) AS c FROM blend) a JOIN (SELECT id, pos, t - avg(t) OVER (PARTITION BY id) AS c FROM blend) b
  ON a.pos = b.pos GROUP BY 1, 2) q) z WHERE rk = 1
""")
def w6(tb):
    prof = embedding_profiles(tb)
    q, r = prof.select("id", F.col("p").alias("v")), prof.select("id", F.col("t").alias("v"))
    return rounded(discrimination.nearest_reference(q, r, []), "sim").select("id", "ref", "sim")


# ---- interaction, strata, feature subsets -----------------------------------------------------
cte("gi", """
SELECT g.bin, g.ko, g.gene, a.d_all AS da, b.d_all AS db, g.d_all AS dab FROM deltas g
JOIN deltas a ON a.bin = g.bin AND a.gene = g.gene AND a.ko = string_split(g.ko, '+')[1]
JOIN deltas b ON b.bin = g.bin AND b.gene = g.gene AND b.ko = string_split(g.ko, '+')[2]
WHERE len(string_split(g.ko, '+')) = 2
""")


def _all_pairs(tb):
    return tb.pairs.withColumn("scenario", F.lit("all")).withColumn("fold", F.lit(0))


@query("M16_interaction_scores", f"""
SELECT bin, ko, round(1 - sum((p - t) * (p - t)) / greatest(sum(t * t), 1e-8), 6) + 0e0 AS r2,
  count(*) FILTER (rp <= 5 AND rt <= 5) / 5e0 AS precision_at_k, round(count(*) FILTER (abs(t) > cut AND abs(p) > cut) * 1e0 / greatest(count(*) FILTER (abs(t) > cut), 1), 6) + 0e0 AS tpr
FROM (SELECT q.*, row_number() OVER (PARTITION BY q.bin, q.ko ORDER BY abs(p) DESC, gene) AS rp, row_number() OVER (PARTITION BY q.bin, q.ko ORDER BY abs(t) DESC, gene) AS rt,
        coalesce(quantile_disc(CASE WHEN t <> 0 THEN abs(t) END, 0.5) OVER (PARTITION BY q.bin, q.ko), 0.5) AS cut
      FROM (SELECT bin, ko, gene, da * db AS p, dab - da - db AS t FROM gi) q) z GROUP BY 1, 2
""")
def m16(tb):
    rows = metrics.interaction_inputs(tb.stage("deltas"), _all_pairs(tb)).select(
        "bin", "ko", "gene", (F.col("d_a") * F.col("d_b")).alias("p"), (F.col("d_ab") - F.col("d_a") - F.col("d_b")).alias("t"))
    return rounded(metrics.interaction_scores(rows, ["bin", "ko"], 5), "r2", "tpr")


@query("M16b_interaction_inputs", """
SELECT bin, ko, gene, round(da, 6) + 0e0 AS d_a, round(db, 6) + 0e0 AS d_b, round(dab, 6) + 0e0 AS d_ab FROM gi
WHERE gene IN (SELECT gene FROM fx_genes WHERE gene_ord % 2 = 0)
""")
def m16b(tb):
    rows = metrics.interaction_inputs(tb.stage("deltas"), _all_pairs(tb), tb.stage("genes").where("gene_ord % 2 = 0"))
    return rounded(rows, "d_a", "d_b", "d_ab").select("bin", "ko", "gene", "d_a", "d_b", "d_ab")


@query("W7_precision_at_k", """
SELECT bin, ko, array_to_string(list_sort(list_intersect(list(gene) FILTER (ra <= 5), list(gene) FILTER (rb <= 5))), ',') AS shared FROM
(SELECT bin, ko, gene, row_number() OVER (PARTITION BY bin, ko ORDER BY abs(d_first) DESC, gene) AS ra, row_number() OVER (PARTITION BY bin, ko ORDER BY abs(d_second) DESC, gene) AS rb FROM deltas) q GROUP BY 1, 2
""")
def w7(tb):
    from pyspark.sql import Window as W

    row = W.partitionBy("bin", "ko")
    top = lambda c: F.row_number().over(row.orderBy(F.abs(c).desc(), "gene")) <= 5
    d = tb.stage("deltas").withColumn("a", top("d_first")).withColumn("b", top("d_second")).where("a OR b")
    pick = lambda c: F.collect_list(F.when(F.col(c), F.col("gene")))
    shared = F.array_join(F.array_sort(F.array_intersect(pick("a"), pick("b"))), ",")
    return d.groupBy("bin", "ko").agg(shared.alias("shared"))


JOBKEY = "predictor, scenario, fold"


@query("M17_subtree", f"""
SELECT {JOBKEY}, round(mae_in, 6) + 0e0 AS mae_in, round(mae_out, 6) + 0e0 AS mae_out, round(mse_in, 6) + 0e0 AS mse_in, round(mse_out, 6) + 0e0 AS mse_out,
  round(mae_in / (mae_out + 1e-8), 5) + 0e0 AS ratio FROM (
SELECT {JOBKEY}, coalesce(avg(abs(p - t)) FILTER (r.dst IS NOT NULL), 0) AS mae_in, coalesce(avg(abs(p - t)) FILTER (r.dst IS NULL), 0) AS mae_out,
  coalesce(avg((p - t) * (p - t)) FILTER (r.dst IS NOT NULL), 0) AS mse_in, coalesce(avg((p - t) * (p - t)) FILTER (r.dst IS NULL), 0) AS mse_out
FROM fr f LEFT JOIN fx_relation r ON r.src = f.ko AND r.dst = f.gene WHERE f.gene <> f.ko GROUP BY {JOBKEY}) q
""")
def m17(tb):
    m = metrics.subtree_metrics(_live(tb), tb.relation, metrics.JOB)
    return rounded(rounded(m, "mae_in", "mae_out", "mse_in", "mse_out"), "ratio", digits=5)


def _live(tb):
    some = frame(tb).groupBy(*metrics.ROW).agg(F.bool_or("emitted").alias("some")).where("some")
    return frame(tb).join(some.select(*metrics.ROW), metrics.ROW, "left_semi")


@query("M18_role_mse", f"""
SELECT {JOBKEY}, coalesce(role, 'leaf') AS role, round(avg((p - t) * (p - t)), 6) + 0e0 AS mse, count(DISTINCT concat(bin, '|', ko)) AS count
FROM fr f LEFT JOIN (SELECT gene, CASE WHEN gene_ord % 3 = 0 THEN 'mr' WHEN gene_ord % 3 = 1 THEN 'tf' ELSE 'leaf' END AS role FROM fx_genes) r
  ON r.gene = string_split(f.ko, '@')[1] GROUP BY {JOBKEY}, coalesce(role, 'leaf')
""")
def m18(tb):
    m = F.col("gene_ord") % 3
    roles = tb.stage("genes").select("gene", F.when(m == 0, "mr").when(m == 1, "tf").otherwise("leaf").alias("role"))
    return rounded(metrics.role_mse(_live(tb), roles, metrics.JOB), "mse")


cte("fan", f"""
SELECT {ROWKEY}, coalesce(any_value(d.degree), 0) AS degree, avg((p - t) * (p - t)) AS mse FROM fr f
LEFT JOIN (SELECT src, CAST(count(DISTINCT dst) AS INT) AS degree FROM fx_relation WHERE src < dst GROUP BY 1) d ON d.src = string_split(f.ko, '@')[1] GROUP BY {ROWKEY}
""")


@query("M19_fanout_mse", f"""
SELECT {JOBKEY}, CASE WHEN nd <= 4 THEN CAST(degree AS VARCHAR) ELSE (
    SELECT concat(CAST(e[i] AS VARCHAR), '-', CAST(e[i + 1] AS VARCHAR)) FROM (SELECT min(x) AS i FROM (SELECT unnest(range(1, len(e))) AS x) u WHERE degree <= e[x + 1]) v) END AS stratum,
  round(avg(mse), 6) + 0e0 AS mse, count(*) AS count
FROM (SELECT f.*, q.nd, list_sort(list_distinct(list_transform(q.qs, lambda z: CAST(floor(z) AS INT)))) AS e FROM fan f JOIN
  (SELECT {JOBKEY}, count(DISTINCT degree) AS nd, quantile_cont(degree, [0, 0.25, 0.5, 0.75, 1]) AS qs FROM fan GROUP BY {JOBKEY}) q
  ON q.predictor = f.predictor AND q.scenario = f.scenario AND q.fold = f.fold) w GROUP BY ALL
""".replace("GROUP BY ALL", "GROUP BY 1, 2, 3, 4"))
def m19(tb):
    m = metrics.fanout_mse(_live(tb), tb.relation.where("src < dst"), metrics.JOB)
    return rounded(m, "mse")


cte("dropped", f"SELECT * FROM fr WHERE emitted AND (gene_ord + length(ko)) % 4 <> 0")


def _gappy(tb):
    """Predictions that miss features by a rule on feature and label, so both modes differ."""
    odd = tb.stage("genes").select("gene", "gene_ord")
    p = predictions(tb).join(odd, "gene").where((F.col("gene_ord") + F.length("ko")) % 4 != 0)
    return metrics.score_frame(
        p.drop("gene_ord"), tb.stage("deltas"), splits.rectangle(tb.stage("pair_split"), "test"), tb.stage("weights"))


GAPPED = f"SELECT {ROWKEY}, gene, t, CASE WHEN (o + length(ko)) % 4 <> 0 THEN p ELSE 0e0 END AS p, emitted AND (o + length(ko)) % 4 <> 0 AS em FROM (SELECT fr.*, fx_genes.gene_ord AS o FROM fr JOIN fx_genes ON fx_genes.gene = fr.gene) q"


@query("M20_missing_genes", f"""
SELECT {ROWKEY}, 'fill' AS mode, 'mse' AS metric, round(avg((p - t) * (p - t)), 6) + 0e0 AS value, count(*) AS n_genes_valid, count(*) FILTER (em) AS n_genes_native
FROM ({GAPPED}) a GROUP BY {ROWKEY}
UNION ALL SELECT {ROWKEY}, 'drop', 'mse', round(avg((p - t) * (p - t)), 6) + 0e0, count(*), count(*) FROM ({GAPPED}) a WHERE em GROUP BY {ROWKEY}
""")
def m20(tb):
    f = _gappy(tb)
    both = [metrics.row_metrics(f, ["mse"], mode, K).withColumn("mode", F.lit(mode)) for mode in ("fill", "drop")]
    return rounded(both[0].unionByName(both[1]), "value")


RAW = f"{ROWKEY}, metric, value, n AS n_genes_valid, native AS n_genes_native"
cte("m21", "\nUNION ALL\n".join(
    f"SELECT {RAW} FROM ({PARTS[b]}) z WHERE metric IN ('mse', 'pearson', 'mse_weighted', 'pearson_weighted', 'r2', 'ccc', 'ccc_weighted', 'r2_weighted', 'gsea_up', 'gsea_down', 'frac_correct_direction', 'mse{TOP}', 'pearson{TOP}')"
    for b in ("mse", "pearson", "r2", "ccc", "frac_correct_direction", "gsea_up", "gsea_down"))
    + f"\nUNION ALL SELECT {ROWKEY}, metric, value, n_genes_valid, n_genes_native FROM crank")
cte("row_scores", """
SELECT m.* FROM m21 m JOIN ps s ON s.scenario = m.scenario AND s.fold = m.fold AND s.bin = m.bin AND s.ko = m.ko AND s.label = 'test'
""")
cte("pool_scores", f"""
SELECT {ROWKEY}, metric, value, n_genes_valid, n_genes_native FROM pds_bin
UNION ALL SELECT predictor, scenario, fold, '{catalogue.GLOBAL}', '{catalogue.GLOBAL}', 'var_ratio_log_error', value, n, n FROM var_ratio
""")
cte("kept_scores", "SELECT * FROM row_scores UNION ALL SELECT * FROM pool_scores")


def scores(tb):
    """All headline metrics of every benchmarked predictor: rows of its test pairs, and pools over the rectangle."""
    def build():
        split = tb.stage("pair_split")
        return metrics.score(
            predictions(tb), tb.stage("deltas"), splits.rectangle(split, "test"), tb.stage("weights"),
            HEADLINE, splits.test_pairs(split), "fill", K, MIN_SET)

    return tb.stage("scores", build)


@query("M21_score_all", f"SELECT {ROWKEY}, metric, round(value, 6) + 0e0 AS value, n_genes_valid, n_genes_native FROM kept_scores")
def m21(tb):
    return rounded(scores(tb), "value")


@query("M21_headline_pools", f"SELECT {ROWKEY}, metric, round(value, 6) + 0e0 AS value, n_genes_valid, n_genes_native FROM pool_scores")
def m21b(tb):
    return rounded(scores(tb).where(F.col("ko") == catalogue.GLOBAL), "value")


@query("M22_metric_catalogue", f"""
SELECT metric, metric NOT IN ({LOWER}) AS higher_is_better, CASE WHEN metric IN ({LOWER}) THEN 0e0 ELSE 1e0 END AS perfect,
  count(*) AS n_rows, round(avg(value), 6) + 0e0 AS mean FROM kept_scores GROUP BY 1
""")
def m22(tb):
    table = catalogue.metric_table(tb.spark).where("headline")
    return scores(tb).join(table, "metric").groupBy("metric", "higher_is_better", "perfect").agg(
        F.count(F.lit(1)).alias("n_rows"), r6(F.avg("value")).alias("mean"))


cte("var_w", "SELECT gene, var_samp(d_all) AS vw FROM deltas GROUP BY 1")
cte("top_expr", "SELECT gene FROM (SELECT gene, avg(m) AS l FROM ctrl_bulk GROUP BY 1) q ORDER BY round(l, 9) DESC, gene DESC LIMIT 8")


@query("M23_feature_subsets", f"""
SELECT {ROWKEY}, metric, round(value, 6) + 0e0 AS value, n_genes_valid FROM (
SELECT {ROWKEY}, CASE WHEN r.dst IS NULL THEN 'mse_go_outside' ELSE 'mse_go_within' END AS metric, avg((p - t) * (p - t)) AS value, count(*) AS n_genes_valid
  FROM fr f LEFT JOIN fx_relation r ON r.src = f.ko AND r.dst = f.gene GROUP BY {ROWKEY}, r.dst IS NULL
UNION ALL SELECT {ROWKEY}, 'mse_top_1000_expressed_genes_global', avg((p - t) * (p - t)), count(*) FROM fr JOIN top_expr ON top_expr.gene = fr.gene GROUP BY {ROWKEY}
UNION ALL SELECT {ROWKEY}, 'mse_var_weighted', sum(vw * (p - t) * (p - t)) / greatest(sum(vw), 1e-8), count(*) FROM fr JOIN var_w ON var_w.gene = fr.gene GROUP BY {ROWKEY}
UNION ALL SELECT {ROWKEY}, 'mse_across_TF_perturbations', avg((p - t) * (p - t)), count(*) FROM fr WHERE ko IN (SELECT src FROM fx_relation) GROUP BY {ROWKEY}) z
""")
def m23(tb):
    f = metrics.with_relation(frame(tb), tb.relation, "go")
    f = metrics.with_variance(metrics.with_expressed(f, tb.stage("ctrl"), 8), tb.stage("deltas"))
    regulators = tb.relation.select(F.col("src").alias("ko")).distinct().withColumn("is_tf", F.lit(True))
    f = f.join(regulators, "ko", "left")
    slices = [*metrics.relation_slices("go"), metrics.Slice(catalogue.EXPRESSED_SUFFIX, mask=F.col("expressed")),
              metrics.Slice("_var_weighted", weight=F.col("var_w")),
              metrics.Slice("_across_TF_perturbations", mask=F.col("is_tf"))]
    out = metrics.row_metrics(f, ["mse" + s.suffix for s in slices], "fill", K, slices=slices)
    return rounded(out.drop("n_genes_native"), "value")
