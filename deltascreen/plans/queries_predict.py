"""Predictors on every scenario they serve, against SQL."""

from dataclasses import replace

from pyspark.sql import functions as F

from deltascreen.operators import deg, predictors, trained
from deltascreen.operators.scale import fresh_path
from deltascreen.plans.registry import cte, query, r6, rounded


def screen(tb, *scenarios):
    split = tb.stage("pair_split")
    rect = tb.stage("rect")
    if scenarios:
        split = split.where(F.col("scenario").isin(*scenarios))
        rect = rect.where(F.col("scenario").isin(*scenarios))
    return predictors.Screen(
        tb.stage("deltas"), tb.stage("ctrl"), tb.stage("genes"), split,
        deg.interpolation_alpha(tb.stage("deg")), rect_table=rect,
    )


def served(name):
    return "(" + ", ".join(f"'{s}'" for s in predictors.REGISTRY[name].scenarios) + ")"


OUT = "scenario, fold, bin, ko, gene, round({v}, 6) + 0e0 AS delta"
cte("grid", """
SELECT r.scenario, r.fold, d.bin, d.ko, d.gene, d.ctrl, d.d_first, d.d_second, d.d_all FROM rect r JOIN deltas d ON d.bin = r.bin AND d.ko = r.ko
""")
cte("tr", """
SELECT t.scenario, t.fold, d.bin, d.ko, d.gene, d.d_all, d.m_all, d.ctrl FROM train t JOIN deltas d ON d.bin = t.bin AND d.ko = t.ko
""")
cte("mean_bin", "SELECT scenario, fold, bin, gene, avg(d_all) AS m FROM tr GROUP BY 1, 2, 3, 4")
cte("mean_ko", "SELECT scenario, fold, ko, gene, avg(d_all) AS m FROM tr GROUP BY 1, 2, 3, 4")
cte("mean_all", "SELECT scenario, fold, gene, avg(d_all) AS m FROM tr GROUP BY 1, 2, 3")
cte("ko_target", """
SELECT DISTINCT k.ko, g.gene FROM (SELECT ko, unnest(string_split(replace(string_split(ko, '@')[1], ';', '+'), '+')) AS t FROM kos) k
JOIN fx_genes g ON g.gene = trim(k.t)
""")
cte("tscale", """
SELECT tr.scenario, tr.fold, -sum(tr.d_all * tr.ctrl) / sum(tr.ctrl * tr.ctrl) AS a
FROM tr JOIN ko_target k ON k.ko = tr.ko AND k.gene = tr.gene GROUP BY 1, 2
""")
cte("combo_grid", """
SELECT g.scenario, g.fold, g.bin, g.ko, g.gene, a.d_all AS da, b.d_all AS db, g.d_all
FROM grid g JOIN deltas a ON a.bin = g.bin AND a.gene = g.gene AND a.ko = string_split(g.ko, '+')[1]
JOIN deltas b ON b.bin = g.bin AND b.gene = g.gene AND b.ko = string_split(g.ko, '+')[2]
WHERE len(string_split(g.ko, '+')) = 2
""")
cte("combo_train", """
SELECT g.scenario, g.fold, g.gene, a.d_all AS da, b.d_all AS db, g.d_all
FROM tr g JOIN deltas a ON a.bin = g.bin AND a.gene = g.gene AND a.ko = string_split(g.ko, '+')[1]
JOIN deltas b ON b.bin = g.bin AND b.gene = g.gene AND b.ko = string_split(g.ko, '+')[2]
WHERE len(string_split(g.ko, '+')) = 2
""")

PREDICTIONS = {
    "Zero": "SELECT *, 0e0 AS delta FROM grid",
    "Mean-over-perturbations": """SELECT g.*, m.m AS delta FROM grid g JOIN mean_bin m
      ON m.scenario = g.scenario AND m.fold = g.fold AND m.bin = g.bin AND m.gene = g.gene""",
    "Mean-over-cell-types": """SELECT g.*, m.m AS delta FROM grid g JOIN mean_ko m
      ON m.scenario = g.scenario AND m.fold = g.fold AND m.ko = g.ko AND m.gene = g.gene""",
    "Mean-over-perturbations-and-cell-types": """SELECT g.*, m.m AS delta FROM grid g JOIN mean_all m
      ON m.scenario = g.scenario AND m.fold = g.fold AND m.gene = g.gene""",
    "Two-way-mean": """SELECT g.*, b.m + k.m - a.m AS delta FROM grid g
      JOIN mean_bin b ON b.scenario = g.scenario AND b.fold = g.fold AND b.bin = g.bin AND b.gene = g.gene
      JOIN mean_ko k ON k.scenario = g.scenario AND k.fold = g.fold AND k.ko = g.ko AND k.gene = g.gene
      JOIN mean_all a ON a.scenario = g.scenario AND a.fold = g.fold AND a.gene = g.gene""",
    "Additive": "SELECT *, da + db AS delta FROM combo_grid",
    "Matching-mean": "SELECT *, (da + db) / 2 AS delta FROM combo_grid",
    "Scaled-delta": """SELECT g.scenario, g.fold, g.bin, g.ko, g.gene, CAST(string_split(g.ko, '@')[2] AS DOUBLE) * f.d_all AS delta
      FROM grid g JOIN deltas f ON f.bin = g.bin AND f.gene = g.gene AND f.ko = string_split(g.ko, '@')[1] WHERE g.ko LIKE '%@%'""",
    "TargetZero": """SELECT g.*, CASE WHEN k.gene IS NOT NULL THEN -g.ctrl ELSE 0e0 END AS delta FROM grid g
      LEFT JOIN ko_target k ON k.ko = g.ko AND k.gene = g.gene WHERE g.ko IN (SELECT ko FROM ko_target)""",
    "TargetScaling": """SELECT g.*, CASE WHEN k.gene IS NOT NULL THEN -s.a * g.ctrl ELSE 0e0 END AS delta FROM grid g
      JOIN tscale s ON s.scenario = g.scenario AND s.fold = g.fold
      LEFT JOIN ko_target k ON k.ko = g.ko AND k.gene = g.gene WHERE g.ko IN (SELECT ko FROM ko_target)""",
    "Mean+TargetScaling": """SELECT g.*, CASE g.scenario WHEN 'UnseenCell' THEN mk.m WHEN 'UnseenBoth' THEN ma.m ELSE mb.m END
        - CASE WHEN k.gene IS NOT NULL THEN s.a * g.ctrl ELSE 0e0 END AS delta FROM grid g
      JOIN tscale s ON s.scenario = g.scenario AND s.fold = g.fold
      LEFT JOIN mean_bin mb ON mb.scenario = g.scenario AND mb.fold = g.fold AND mb.bin = g.bin AND mb.gene = g.gene
      LEFT JOIN mean_ko mk ON mk.scenario = g.scenario AND mk.fold = g.fold AND mk.ko = g.ko AND mk.gene = g.gene
      LEFT JOIN mean_all ma ON ma.scenario = g.scenario AND ma.fold = g.fold AND ma.gene = g.gene
      LEFT JOIN ko_target k ON k.ko = g.ko AND k.gene = g.gene""",
    "GlobalEpistasis": """SELECT c.*, c.da + c.db + coalesce(w.w, 0) * c.da * c.db AS delta FROM combo_grid c LEFT JOIN
      (SELECT scenario, fold, gene, sum(da * db * (d_all - da - db)) / (sum(da * db * da * db) + 1) AS w FROM combo_train GROUP BY 1, 2, 3) w
      ON w.scenario = c.scenario AND w.fold = c.fold AND w.gene = c.gene""",
    "Tech-duplicate": "SELECT *, d_second AS delta FROM grid",
    "Interp-duplicate": """SELECT g.*, least(greatest(1 - p.padj, 0e0), 1e0) * g.d_second
        + (1 - least(greatest(1 - p.padj, 0e0), 1e0)) * coalesce(mb.m, ma.m) AS delta FROM grid g
      JOIN deg p ON p.bin = g.bin AND p.ko = g.ko AND p.gene = g.gene AND p.half = 'second_half'
      LEFT JOIN mean_bin mb ON mb.scenario = g.scenario AND mb.fold = g.fold AND mb.bin = g.bin AND mb.gene = g.gene
      LEFT JOIN mean_all ma ON ma.scenario = g.scenario AND ma.fold = g.fold AND ma.gene = g.gene""",
    "Correlation": """SELECT b.scenario, b.fold, b.bin, b.ko, d.gene, d.d_all AS delta FROM corr_best b
      JOIN deltas d ON d.bin = b.rbin AND d.ko = b.rko""",
}
cte("dc", "SELECT bin, ko, gene, d_all - avg(d_all) OVER (PARTITION BY bin, ko) AS c FROM deltas")
cte("dsq", "SELECT bin, ko, sum(c * c) AS sq FROM dc GROUP BY 1, 2")
cte("dsim", """
SELECT a.bin AS qbin, a.ko AS qko, b.bin AS rbin, b.ko AS rko, round(sum(a.c * b.c) / sqrt(any_value(x.sq * y.sq) + 1e-8), 9) AS sim
FROM dc a JOIN dc b ON a.gene = b.gene JOIN dsq x ON x.bin = a.bin AND x.ko = a.ko JOIN dsq y ON y.bin = b.bin AND y.ko = b.ko
GROUP BY 1, 2, 3, 4
""")
cte("corr_best", """
SELECT scenario, fold, bin, ko, rbin, rko FROM (SELECT q.*, t.bin AS rbin, t.ko AS rko,
    row_number() OVER (PARTITION BY q.scenario, q.fold, q.bin, q.ko ORDER BY s.sim DESC, concat(t.bin, '|', t.ko)) AS rk
  FROM (SELECT r.*, r.bin IN (SELECT bin FROM train t WHERE t.scenario = r.scenario AND t.fold = r.fold) AS own FROM rect r) q
  JOIN train t ON t.scenario = q.scenario AND t.fold = q.fold AND (NOT q.own OR t.bin = q.bin)
  JOIN dsim s ON s.qbin = q.bin AND s.qko = q.ko AND s.rbin = t.bin AND s.rko = t.ko) z WHERE rk = 1
""")

NUMBERS = {
    "Zero": 1, "Mean-over-perturbations": 2, "Mean-over-cell-types": 3, "Mean-over-perturbations-and-cell-types": 4,
    "Two-way-mean": 5, "Additive": 6, "Matching-mean": 7, "Scaled-delta": 8, "TargetZero": 9, "TargetScaling": 10,
    "Mean+TargetScaling": 11, "Ridge": 12, "LinearAdditive": 13, "Correlation": 14, "BilinearRidge": 15,
    "LatentAdditive": 16, "GlobalEpistasis": 17, "Tech-duplicate": 18, "Interp-duplicate": 19,
}


def prediction_sql(name: str) -> str:
    return (f"SELECT {OUT.format(v='delta')} FROM ({PREDICTIONS[name]}) z WHERE scenario IN {served(name)}")


def _register(name: str, number: int):
    sql = prediction_sql(name) if name in PREDICTIONS else None

    @query(f"P{number}_{name.replace('-', '_').replace('+', '_plus_')}", sql)
    def run(tb, name=name):
        return rounded(predictors.run(name, screen(tb)).drop("predictor"), "delta")


for _name, _number in NUMBERS.items():
    _register(_name, _number)

#: Predictors with SQL: every one but the four that solve systems (Ridge, LinearAdditive, BilinearRidge, LatentAdditive).
BENCHMARKED = [n for n in NUMBERS if n in PREDICTIONS]
cte("all_predictions", "\nUNION ALL\n".join(
    f"SELECT '{n}' AS predictor, scenario, fold, bin, ko, gene, delta FROM ({PREDICTIONS[n]}) z WHERE scenario IN {served(n)}" for n in BENCHMARKED))


@query("P10_target_scale", "SELECT scenario, fold, round(a, 6) + 0e0 AS scale FROM tscale")
def p10b(tb):
    return rounded(predictors.target_scale(screen(tb)), "scale")


@query("P20_ridge_coefficients")
def p20(tb):
    return rounded(predictors.ridge_fit(predictors.scoped("Ridge", screen(tb)), 1.0), "weight")


RESTORED = ["TargetScaling", "Mean+TargetScaling", "Correlation", "GlobalEpistasis"]


@query("P20_restored_predictions", "\nUNION ALL\n".join(
    f"SELECT '{n}' AS predictor, {OUT.format(v='delta')} FROM ({PREDICTIONS[n]}) z WHERE scenario IN {served(n)}" for n in RESTORED))
def p20_restored(tb):
    """Fitted, stored, checked, restored and applied to a screen that has no training pairs any more."""
    s, root = screen(tb), fresh_path(tb.spark, "trained")
    trained.persist(RESTORED, s, root, 42)
    state = trained.restore(RESTORED, s, root, 42)
    blind = replace(s, split=s.split.where("label = 'test'"))
    return rounded(trained.apply_all(RESTORED, blind, state), "delta")


@query("P20_stored_parts", """
SELECT 'TargetScaling' AS predictor, scenario, fold, 'scale' AS part, count(*) AS n, round(sum(a), 6) + 0e0 AS total FROM tscale GROUP BY 1, 2, 3
UNION ALL SELECT 'Mean+TargetScaling', scenario, fold, 'scale', count(*), round(sum(a), 6) + 0e0 FROM tscale
  WHERE scenario IN ('UnseenPert', 'UnseenPair', 'UnseenCell', 'UnseenBoth') GROUP BY 1, 2, 3
UNION ALL SELECT 'Mean+TargetScaling', scenario, fold, 'mean_bin', count(*), round(sum(m), 6) + 0e0 FROM mean_bin
  WHERE scenario IN ('UnseenPert', 'UnseenPair') GROUP BY 1, 2, 3
UNION ALL SELECT 'Mean+TargetScaling', scenario, fold, 'mean_ko', count(*), round(sum(m), 6) + 0e0 FROM mean_ko WHERE scenario = 'UnseenCell' GROUP BY 1, 2, 3
UNION ALL SELECT 'Mean+TargetScaling', scenario, fold, 'mean_all', count(*), round(sum(m), 6) + 0e0 FROM mean_all WHERE scenario = 'UnseenBoth' GROUP BY 1, 2, 3
UNION ALL SELECT 'GlobalEpistasis', scenario, fold, 'w', count(*), round(sum(w), 6) + 0e0 FROM (
  SELECT scenario, fold, gene, sum(da * db * (d_all - da - db)) / (sum(da * db * da * db) + 1) AS w FROM combo_train WHERE scenario = 'UnseenCombo' GROUP BY 1, 2, 3) z
  GROUP BY 1, 2, 3
UNION ALL SELECT 'Correlation', scenario, fold, 'reference', count(*), count(*) + 0e0 FROM train WHERE scenario IN ('UnseenPert', 'UnseenBoth') GROUP BY 1, 2, 3
""" + "\n".join(f"UNION ALL SELECT '{n}', scenario, fold, 'fitted', 1, count(*) + 0e0 FROM train WHERE scenario IN {served(n)} GROUP BY 1, 2, 3" for n in RESTORED) + """
UNION ALL SELECT 'Correlation', '*', -1, 'profile', count(*), round(sum(d_all), 6) + 0e0 FROM deltas d
  WHERE EXISTS (SELECT 1 FROM train t WHERE t.bin = d.bin AND t.ko = d.ko AND t.scenario IN ('UnseenPert', 'UnseenBoth'))
""")
def p20_parts(tb):
    state = trained.fit_all(RESTORED, screen(tb))
    return rounded(state.groupBy("predictor", "scenario", "fold", "part").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("total")), "total")


@query("S18_staleness", """
SELECT 'TargetScaling' AS predictor, scenario, fold, CASE
  WHEN scenario = 'UnseenPert' AND fold = 0 THEN 'missing' WHEN scenario = 'UnseenCell' THEN 'seed changed' WHEN scenario = 'UnseenBoth' THEN 'axis changed'
  WHEN scenario = 'UnseenPair' AND EXISTS (SELECT 1 FROM ps p WHERE p.scenario = f.scenario AND p.fold = f.fold AND p.label = 'train'
    AND p.bin = (SELECT max(bin) FROM ps)) THEN 'split changed'
  WHEN scenario = 'UnseenDose' AND fold = 0 THEN 'artefact missing: fitted, scale' END AS reason
FROM (SELECT DISTINCT scenario, fold FROM ps) f
UNION ALL SELECT 'GlobalEpistasis', scenario, fold, 'recipe changed' FROM (SELECT DISTINCT scenario, fold FROM ps WHERE scenario = 'UnseenCombo') g
""")
def s18(tb):
    """What a store says after each kind of change: every scenario's state is fitted on tables that differ in one respect."""
    s, root = screen(tb), fresh_path(tb.spark, "stale")
    last_gene = s.genes.agg(F.max("gene")).scalar()
    last_bin = s.split.agg(F.max("bin")).scalar()
    lost = F.when((F.col("bin") == last_bin) & (F.col("label") == "train"), "val").otherwise(F.col("label"))
    name, now = ["TargetScaling"], {"epistasis_lam": 2.0}

    def fitted(scenario, seed=42, **changes):
        own = replace(s, split=s.split.where(F.col("scenario") == scenario), **changes)
        return trained.persist(name, own, root, seed)

    trained.persist(name, replace(s, split=s.split.where("scenario = 'UnseenCombo' OR scenario = 'UnseenPert' AND fold <> 0")), root, 42)
    fitted("UnseenCell", seed=7)
    fitted("UnseenBoth", genes=s.genes.where(F.col("gene") != last_gene))
    trained.persist(name, replace(s, split=s.split.where("scenario = 'UnseenPair'").withColumn("label", lost)), root, 42)
    version = fitted("UnseenDose")
    trained.persist(["GlobalEpistasis"], replace(s, options=now), root, 42)
    emptied = f"{root}/coefficients/version={version}/predictor=TargetScaling/scenario=UnseenDose/fold=0"
    tb.spark.createDataFrame([], "part string, bin string, ko string, gene string, i int, j int, weight double").write.mode("overwrite").parquet(emptied)
    return trained.reasons([*name, "GlobalEpistasis"], s, root, 42).drop("version")


@query("P21_roster_coverage", """
SELECT p.predictor, p.scenario, count(DISTINCT concat(p.fold, '|', p.bin, '|', p.ko)) AS n_rows, count(*) AS n_values
FROM all_predictions p GROUP BY 1, 2
""")
def p21(tb):
    """Roster joined with what each predictor really emitted."""
    every = predictors.run_all(BENCHMARKED, screen(tb))
    done = every.groupBy("predictor", "scenario").agg(
        F.count_distinct(F.concat_ws("|", "fold", "bin", "ko")).alias("n_rows"), F.count(F.lit(1)).alias("n_values")
    )
    roster = predictors.roster(tb.spark).select("predictor", "scenario")
    return done.join(roster, ["predictor", "scenario"])
