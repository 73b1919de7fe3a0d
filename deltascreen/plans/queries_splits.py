"""Sampling, half splits and cross-validation roles."""

from pyspark.sql import functions as F

from deltascreen.operators import sampling, splits, training
from deltascreen.plans.registry import cte, query, r6

CELL_KEY = "CAST(cell_id AS VARCHAR)"


@query("D1_downsample", f"""
SELECT cell_id, bin, condition FROM (SELECT *, count(*) OVER (PARTITION BY bin, condition) AS n,
  row_number() OVER (PARTITION BY bin, condition ORDER BY md5(concat('42|', bin, '|', condition, '|', {CELL_KEY})), cell_id) AS rk
  FROM qc_cells) q WHERE n >= 12 AND rk <= CASE WHEN condition = 'control' THEN 300 ELSE 350 END
""")
def d1(tb):
    return sampling.downsample(tb.qc_cells, 12, 300, 350).select("cell_id", "bin", "condition")


cte("keep_p", """
SELECT condition, n, CASE WHEN condition = 'control' THEN least(1e0, 150e0 / n) WHEN n < 12 THEN 0e0
  ELSE least(1e0, least(round_even(m, 0), 96e0) / n) END AS p
FROM (SELECT condition, count(*) AS n FROM qc_cells GROUP BY 1) q,
  (SELECT avg(n) AS m FROM (SELECT condition, count(*) AS n FROM qc_cells WHERE condition <> 'control' GROUP BY 1) z WHERE n >= 12) w
""")
UNIFORM = "CAST(concat('0x', substr(md5(concat('42|', {k})), 1, 12)) AS BIGINT) / 281474976710656e0"


@query("D2_keep_probability", "SELECT condition, n, round(p, 6) + 0e0 AS p FROM keep_p")
def d2(tb):
    p = sampling.keep_probabilities(tb.qc_cells, 12, 96, 150)
    return p.select("condition", "n", r6("p").alias("p"))


@query("D2_bernoulli_sample", f"""
SELECT c.cell_id, c.condition FROM qc_cells c JOIN keep_p k ON k.condition = c.condition
WHERE {UNIFORM.format(k="CAST(c.cell_id AS VARCHAR)")} < k.p
""")
def d2b(tb):
    p = sampling.keep_probabilities(tb.qc_cells, 12, 96, 150)
    return sampling.bernoulli_sample(tb.qc_cells, p).select("cell_id", "condition")


@query("D3_half_split", "SELECT cell_id, bin, condition, half FROM hcells")
def d3(tb):
    return tb.half_cells.select("cell_id", "bin", "condition", "half")


@query("D4_blocks", "SELECT ko, block, CAST(pos AS BIGINT) AS pos, CAST(block_size AS BIGINT) AS block_size FROM ko_blocks")
def d4(tb):
    return splits.blocks(tb.kos, ["ko"], 5, 0).select(
        "ko", "block", F.col("pos").cast("bigint"), F.col("block_size").cast("bigint")
    )


@query("D5_fold_roles", "SELECT ko, fold, label FROM ko_roles")
def d5(tb):
    return splits.fold_roles(tb.kos, ["ko"], 5, 0).select("ko", "fold", "label")


@query("Q16_stratified_subsample", f"""
SELECT cell_id, bin FROM (SELECT *, row_number() OVER (PARTITION BY bin ORDER BY md5(concat('42|', bin, '|', {CELL_KEY})), cell_id) AS rk
  FROM qc_cells) q WHERE rk <= 500
""")
def q16(tb):
    return sampling.stratified(tb.qc_cells, 500).select("cell_id", "bin")


@query("D6_effect_weights", """
SELECT scenario, fold, bin, ko, round(raw * count(*) OVER (PARTITION BY scenario, fold) / sum(raw) OVER (PARTITION BY scenario, fold), 6) + 0e0 AS weight
FROM (SELECT t.scenario, t.fold, t.bin, t.ko, sqrt(sum((d_all / s.sigma) * (d_all / s.sigma))) AS raw
      FROM train t JOIN deltas d ON d.bin = t.bin AND d.ko = t.ko
      JOIN norm_stats s ON s.scenario = t.scenario AND s.fold = t.fold AND s.gene = d.gene
      WHERE t.scenario = 'UnseenPert' GROUP BY 1, 2, 3, 4) q
""")
def d6(tb):
    split = tb.split("UnseenPert")
    stats = training.norm_stats(tb.stage("deltas"), tb.stage("ctrl"), split)
    rows = splits.train_pairs(split).join(tb.stage("deltas"), ["bin", "ko"])
    w = sampling.effect_weights(rows, stats, ["scenario", "fold", "bin", "ko"])
    return w.withColumn("weight", r6("weight"))


cte("draw_items", f"""
SELECT cell_id, n_genes * 1e0 AS weight, sum(n_genes * 1e0) OVER (ORDER BY {UNIFORM.format(k="CAST(cell_id AS VARCHAR)")}) AS upto FROM cell_sum
""")


@query("D7_weighted_draws", f"""
SELECT cell_id, count(*) AS n_drawn FROM (SELECT {UNIFORM.replace("42|", "43|").format(k="CAST(d AS VARCHAR)")} AS u
    FROM (SELECT unnest(range((SELECT count(*) * 5 FROM orders))) AS d) q) p
ASOF JOIN (SELECT cell_id, (upto - weight) / (SELECT sum(weight) FROM draw_items) AS lo FROM draw_items) i ON p.u >= i.lo GROUP BY 1
""")
def d7(tb):
    """5 draws per order, weighted by its number of line items."""
    items = tb.totals.select("cell_id", F.col("n_genes").cast("double").alias("weight"))
    n = tb.spark.read.parquet(f"{tb.dir}/orders.parquet").count() * 5
    return sampling.weighted_draws(items, ["cell_id"], n).groupBy("cell_id").agg(
        F.count(F.lit(1)).alias("n_drawn")
    )


@query("X1_unseen_pert_cells", f"""
WITH ks AS (SELECT condition, CAST(ntile(5) OVER (ORDER BY rk) AS INT) - 1 AS block, rk, n FROM (
    SELECT condition, row_number() OVER (ORDER BY md5(concat('42|', condition)), condition) AS rk, count(*) OVER () AS n
    FROM (SELECT DISTINCT condition FROM qc_cells WHERE condition <> 'control') q) w),
cs AS (SELECT cell_id, CAST(ntile(5) OVER (ORDER BY rk) AS INT) - 1 AS block, rk, n FROM (
    SELECT cell_id, row_number() OVER (ORDER BY md5(concat('43|', {CELL_KEY})), cell_id) AS rk, count(*) OVER () AS n
    FROM qc_cells WHERE condition = 'control') w),
both_items AS (SELECT c.cell_id, k.block, k.rk, k.n FROM qc_cells c JOIN ks k ON k.condition = c.condition
  UNION ALL SELECT * FROM cs)
SELECT 'UnseenPert' AS scenario, fold, cell_id, CASE WHEN block = fold THEN 'test'
  WHEN rk - CASE WHEN block > fold THEN ts ELSE 0 END <= floor((n - ts) * 0.1375e0) THEN 'val' ELSE 'train' END AS label
FROM (SELECT *, n // 5 + CASE WHEN fold < n % 5 THEN 1 ELSE 0 END AS ts FROM both_items CROSS JOIN folds5) q
""")
def x1(tb):
    return splits.unseen_pert_cells(tb.qc_cells, 5, 42)


def _split_query(number, scenario, source):
    @query(f"X{number}_{scenario}", f"SELECT scenario, fold, bin, ko, label FROM {source}")
    def run(tb, scenario=scenario):
        return splits.BUILDERS[scenario](tb.pairs, 5)


for _n, _s, _c in [(2, "UnseenPert", "ps_pert"), (3, "UnseenCell", "ps_cell"), (4, "UnseenBoth", "ps_both"),
                   (5, "UnseenPair", "ps_pair"), (6, "UnseenDose", "ps_dose"), (7, "UnseenCombo", "ps_combo")]:
    _split_query(_n, _s, _c)

cte("cell_split", """
SELECT h.cell_id, p.scenario, p.fold, p.label FROM hcells h JOIN ps p ON p.bin = h.bin AND p.ko = h.condition
UNION ALL SELECT h.cell_id, j.scenario, j.fold, 'train' FROM hcells h
CROSS JOIN (SELECT DISTINCT scenario, fold FROM ps) j WHERE h.condition = 'control'
""")


@query("X8_grid_from_cells", """
SELECT s.scenario, s.fold, h.bin, h.condition AS ko, bool_or(label = 'train') AS in_train, bool_or(label = 'val') AS in_val,
  bool_or(label = 'test') AS in_test FROM cell_split s JOIN hcells h ON h.cell_id = s.cell_id GROUP BY 1, 2, 3, 4
""")
def x8(tb):
    cells = tb.stage("half_cells")
    return splits.grid_from_cells(cells, splits.cell_labels(cells, tb.stage("pair_split"), carry=("bin", "condition")))


@query("X9_test_rectangle", "SELECT scenario, fold, bin, ko FROM rect")
def x9(tb):
    return splits.rectangle(tb.stage("pair_split"), "test")


@query("X9_train_pairs", "SELECT scenario, fold, bin, ko FROM train")
def x9b(tb):
    return splits.train_pairs(tb.stage("pair_split"))


@query("X10_axis_check", """
SELECT axis, name FROM (SELECT 'bin' AS axis, bin AS name FROM fx_cells UNION SELECT 'ko', condition FROM fx_cells) q
WHERE NOT EXISTS (SELECT 1 FROM ps WHERE ps.scenario = 'UnseenPair' AND ps.label <> 'unassigned'
  AND ((axis = 'bin' AND ps.bin = name) OR (axis = 'ko' AND ps.ko = name)))
""")
def x10(tb):
    mask = tb.split("UnseenPair").where("label <> 'unassigned'")
    return splits.check_axis(mask, tb.cells.select("bin", F.col("condition").alias("ko")))


@query("X11_condition_lists", """
SELECT DISTINCT s.scenario, s.fold, s.label, h.condition FROM cell_split s JOIN hcells h ON h.cell_id = s.cell_id
WHERE h.condition NOT LIKE '%ctrl%' AND h.condition NOT LIKE '%*%'
""")
def x11(tb):
    cells = tb.stage("half_cells")
    return splits.condition_lists(cells, splits.cell_labels(cells, tb.stage("pair_split"), carry=("bin", "condition")))


@query("X12_available_jobs", "SELECT DISTINCT scenario, fold FROM ps")
def x12(tb):
    return splits.available_jobs(tb.stage("pair_split"))


@query("X12_wide_export", """
SELECT cell_id, max(label) FILTER (fold = 0) AS fold_0, max(label) FILTER (fold = 1) AS fold_1
FROM cell_split WHERE scenario = 'UnseenCombo' GROUP BY 1
""")
def x12b(tb):
    cells = tb.stage("half_cells")
    wide = splits.wide_cell_split(splits.cell_labels(cells, tb.split("UnseenCombo")), "UnseenCombo", 2)
    return wide.withColumnsRenamed({"0": "fold_0", "1": "fold_1"})
