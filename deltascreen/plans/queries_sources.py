"""Sources, sinks and streaming jobs; every input is derived from the given tables by Spark."""

from pyspark.sql import functions as F

from deltascreen.operators import predictors
from deltascreen.operators.scale import fresh_path
from deltascreen.plans.queries_metrics import predictions, scores
from deltascreen.plans.registry import cte, query, r6, rounded
from deltascreen.sources import batches, store
from deltascreen.streaming import ingest


@query("S1_projected_scan", "SELECT l_orderkey, l_partkey, l_quantity FROM lineitem WHERE l_linenumber = 1")
def s1(tb):
    return batches.scan(tb.spark, f"{tb.dir}/lineitem.parquet", ["l_orderkey", "l_partkey", "l_quantity"], F.col("l_linenumber") == 1)


@query("S2_condition_counts", "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1")
def s2(tb):
    return batches.condition_counts(batches.scan(tb.spark, f"{tb.dir}/orders.parquet", ["o_orderpriority"]), "o_orderpriority")


cte("vocab", "SELECT p_brand AS gene, min(p_partkey) AS token FROM part WHERE NOT starts_with(p_brand, 'Brand#1') GROUP BY 1")


def vocab(tb):
    return batches.vocabulary(tb.table("part"), "p_brand", "p_partkey", "Brand#1")


@query("S4_vocabulary", "SELECT gene, token FROM vocab")
def s4(tb):
    return vocab(tb).select("gene", "token")


@query("S3_ragged_arrays", "SELECT k.cell_id, k.gene, k.cnt AS value FROM fx_counts k WHERE k.gene IN (SELECT gene FROM vocab)")
def s3(tb):
    full = tb.genes.select("gene", F.col("gene_ord").alias("token"))
    known = full.join(vocab(tb).select("gene"), "gene", "left_semi")
    return batches.explode_ragged(batches.to_ragged(tb.counts, full), known)


def _matrix_files(tb):
    root = fresh_path(tb.spark, "mtx")
    genes, cells = tb.stage("genes"), tb.stage("half_cells").select("cell_id")
    counts = tb.stage("expr").select("cell_id", "gene", "cnt")
    genes.select(F.concat_ws("\t", F.concat(F.lit("id_"), "gene"), "gene", F.lit("expr"), F.col("gene_ord").cast("string")).alias("value")
                 ).orderBy(F.split("value", "\t")[3].cast("int")).coalesce(1).write.text(f"{root}/features")
    cells.orderBy("cell_id").select(F.col("cell_id").cast("string").alias("value")).write.text(f"{root}/barcodes")
    order = batches.numbered_lines(tb.spark, f"{root}/barcodes", ["barcode"]).select(
        F.col("barcode").cast("bigint").alias("cell_id"), F.col("idx").alias("ci"))
    triplets = counts.join(order, "cell_id").join(
        genes.select("gene", (F.col("gene_ord") + 1).alias("gi")), "gene").select("gi", "ci", "cnt")
    batches.write_matrix_market(triplets, f"{root}/matrix", genes.count(), cells.count())
    return root


@query("S5_matrix_market", "SELECT CAST(cell_id AS VARCHAR) AS barcode, gene, cnt FROM fx_expr")
def s5(tb):
    root = _matrix_files(tb)
    return batches.read_matrix_market(tb.spark, f"{root}/matrix", f"{root}/features", f"{root}/barcodes")


@query("S6_union_shared", """
SELECT concat(CAST(k.cell_id AS VARCHAR), '-0') AS cell_id, k.gene, k.cnt FROM fx_counts k JOIN fx_cells c ON c.cell_id = k.cell_id JOIN fx_genes g ON g.gene = k.gene WHERE c.bin = 'bin_O' AND g.gene_ord BETWEEN 5 AND 19
UNION ALL SELECT concat(CAST(k.cell_id AS VARCHAR), '-1'), k.gene, k.cnt FROM fx_counts k JOIN fx_cells c ON c.cell_id = k.cell_id JOIN fx_genes g ON g.gene = k.gene WHERE c.bin = 'bin_F' AND g.gene_ord BETWEEN 5 AND 19
""")
def s6(tb):
    rows = tb.counts.join(tb.cells.select("cell_id", "bin"), "cell_id").join(tb.genes.select("gene", "gene_ord"), "gene")
    a = rows.where("bin = 'bin_O' AND gene_ord < 20").select("cell_id", "gene", "cnt")
    b = rows.where("bin = 'bin_F' AND gene_ord >= 5").select("cell_id", "gene", "cnt")
    return batches.union_shared([a, b])


@query("S7_unique_genes", """
SELECT k.cell_id, k.gene, k.cnt FROM fx_counts k WHERE k.gene NOT IN (SELECT gene FROM fx_genes WHERE gene_ord % 4 = 0)
""")
def s7(tb):
    var = tb.genes.select("gene").unionByName(tb.genes.where("gene_ord % 4 = 0").select("gene"))
    return batches.unique_genes(tb.counts, var).select("cell_id", "gene", "cnt")


@query("S8_light_read", "SELECT DISTINCT bin, ko FROM deltas")
def s8(tb):
    return tb.stage("deltas").select("bin", "ko").distinct()


def tagged(tb):
    return scores(tb).withColumn("dataset", F.lit("tb"))


@query("S9_discover_csv", "SELECT 'tb' AS dataset, scenario, count(*) AS n, round(sum(value), 4) + 0e0 AS total FROM kept_scores GROUP BY 2")
def s9(tb):
    root = fresh_path(tb.spark, "pooled")
    base = scores(tb).select("predictor", "fold", "bin", "ko", "metric", "value", "scenario")
    for s in predictors.SCENARIOS:
        base.where(F.col("scenario") == s).drop("scenario").write.option("header", True).csv(f"{root}/tb/{s}/pooled")
    found = store.discover_csv(tb.spark, root, "predictor string, fold int, bin string, ko string, metric string, value double")
    return found.groupBy("dataset", "scenario").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("value"), 4).alias("total"))


UPSERTED = """
SELECT 'tb' AS dataset, scenario, fold, predictor, bin, ko, metric,
  round(value + CASE WHEN predictor = 'Zero' AND fold = 0 THEN 1 ELSE 0 END, 6) + 0e0 AS value FROM kept_scores
"""
UP_COLUMNS = ["dataset", "scenario", "fold", "predictor", "bin", "ko", "metric", "value"]


def _again(tb):
    return tagged(tb).where("predictor = 'Zero' AND fold = 0").withColumn("value", F.col("value") + 1)


@query("S10_upsert_sink", UPSERTED)
def s10(tb):
    """Recompute one predictor in one fold: its partitions are replaced, the others stay."""
    path, roster = fresh_path(tb.spark, "metrics"), predictors.roster(tb.spark)
    store.upsert_scores(tagged(tb), path, roster)
    invalid = tagged(tb).where("predictor = 'Additive'").withColumn("scenario", F.lit("UnseenPert"))
    store.upsert_scores(_again(tb).unionByName(invalid), path, roster)
    return rounded(store.read_partitioned(tb.spark, path).select(*UP_COLUMNS), "value")


@query("J3_merge_rows", UPSERTED)
def j3(tb):
    return rounded(store.merge_scores(tagged(tb), _again(tb)).select(*UP_COLUMNS), "value")


@query("S11_pool_folds", "SELECT scenario, fold, predictor, count(*) AS n FROM kept_scores GROUP BY 1, 2, 3")
def s11(tb):
    folds = sorted(r.fold for r in scores(tb).select("fold").distinct().collect())
    parts = [(f, scores(tb).where(F.col("fold") == f).drop("fold")) for f in folds]
    return store.pool_folds(parts).groupBy("scenario", "fold", "predictor").agg(F.count(F.lit(1)).alias("n"))


def saved(tb):
    path = fresh_path(tb.spark, "predictions")
    every = predictions(tb).withColumn("dataset", F.lit("tb"))
    d = tb.stage("deltas")
    store.save_predictions(store.checked_predictions(every, d, d, tb.stage("genes")), path)
    return path


PRED = """SELECT 'tb' AS dataset, scenario, fold, predictor, bin, ko, gene, round(delta, 6) + 0e0 AS delta FROM all_predictions"""


@query("S12_prediction_sink", PRED)
def s12(tb):
    return rounded(store.read_partitioned(tb.spark, saved(tb)), "delta")


@query("S13_prediction_scan", PRED)
def s13(tb):
    return rounded(store.load_predictions(tb.spark, saved(tb), tb.stage("genes"), exact=True), "delta")


@query("S13_intersection_scan", PRED + " WHERE gene IN (SELECT gene FROM fx_genes WHERE gene_ord % 2 = 0)")
def s13b(tb):
    panel = tb.stage("genes").where("gene_ord % 2 = 0")
    return rounded(store.load_predictions(tb.spark, saved(tb), panel, exact=False), "delta")


@query("S13_axis_difference", """
SELECT p.predictor, CASE WHEN g.gene_ord % 2 = 0 THEN 'missing' ELSE 'extra' END AS side, g.gene
FROM (SELECT DISTINCT predictor FROM all_predictions) p CROSS JOIN fx_genes g WHERE g.gene_ord % 4 IN (0, 1)
""")
def s13c(tb):
    """Predictions lose every fourth feature, the panel every fourth other one."""
    g = tb.stage("genes").select("gene", "gene_ord")
    mine = predictions(tb).join(g.where("gene_ord % 4 <> 0"), "gene")
    return store.axis_difference(mine, g.where("gene_ord % 4 <> 1"))


@query("S14_audit_sink", """
SELECT CASE WHEN label IS NULL THEN 'sentinel' ELSE 'cleaned' END AS category, condition_raw AS label, count(*) AS count
FROM clean_lbl c WHERE c.label IS NULL OR c.label <> condition_raw GROUP BY c.label, condition_raw
""")
def s14(tb):
    from deltascreen.operators import qc

    path = fresh_path(tb.spark, "audit")
    qc.label_audit(tb.cells).write.option("header", True).csv(path)
    back = tb.spark.read.option("header", True).schema("category string, label string, count bigint, reason string").csv(path)
    return back.select("category", "label", "count")


@query("S15_stamped_stage", "SELECT bin, gene, round(m, 6) + 0e0 AS m, n_cells FROM ctrl_bulk")
def s15(tb):
    from deltascreen.operators import bulk

    root = fresh_path(tb.spark, "stages")
    make = lambda: bulk.control_bulk(tb.expr, tb.qc_cells, tb.genes)
    store.stamped_stage(tb.spark, root, "ctrl", {"min_genes": 2}, make, ["m"])
    again = store.stamped_stage(tb.spark, root, "ctrl", {"min_genes": 2}, lambda: tb.spark.range(0), ["m"])
    return rounded(again, "m")


@query("S16_axis_fingerprint", "SELECT sha256(string_agg(gene, ',' ORDER BY gene)) AS digest, count(*) AS n FROM fx_genes")
def s16(tb):
    return store.axis_fingerprint(tb.genes)


@query("S16_split_fingerprint", """
SELECT scenario, fold, bit_xor(h) AS digest, sum(h % 1000003)::BIGINT AS check_sum, count(*) AS n FROM (
  SELECT scenario, fold, ('0x' || left(md5(concat_ws('|', length(bin), length(ko), bin, ko, label)), 15))::BIGINT AS h FROM ps) z GROUP BY 1, 2
""")
def s16b(tb):
    return store.split_fingerprint(tb.stage("pair_split"))


@query("S17_legacy_dictionary", """
SELECT concat('tb_', bin, '_', ko) AS key, gene, round(score, 6) + 0e0 AS score, round(p, 6) + 0e0 AS p FROM deg WHERE half = 'first_half'
""")
def s17(tb):
    """Dictionaries keyed by dataset, bin and label, one map per bin."""
    d = tb.stage("deg").where("half = 'first_half'")
    rows = d.groupBy("bin", "ko").agg(F.collect_list(F.struct("gene", "score", "p")).alias("v"))
    keyed = rows.select("bin", F.struct(store.dictionary_key("tb").alias("key"), "v").alias("e"))
    dicts = keyed.groupBy("bin").agg(F.map_from_entries(F.collect_list("e")).alias("dict"))
    return rounded(store.explode_dictionary(dicts), "score", "p")


# ---- streaming --------------------------------------------------------------------------------
def arriving(tb):
    """Cells with paired arrays, written as several files per batch label."""
    def build():
        entry = F.array_sort(F.collect_list(F.struct("gene", "cnt")))
        packed = tb.counts.groupBy("cell_id").agg(entry.alias("e"))
        return tb.cells.join(packed, "cell_id").select(
            "cell_id", "condition_raw", "bin", "batch", F.col("e.gene").alias("genes"), F.col("e.cnt").alias("counts"))

    path = fresh_path(tb.spark, "arriving")
    build().repartition("batch").write.partitionBy("batch").parquet(path)
    return path


cte("stream_cells", """
SELECT c.cell_id, c.label AS condition, f.bin, s.total FROM clean_lbl c JOIN fx_cells f ON f.cell_id = c.cell_id JOIN cell_sum s ON s.cell_id = c.cell_id
JOIN mito m ON m.cell_id = c.cell_id WHERE c.label IS NOT NULL AND s.n_genes >= 2 AND m.f < 0.15
""")


def _stream(tb):
    return ingest.clean_stream(ingest.batch_stream(tb.spark, arriving(tb), 2), min_genes=2, mito_max=0.15)


@query("R1_stream_ingest", """
SELECT s.cell_id, s.condition, s.bin, k.gene, k.cnt, round(ln(1 + k.cnt * 1e4 / s.total), 6) + 0e0 AS x FROM stream_cells s JOIN fx_counts k ON k.cell_id = s.cell_id
""")
def r1(tb):
    out, ckpt = fresh_path(tb.spark, "ingested"), fresh_path(tb.spark, "ingest-state")
    job = ingest.start_ingest(_stream(tb), out, ckpt)
    job.awaitTermination()
    return rounded(tb.spark.read.parquet(out), "x")


@query("R2_incremental_means", """
SELECT s.bin, s.condition, k.gene, round(sum(ln(1 + k.cnt * 1e4 / s.total)), 6) + 0e0 AS sx, round(sum(pow(ln(1 + k.cnt * 1e4 / s.total), 2)), 6) + 0e0 AS sxx, count(*) AS nnz,
  any_value(n.n_cells) AS n_cells, round(sum(ln(1 + k.cnt * 1e4 / s.total)) / any_value(n.n_cells), 6) + 0e0 AS m
FROM stream_cells s JOIN fx_counts k ON k.cell_id = s.cell_id
JOIN (SELECT bin, condition, count(*) AS n_cells FROM stream_cells GROUP BY 1, 2) n ON n.bin = s.bin AND n.condition = s.condition
GROUP BY 1, 2, 3
""")
def r2(tb):
    out, ckpt = fresh_path(tb.spark, "means"), fresh_path(tb.spark, "means-state")
    ingest.start_incremental_means(_stream(tb), out, ckpt).awaitTermination()
    return rounded(ingest.read_incremental_means(tb.spark, out), "sx", "sxx", "m")
