"""The three jobs end to end on the sf0.001 tables, and plan properties that matter at scale."""

import io
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F

from deltascreen.operators.scale import fresh_path
from deltascreen.plans import lifecycle
from deltascreen.sources import batches, store
from deltascreen.sources.testbed import open_testbed

SF_DIR = "/root/testdata/sf0.001"


def plan(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def test_preprocess_benchmark_report(spark):
    tb, root = open_testbed(spark, SF_DIR), fresh_path(spark, "life")
    recipe = lifecycle.Recipe("tb", min_genes=2, n_hvg=15, guide_column="guide", min_gene_cells=1, mito_max=0.9,
                              scenarios=["UnseenPert", "UnseenPair"], n_folds=3)
    cells = tb.cells.drop("condition")
    tables = lifecycle.preprocess(spark, tb.counts, cells, recipe, root)
    assert tables["deltas"].count() > 0
    again = lifecycle.preprocess(spark, tb.counts, cells, recipe, root)
    assert again["deltas"].inputFiles() == tables["deltas"].inputFiles()  # finished stages are reused
    fewer = lifecycle.preprocess(spark, tb.counts.where("cell_id % 7 <> 0"), cells, recipe, root)
    assert not set(fewer["deltas"].inputFiles()) & set(tables["deltas"].inputFiles())  # other input: built anew
    weights = tables["deltas"].select("bin", "ko", "gene", F.lit(1.0).alias("w"), F.lit(True).alias("deg"),
                                      F.signum("d_first").cast("int").alias("dir"))
    scored = lifecycle.benchmark(spark, {**tables, "weights": weights}, "tb", root,
                                 "Zero,Mean-over-perturbations,Two-way-mean,controls", top_k=5, min_set=1)
    assert {"mse", "pds_cosine", "gsea_up"} <= {r.metric for r in scored.select("metric").distinct().collect()}
    report = lifecycle.report(spark, scored)
    assert report["cf_summary"].count() > 0 and report["coverage"].count() > 0


def test_filters_and_columns_reach_the_files(spark):
    text = plan(batches.scan(spark, f"{SF_DIR}/lineitem.parquet", ["l_orderkey"], F.col("l_linenumber") == 1))
    assert "EqualTo(l_linenumber,1)" in text and "l_comment" not in text
    assert "ReadSchema: struct<l_orderkey:bigint,l_linenumber:int>" in text


def test_no_registered_query_uses_a_cross_join(spark):
    import __spark_entry__ as entry

    for name in ("A3_pseudobulk", "T1_rank_test", "X9_test_rectangle", "P4_Mean_over_perturbations_and_cell_types", "M1_mse"):
        text = plan(entry.queries()[name](spark, SF_DIR))
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name


def test_prediction_guards(spark):
    schema = "dataset string, scenario string, fold int, predictor string, bin string, ko string, gene string, delta double"
    genes = spark.createDataFrame([("g0",), ("g1",)], "gene string")
    axes = spark.createDataFrame([("b", "k")], "bin string, ko string")
    row = ("d", "s", 0, "p", "b", "k", "g0", 1.0)
    with pytest.raises(Exception, match="duplicate key"):
        store.checked_predictions(spark.createDataFrame([row, row], schema), axes, axes, genes).collect()
    with pytest.raises(Exception, match="unknown name"):
        odd = row[:6] + ("zz", 1.0)
        store.checked_predictions(spark.createDataFrame([odd], schema), axes, axes, genes).collect()
    path = fresh_path(spark, "pred")
    store.save_predictions(spark.createDataFrame([row], schema), path)
    with pytest.raises(Exception, match="feature axis differs"):
        store.load_predictions(spark, path, genes, exact=True).collect()
    assert store.load_predictions(spark, path, genes, exact=False).count() == 1
    assert store.load_predictions(spark, path, genes, exact=True, exempt=["p"]).count() == 1


def test_matrix_market_shapes(spark):
    root = fresh_path(spark, "mm")
    spark.createDataFrame([("i0\tA\tx",), ("i1\tB\tx",)], "v string").coalesce(1).write.text(f"{root}/f")
    spark.createDataFrame([("c0",), ("c1",), ("c2",)], "v string").coalesce(1).write.text(f"{root}/b")
    entries = spark.createDataFrame([(1, 1, 5), (2, 3, 7)], "gi int, ci int, cnt int")
    batches.write_matrix_market(entries, f"{root}/m", 2, 3)
    got = {(r.barcode, r.gene, r.cnt) for r in batches.read_matrix_market(spark, f"{root}/m", f"{root}/f", f"{root}/b").collect()}
    assert got == {("c0", "A", 5), ("c2", "B", 7)}
    batches.write_matrix_market(entries, f"{root}/bad", 2, 4)
    with pytest.raises(ValueError, match="does not fit"):
        batches.read_matrix_market(spark, f"{root}/bad", f"{root}/f", f"{root}/b")
