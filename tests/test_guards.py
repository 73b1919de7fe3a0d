"""Cases that once gave a wrong answer without an error."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_contracts import Case

from deltascreen.operators import blocks, bulk, deg, linear, meta, metrics, predictors, qc
from deltascreen.operators.scale import fresh_path, hash_rank, spread
from deltascreen.plans import catalogue
from deltascreen.sources import store
from deltascreen.streaming import ingest

SCORE = "dataset string, scenario string, fold int, predictor string, bin string, ko string, metric string, value double, n_genes_valid long, n_genes_native long"


def scores(spark, datasets):
    """Each dataset's controls lie elsewhere; the forecast is in the middle between baseline and best."""
    rows = []
    for name, low, high in datasets:
        for ko in ("k0", "k1"):
            for predictor, value in ((catalogue.NEGATIVE_CONTROL, high), (catalogue.POSITIVE_CONTROL, low), ("Mean-over-perturbations", high), ("mine", (low + high) / 2)):
                rows.append((name, "UnseenPert", 0, predictor, "b", ko, "mse", value, 20, 20))
    return spark.createDataFrame(rows, SCORE)


def test_datasets_do_not_mix_in_normalised_scores(spark):
    table = catalogue.metric_table(spark)
    base = spark.createDataFrame([("UnseenPert", "Mean-over-perturbations")], "scenario string, baseline_predictor string")
    both = scores(spark, [("one", 1.0, 2.0), ("two", 10.0, 30.0)])
    got = {(r.dataset, r.ko): r for r in meta.captured_fraction(both, table, base).where("predictor = 'mine'").collect()}
    for (dataset, _), r in got.items():
        assert r.cf == pytest.approx(0.5) and (r.m_pos, r.m_neg) == ((1.0, 2.0) if dataset == "one" else (10.0, 30.0))
    assert len(got) == 4 and {r.n for r in meta.summarise(meta.captured_fraction(both, table, base), "cf", ["dataset", "predictor"], clean=False).where("predictor = 'mine'").collect()} == {2}


def test_coverage_and_overlap_per_dataset(spark):
    rows = scores(spark, [("one", 1.0, 2.0), ("two", 1.0, 2.0)]).where("NOT (dataset = 'two' AND predictor = 'mine' AND ko = 'k1')")
    summary = {(r.dataset, r.predictor): r.not_handled for r in meta.coverage_summary(rows).collect()}
    assert summary[("one", "mine")] == 0 and summary[("two", "mine")] == 1
    shared = meta.overlap(rows, ["dataset", "scenario"])
    assert {(r.dataset, r.ko) for r in meta.on_overlap(rows, shared).collect()} == {("one", "k0"), ("one", "k1"), ("two", "k0")}
    forecast = spark.createDataFrame([("mine", "k1", False, "combo_arity")], "predictor string, ko string, ok boolean, reason string")
    report = {(r.dataset, r.ko): r.in_overlap for r in meta.coverage(rows, forecast).collect()}
    assert report == {("one", "k0"): True, ("one", "k1"): True, ("two", "k0"): True, ("two", "k1"): False}


def test_stored_datasets_have_their_own_feature_axes(spark):
    schema = "dataset string, scenario string, fold int, predictor string, bin string, ko string, gene string, delta double"
    path = fresh_path(spark, "two-datasets")
    rows = [(d, "s", 0, "p", "b", "k", g, 1.0) for d, genes in (("one", "xy"), ("two", "yz")) for g in genes]
    store.save_predictions(spark.createDataFrame(rows, schema), path)
    genes = spark.createDataFrame([("y",), ("z",)], "gene string")
    assert {r.gene for r in store.load_predictions(spark, path, genes, dataset="two").collect()} == {"y", "z"}
    with pytest.raises(Exception, match="feature axis differs"):
        store.load_predictions(spark, path, genes, dataset="one").collect()


def test_stored_rows_that_became_invalid_are_not_read(spark):
    path = fresh_path(spark, "scores")
    first = scores(spark, [("one", 1.0, 2.0)])
    old = first.select("scenario", "predictor").distinct()
    store.upsert_scores(first, path, old)
    roster = old.where("predictor <> 'mine'")
    ran = first.where("predictor = 'Mean-over-perturbations'").select(*store.PARTITIONS).distinct()
    store.upsert_scores(first.limit(0), path, roster, ran)  # ran again, and had nothing to say
    left = {r.predictor for r in store.read_scores(spark, path, roster).collect()}
    assert left == {catalogue.NEGATIVE_CONTROL, catalogue.POSITIVE_CONTROL}


def test_two_control_labels_in_a_bin_fail(spark):
    names = ["control"] * 4 + ["non-targeting"] * 4 + ["A"] * 6
    cells = spark.createDataFrame([(i, "b", "first_half", c) for i, c in enumerate(names)], "cell_id long, bin string, half string, condition string")
    expr = spark.createDataFrame([(i, "G0", 1.0 + i) for i in range(14)], "cell_id long, gene string, v double")
    genes = spark.createDataFrame([("G0",)], "gene string")
    assert deg.rank_statistics(expr, cells.where("condition <> 'non-targeting'"), genes).count() > 0
    with pytest.raises(Exception, match="more than one control"):
        deg.rank_statistics(expr, cells, genes).collect()


def test_bars_in_names_do_not_confuse_the_nearest_profile(spark):
    df = spark.createDataFrame([("A|1", "x"), ("A", "1|x"), ("b", "k|"), ("", "|")], "bin string, ko string")
    named = df.withColumn("id", predictors.pair_id())
    bin_, ko = predictors.id_pair("id")
    assert all((r.bin, r.ko) == (r.b, r.k) for r in named.select("bin", "ko", bin_.alias("b"), ko.alias("k")).collect())
    assert named.select("id").distinct().count() == 4


@pytest.mark.parametrize(("name", "scenario"), [("Mean-over-cell-types", "UnseenCell"), ("Mean-over-perturbations-and-cell-types", "UnseenPert"), ("Two-way-mean", "UnseenPair")])
def test_a_fold_without_training_pairs_fails(spark, name, scenario):
    case = Case(spark, scenario)
    case.screen.split = case.split.where("label = 'test'")
    with pytest.raises(Exception, match="empty training split"):
        predictors.run(name, case.screen).collect()


def test_null_groups_keep_their_rows(spark):
    df = spark.createDataFrame([(i, None if i % 2 else "b") for i in range(20)], "cell_id long, bin string")
    got = hash_rank(df, ["bin"], F.md5(F.col("cell_id").cast("string")), ["cell_id"]).collect()
    assert len(got) == 20
    for group in (None, "b"):
        assert sorted(r["rank"] for r in got if r.bin == group) == list(range(1, 11))


def test_an_axis_of_any_size_is_spread(spark):
    axis = spark.range(250_000).select(F.concat(F.lit("g"), "id").alias("gene"))
    groups = spark.createDataFrame([("a",), ("b",)], "bin string")
    full = spread(groups, axis, "gene")
    assert full.columns == ["bin", "gene"]
    assert {(r.bin, r.n) for r in full.groupBy("bin").agg(F.count_distinct("gene").alias("n")).collect()} == {("a", 250_000), ("b", 250_000)}
    numbered = bulk.number_genes(axis.limit(50))
    assert sorted(r.gene_ord for r in numbered.collect()) == list(range(50))


def test_profiles_of_different_features_are_not_compared(spark):
    rows = [("k0", "g0", 1.0), ("k0", "g1", 2.0), ("k1", "g1", 1.0), ("k1", "g2", 2.0)]
    df = spark.createDataFrame(rows, "id string, gene string, x double")
    with pytest.raises(Exception, match="different features"):
        blocks.pack(df, ["id"], {"x": "v"}).collect()
    assert blocks.pack(df.where("id = 'k0'"), ["id"], {"x": "v"}).first().v == [1.0, 2.0]


def test_shipped_fractions_with_nan_and_percent(spark):
    df = spark.createDataFrame([(1, 0.2), (2, float("nan")), (3, None)], "cell_id long, pct double")
    assert {r.cell_id: r.shipped for r in qc.shipped_fraction(df, "pct").collect()} == {1: 0.2, 2: None, 3: None}
    percent = spark.createDataFrame([(1, 20.0), (2, float("nan"))], "cell_id long, pct double")
    assert {r.cell_id: r.shipped for r in qc.shipped_fraction(percent, "pct").collect()} == {1: 0.2, 2: None}


def test_shipped_fractions_stand_in_or_have_to_agree(spark):
    counts = spark.createDataFrame([(c, g, 10) for c in range(8) for g in ("MT-A", "G0")], "cell_id long, gene string, cnt long")
    computed = qc.mito_fraction(counts)
    near = spark.createDataFrame([(c, 0.5) for c in range(8)], "cell_id long, shipped double")
    far = near.withColumn("shipped", F.lit(0.01))
    assert {r.mito_frac for r in qc.require_agreement(computed, near).collect()} == {0.5}
    with pytest.raises(Exception, match="disagree"):
        qc.require_agreement(computed, far).collect()
    assert {r.mito_frac for r in qc.with_shipped(computed, far.where("cell_id < 4")).collect()} == {0.01, 0.0}


def test_a_streamed_cell_without_counts_is_left_out(spark):
    folder, out, state = (fresh_path(spark, n) for n in ("cells", "means", "state"))
    rows = [(1, "A", "b", ["g0", "g1"], [3, 1]), (2, "A", "b", ["g0", "g1"], [0, 0]), (3, "A", "b", ["g1", "g2"], [2, 2]), (4, "A", "b", ["g0", "g1"], [5, 0])]
    spark.createDataFrame(rows, ingest.SCHEMA).write.parquet(folder)
    stream = ingest.clean_stream(ingest.batch_stream(spark, folder), min_genes=2)
    ingest.start_incremental_means(stream, out, state).awaitTermination()
    means = {r.gene: r for r in ingest.read_incremental_means(spark, out).collect()}
    assert {g: (r.n_cells, r.nnz) for g, r in means.items()} == {"g0": (2, 1), "g1": (2, 2), "g2": (2, 1)}
    assert means["g0"].m == pytest.approx(means["g0"].sx / 2)


def test_stamps_follow_content(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "x long, y string")
    assert store.content_stamp(df) == store.content_stamp(df.orderBy(F.desc("x")))
    assert store.content_stamp(df) != store.content_stamp(df.where("x = 1"))
    assert store.content_stamp(df) != store.content_stamp(df.withColumnRenamed("y", "z"))
    root, calls = fresh_path(spark, "stamped"), []

    def build():
        calls.append(1)
        return df

    for inputs in (["a"], ["a"], ["b"]):
        store.stamped_stage(spark, root, "s", {"p": 1}, build, ["x"], inputs)
    assert len(calls) == 2


def scored_case(spark, names, **tables):
    case = Case(spark)
    predicted = predictors.run("Mean-over-perturbations", case.screen)
    rng = np.random.default_rng(8)
    made = [(b, k, g, float(rng.uniform(0, 1)), bool(rng.random() < 0.6), int(rng.choice([-1, 1]))) for b in case.bins for k in case.kos for g in case.genes.toPandas().gene]
    weights = spark.createDataFrame(made, "bin string, ko string, gene string, w double, deg boolean, dir int")
    return case, metrics.score(predicted, case.deltas, case.screen.rect, weights, names, top_k=3, min_set=1, **tables), predicted, weights


RELATION = [("go", "G0", "G1"), ("go", "G0", "G2"), ("ppi", "G1", "G5"), ("pathway", "G2", "G0"), ("tf_target", "G0", "G4"), ("tf_target", "G3", "G1"), ("go", "G4", "G4")]


def test_every_suffix_scores_its_own_features(spark):
    relation = spark.createDataFrame(RELATION, "kind string, src string, dst string")
    suffixes = [s for s in catalogue.SUFFIXES if s]
    case = Case(spark)
    _, out, predicted, weights = scored_case(spark, ["mse" + s for s in suffixes], relation=relation, ctrl=case.ctrl, top_expressed=2)
    got = {(r.bin, r.ko, r.metric): r.value for r in out.collect()}
    p = {(r.bin, r.ko, r.gene): r.delta for r in predicted.collect()}
    w = {(r.bin, r.ko, r.gene): r.w for r in weights.collect()}
    truth = {(r.bin, r.ko, r.gene): (r.d_first, r.d_all) for r in case.deltas.collect()}
    genes = sorted({g for *_, g in truth})
    level = {g: np.mean([case.c[i, m] for i in range(len(case.bins))]) for m, g in enumerate(genes)}
    expressed = sorted(genes, key=lambda g: -level[g])[:2]
    variance = {g: np.var([v[1] for k, v in truth.items() if k[2] == g], ddof=1) for g in genes}
    seen = 0
    for b, ko in {k[:2] for k in p}:
        t = {g: truth[(b, ko, g)][0] for g in genes}
        top = sorted(genes, key=lambda g: (-abs(t[g]), g))[:3]
        regulator = any(src == ko for _, src, _ in RELATION)
        for suffix in suffixes:
            features, regulators = catalogue.SUFFIXES[suffix]
            kind, _, side = features.rpartition("_")
            linked = {dst for k, src, dst in RELATION if src == ko and (k == kind or not kind)}
            own = genes
            if side in ("within", "outside"):
                own = [g for g in genes if (g in linked) == (side == "within")]
            elif features == "top_1000_expressed":
                own = expressed
            elif suffix.startswith("_top_200"):
                own = top
            if regulators and not regulator:
                own = []
            weight = {"_weighted": {g: w[(b, ko, g)] for g in genes}, "_var_weighted": variance}.get(suffix, dict.fromkeys(genes, 1.0))
            value = got.get((b, ko, "mse" + suffix))
            if own:
                seen += 1
                want = sum(weight[g] * (p[(b, ko, g)] - t[g]) ** 2 for g in own) / sum(weight[g] for g in own)
                assert value == pytest.approx(want), (b, ko, suffix)
            else:
                assert value is None, (b, ko, suffix)
    assert seen > 60


def test_all_names_of_the_catalogue_are_scored(spark):
    relation = spark.createDataFrame(RELATION, "kind string, src string, dst string")
    names = {m.name for suffixes in (catalogue.STANDARD, catalogue.REAL_DATA) for m in catalogue.metrics(suffixes)}
    case, out, _, _ = scored_case(spark, sorted(names), relation=relation, ctrl=Case(spark).ctrl, top_expressed=4)
    found = {r.metric for r in out.select("metric").distinct().collect()}
    # small feature sets may leave a correlation undefined, everything else has a value
    assert {n for n in names - found if "within" not in n} == set()


def test_unknown_metrics_and_missing_tables_raise(spark):
    with pytest.raises(ValueError, match="unknown metrics"):
        scored_case(spark, ["mse", "mse_sideways"])
    with pytest.raises(ValueError, match="need a relation table"):
        scored_case(spark, ["mse_go_within"])


def test_ridge_with_more_bins_than_a_dense_system_would_take():
    rng = np.random.default_rng(4)
    b, k = np.repeat(np.arange(6000), 3), rng.integers(0, 40, 18_000)
    bin_effect, label_effect = rng.normal(size=6000), rng.normal(size=40)
    y = bin_effect[b] + label_effect[k]
    d_b, d_k = np.bincount(b) + 1e-8, np.bincount(k) + 1e-8
    right = np.bincount(b, y) - np.bincount(b, (np.bincount(k, y) / d_k)[k])
    w_b = linear.schur_solve(b, k, d_b, d_k, right)
    w_k = (np.bincount(k, y) - np.bincount(k, w_b[b])) / d_k
    assert np.allclose(w_b[b] + w_k[k], y, atol=1e-5)
