"""Small hand-made cases with known answers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from deltascreen.functions import labels
from deltascreen.functions.tdist import t_two_sided_p
from deltascreen.operators import (
    bulk, deg, discrimination, hvg, linear, meta, metrics, predictors, qc, quality, sampling, splits, training,
)
from deltascreen.operators.scale import exact_median, hash_rank, running_sum, tile
from deltascreen.plans import catalogue

GENES = [f"G{i}" for i in range(6)]


def one(df, column=0):
    return df.first()[column]


# ---- labels --------------------------------------------------------------------------------
@pytest.mark.parametrize("raw, want", [
    ("QRS7_4", "QRS7"), ("zed+abe_12", "abe+zed"), ("m;n_6+k", "k+m;n"), ("w_9@0.3", "w@0.3"), ("control", "control"),
    ("ctrl", "control"), ("nan", None), ("pq+*", None), ("v;nan", None), ("", None), (None, None),
    ("uv+", None), ("w@0.3@late", "w@0.3@late"),
])
def test_clean_label(spark, raw, want):
    df = spark.createDataFrame([(raw,)], "raw string")
    assert one(df.select(labels.clean_label(F.col("raw")))) == want


@pytest.mark.parametrize("ko, genes, dose", [
    ("lam1", ["lam1"], 1.0), ("lam1@0.75", ["lam1"], 0.75), ("lam1+mu", ["lam1", "mu"], 1.0),
    ("x-+yz@0.40", ["x-", "yz"], 0.4), ("p;q", ["p", "q"], 1.0),
])
def test_dose(spark, ko, genes, dose):
    df = spark.createDataFrame([(ko,)], "ko string")
    r = df.select(labels.dose_targets(F.col("ko")).alias("g"), labels.dose_of(F.col("ko")).alias("d")).first()
    assert (r.g, r.d) == (genes, dose)


@pytest.mark.parametrize("guide, want", [
    ("KX9_7;NO_SITE_52", ["KX9"]), ("NO_SITE_8;ONE_NON-GENE_SITE_3", []), ("U2_5;V4_6", ["U2", "V4"]), ("nan", None),
])
def test_guides(spark, guide, want):
    df = spark.createDataFrame([(guide,)], "g string")
    got = one(df.select(labels.guide_targets(F.col("g"))))
    assert (got if got is None else sorted(got)) == want


@pytest.mark.parametrize("label, want", [
    ("QQ1+ZB2+3", "QQ1+ZB2_3"), ("QQ1+4+ZB2+3", "QQ1_4+ZB2_3"), ("dd+cc", "cc+dd"), ("cc", "cc")])
def test_guide_combo_key(spark, label, want):
    df = spark.createDataFrame([(label,)], "c string")
    assert one(df.select(labels.combo_key_with_guides(F.col("c")))) == want


def test_flag_rule_rejects_ambiguous_rows(spark):
    df = spark.createDataFrame([(0, 0, 1, "A", "B")], "c int, d int, s int, a string, b string")
    with pytest.raises(Exception, match="ambiguous"):
        df.select(labels.condition_from_flags(*[F.col(x) for x in "cdsab"])).collect()


# ---- scale building blocks -----------------------------------------------------------------
def test_hash_rank_is_a_permutation_for_a_hot_group(spark):
    df = spark.range(4000).select("id", F.when(F.col("id") < 3000, "hot").otherwise(F.concat(F.lit("c"), F.col("id") % 50)).alias("g"))
    r = hash_rank(df, ["g"], F.md5(F.col("id").cast("string")), ["id"])
    pdf = r.toPandas()
    for _, part in pdf.groupby("g"):
        assert sorted(part["rank"]) == list(range(1, len(part) + 1))
        assert (part["group_size"] == len(part)).all()
    hot = pdf[pdf.g == "hot"].sort_values("rank")["id"].astype(str)
    import hashlib

    assert list(hot) == sorted(hot, key=lambda s: hashlib.md5(s.encode()).hexdigest())


@pytest.mark.parametrize("n", [1, 2, 3, 10, 1001, 5000])
def test_exact_median(spark, n):
    v = np.random.default_rng(n).normal(size=n).round(2)
    df = spark.createDataFrame([("a", float(x)) for x in v] + [("b", 1.0)], "g string, v double")
    got = {r.g: r.median for r in exact_median(df, ["g"], "v").collect()}
    assert got["a"] == pytest.approx(np.median(v)) and got["b"] == 1.0
    assert one(exact_median(df.where("g = 'a'"), [], "v")) == pytest.approx(np.median(v))
    assert one(exact_median(df.where("false"), [], "v")) is None


def test_running_sum(spark):
    v = np.random.default_rng(0).permutation(500)
    df = spark.createDataFrame([(float(x), float(1 + x % 3)) for x in v], "v double, w double")
    got = running_sum(df, [], "v", "w", "s", n_buckets=16).orderBy("v").toPandas()
    assert np.allclose(got["s"], np.cumsum(got["w"]))


def test_tile_matches_near_equal_blocks(spark):
    for n, f in [(11, 5), (3, 5), (10, 5), (7, 2)]:
        got = [r.b for r in spark.range(1, n + 1).select(tile(F.col("id"), F.lit(n), f).alias("b")).collect()]
        assert got == [i for i, b in enumerate(np.array_split(np.arange(n), f)) for _ in b]


# ---- quality gates -------------------------------------------------------------------------
def test_retention_contradictions(spark):
    cells = spark.createDataFrame([(i, 200.0 + i, 100.0) for i in range(20)], "cell_id long, ncounts double, UMI_count double")
    totals = spark.createDataFrame([(i, 120, 5) for i in range(20)], "cell_id long, total long, n_genes long")
    r = qc.count_retention(cells, totals).first()
    assert r.depth_column == "ncounts" and r.problem is not None
    with pytest.raises(Exception, match="incomplete"):
        qc.enforce(qc.count_retention(cells, totals)).collect()
    assert qc.count_retention(cells, totals, "ncounts").first().problem is None
    assert qc.count_retention(cells, totals, "UMI_count").first().problem is not None
    nothing = qc.count_retention(cells.select("cell_id"), totals).first()
    assert nothing.depth_column == "none" and nothing.retention is None


def test_depth_must_be_positive(spark):
    cells = spark.createDataFrame([(1, 0.0)], "cell_id long, d double")
    with pytest.raises(Exception, match="non-positive"):
        qc.resolve_depth(cells, "d").collect()
    with pytest.raises(KeyError):
        qc.resolve_depth(cells, "missing")


def test_mito_gate_that_removes_most_cells_fails(spark):
    rows = [(c, "MT-A", 30) for c in range(20)] + [(c, "G", 70) for c in range(20)]
    counts = spark.createDataFrame(rows, "cell_id long, gene string, cnt long")
    cells = spark.createDataFrame([(c, "control") for c in range(20)], "cell_id long, condition string")
    flags = qc.qc_flags(cells, qc.mito_fraction(counts), min_genes=1)
    audit = qc.qc_audit(flags)
    assert {r.gate: r.status for r in audit.collect()}["mito"] == "error"
    with pytest.raises(Exception, match="most cells"):
        qc.require_audit(audit).collect()
    skipped = qc.qc_audit(qc.qc_flags(cells, qc.mito_fraction(counts), min_genes=1, apply_mito=False), False, False)
    assert {r.gate: r.applied for r in skipped.collect()} == {"min_genes": True, "mito": False, "guide_moi": False}


def test_guide_violations(spark):
    made = [("control", 2), ("s1", 3), ("s1+s2", 2), ("s1", None), ("control", 0), ("s1+s2", 4)]
    rows = [(i, c, n) for i, (c, n) in enumerate(made)]
    cells = spark.createDataFrame(rows, "cell_id int, condition string, n int")
    checked = qc.guide_check(cells, F.col("n"))
    assert [r.violation for r in checked.orderBy("cell_id").collect()] == [True, True, False, False, False, True]
    assert qc.guide_summary(checked).first().n_unassigned == 1


def test_draws_are_independent_per_condition(spark):
    cells = spark.range(400).select(F.col("id").alias("cell_id"), F.lit("b").alias("bin"),
                                    F.concat(F.lit("g"), F.col("id") % 4).alias("condition"))
    kept = lambda df: {r.cell_id for r in sampling.downsample(df, 12, 50, 30).collect() if r.condition == "g0"}
    assert kept(cells) == kept(cells.where("condition <> 'g3'")) and len(kept(cells)) == 30
    assert sampling.downsample(cells.where("cell_id < 40"), 12).count() == 0


def test_weighted_draws_follow_the_weights(spark):
    items = spark.createDataFrame([("a", 1.0), ("b", 3.0), ("c", 6.0)], "k string, weight double")
    got = {r.k: r["count"] for r in sampling.weighted_draws(items, ["k"], 20000).groupBy("k").count().collect()}
    assert sum(got.values()) == 20000
    assert got["a"] == pytest.approx(2000, rel=0.1) and got["c"] == pytest.approx(12000, rel=0.05)


# ---- highly variable features ----------------------------------------------------------------
def test_hvg_finds_the_noisy_features(spark):
    rng = np.random.default_rng(1)
    rows = []
    for g in range(40):
        lam = np.full(150, 3.0 + g) if g % 10 != 5 else rng.gamma(0.5, 2 * (3.0 + g), 150)
        rows += [(c, f"g{g:02d}", int(x)) for c, x in enumerate(rng.poisson(lam)) if x > 0]
    counts = spark.createDataFrame(rows, "cell_id long, gene string, cnt long")
    cells = spark.range(150).withColumnRenamed("id", "cell_id")
    genes = counts.select("gene").distinct()
    top = {r.gene for r in hvg.select_hvg(counts, cells, genes, 4).where("hvg").collect()}
    assert top == {"g05", "g15", "g25", "g35"}


# ---- splits ----------------------------------------------------------------------------------
def pair_grid(spark, n_bins, kos):
    return spark.createDataFrame([(f"b{i}", k) for i in range(n_bins) for k in kos], "bin string, ko string")


@pytest.mark.parametrize("n_bins", [2, 3, 6])
def test_split_invariants(spark, n_bins):
    kos = [f"g{i}" for i in range(9)] + ["g0+g1", "g2+g3", "g4+g5", "g1@0.5", "g2@0.5"]
    split = splits.all_pair_splits(pair_grid(spark, n_bins, kos), 5).cache()
    checks = quality.conventions(split)
    assert [r for r in checks.collect() if not r.ok] == []
    assert all(r.ok for r in quality.mask_leak(split).collect())
    scenarios = {r.scenario for r in split.select("scenario").distinct().collect()}
    assert ("UnseenCell" in scenarios) == (n_bins >= 3)


def test_single_bin_has_no_bin_scenarios(spark):
    split = splits.all_pair_splits(pair_grid(spark, 1, ["g0", "g1", "g2"]), 3)
    assert {r.scenario for r in split.select("scenario").distinct().collect()} == {"UnseenPert"}


def test_checks_catch_corruption(spark):
    split = splits.unseen_pert(pair_grid(spark, 3, [f"g{i}" for i in range(5)]), 5)
    broken = split.withColumn("label", F.when((F.col("bin") == "b0") & (F.col("fold") == 0), "train").otherwise(F.col("label")))
    assert any(not r.ok for r in quality.conventions(broken).where("check = 'held_in_every_bin'").collect())


@pytest.mark.parametrize("scenario, rows, ok", [
    ("UnseenPert", [("A", "x", "train"), ("B", "x", "test"), ("control", "x", "test")], True),
    ("UnseenPert", [("A", "x", "train"), ("A", "y", "test")], False),
    ("UnseenPert", [("A", "x", "val"), ("A", "x", "test")], False),
    ("UnseenPair", [("A", "x", "train"), ("A", "y", "test")], True),
    ("UnseenPair", [("A", "x", "train"), ("A", "x", "test")], False),
    ("UnseenPert", [("A", "x", "train")], False),
])
def test_leak_gate(spark, scenario, rows, ok):
    cells = spark.createDataFrame([(i, c, b) for i, (c, b, _) in enumerate(rows)], "cell_id long, condition string, bin string")
    roles = spark.createDataFrame([(i, scenario, 0, r) for i, (_, _, r) in enumerate(rows)],
                                  "cell_id long, scenario string, fold int, label string")
    assert quality.leak_gate(cells, roles).first().ok is ok


# ---- differential effect -----------------------------------------------------------------------
def brute_u(x, y):
    u = sum((a > b) + 0.5 * (a == b) for a in x for b in y)
    both = np.concatenate([x, y])
    _, t = np.unique(both, return_counts=True)
    n1, n0, n = len(x), len(y), len(both)
    var = n1 * n0 / 12 * ((n + 1) - (t**3 - t).sum() / (n * (n - 1)))
    return u, (u - n1 * n0 / 2) / np.sqrt(var) if var > 0 else 0.0


def test_rank_test_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    conds = ["control"] * 40 + ["A"] * 30 + ["B"] * 20
    x = rng.poisson(1.0, (90, 3))
    x[:, 2] = 0
    cells = spark.createDataFrame([(i, "b", "first_half" if i % 2 else "second_half", c) for i, c in enumerate(conds)],
                                  "cell_id long, bin string, half string, condition string")
    expr = spark.createDataFrame([(i, f"G{g}", float(x[i, g])) for i in range(90) for g in range(3) if x[i, g] > 0],
                                 "cell_id long, gene string, v double")
    genes = spark.createDataFrame([(f"G{g}",) for g in range(3)], "gene string")
    got = {(r.half, r.ko, r.gene): r for r in deg.rank_statistics(expr, cells, genes).collect()}
    arr = np.array(conds)
    for half, pick in (("all", np.ones(90, bool)), ("first_half", np.arange(90) % 2 == 1)):
        for ko in "AB":
            for g in range(3):
                u, z = brute_u(x[(arr == ko) & pick, g], x[(arr == "control") & pick, g])
                r = got[(half, ko, f"G{g}")]
                assert r.u == pytest.approx(u) and r.z == pytest.approx(z)
    assert got[("all", "A", "G2")].p == 1.0 and got[("all", "A", "G2")].fc == 1.0


def test_pooled_adjustment_matches_brute_force(spark):
    p = np.round(np.random.default_rng(5).beta(0.4, 1, 700), 3)
    p[:200] = 1.0
    df = spark.createDataFrame([("k", i, float(v)) for i, v in enumerate(p)], "pool string, i int, p double")
    got = deg.bh_pooled(df, ["pool"], salt=["i"], n_buckets=16).orderBy("i").toPandas()["padj"].to_numpy()
    order = np.argsort(p, kind="stable")
    adj = np.minimum.accumulate((p[order] * len(p) / np.arange(1, len(p) + 1))[::-1])[::-1].clip(0, 1)
    want = np.empty_like(p)
    want[order] = adj
    assert np.allclose(got, want)


def test_t_distribution_tail(spark):
    # two-sided tail values of Student t from published tables
    cases = [(2.228, 10.0, 0.05), (12.706, 1.0, 0.05), (1.96, 1e6, 0.05), (3.169, 10.0, 0.01), (0.0, 5.0, 1.0)]
    df = spark.createDataFrame([(t, d) for t, d, _ in cases], "t double, d double")
    got = [r[0] for r in df.select(t_two_sided_p(F.col("t"), F.col("d"))).collect()]
    assert np.allclose(got, [c[2] for c in cases], atol=2e-4)


def test_gene_weights(spark):
    rows = [("b", "k", f"G{i}", s, p, False) for i, (s, p) in enumerate([(-5.0, .02), (1.0, .003), (3.0, .04), (9.0, .5)])]
    schema = "bin string, ko string, gene string, score double, padj double, substituted boolean"
    got = deg.gene_weights(spark.createDataFrame(rows, schema)).orderBy("gene").collect()
    assert [r.w for r in got] == pytest.approx([1.0, 0.2, 0.6, 0.0]) and [r.dir for r in got] == [-1, 1, 1, 0]
    starved = spark.createDataFrame([("b", "k", "G3", 2.5, .02, True)], schema)
    with pytest.raises(Exception, match="no measured"):
        deg.gene_weights(starved).collect()


# ---- predictors --------------------------------------------------------------------------------
class Case:
    """Three bins, labels G0..G4 plus a combination and a dose, random deltas."""

    def __init__(self, spark, scenario="UnseenPert", seed=0, kos=None, bins=3):
        rng = np.random.default_rng(seed)
        self.kos = kos or ["G0", "G1", "G2", "G3", "G4", "G0+G1", "G2+G3", "G1@0.5", "absent"]
        self.bins = [f"b{i}" for i in range(bins)]
        self.d = rng.normal(size=(bins, len(self.kos), len(GENES)))
        self.c = rng.uniform(1, 2, size=(bins, len(GENES)))
        rows = [
            (b, k, g, float(self.d[i, j, m]), float(self.d[i, j, m] + 0.1), float(self.d[i, j, m] - 0.1),
             float(self.d[i, j, m] + self.c[i, m]), float(self.c[i, m]))
            for i, b in enumerate(self.bins) for j, k in enumerate(self.kos) for m, g in enumerate(GENES)]
        self.deltas = spark.createDataFrame(
            rows, "bin string, ko string, gene string, d_all double, d_first double, d_second double, m_all double, ctrl double")
        self.ctrl = self.deltas.select("bin", "gene", F.col("ctrl").alias("m")).distinct()
        self.genes = spark.createDataFrame([(g, i) for i, g in enumerate(GENES)], "gene string, gene_ord int")
        pairs = self.deltas.select("bin", "ko").distinct()
        self.split = splits.BUILDERS[scenario](pairs, 4).where("fold = 0").cache()
        self.label = {(r.bin, r.ko): r.label for r in self.split.collect()}
        self.mask = np.array([[self.label[(b, k)] == "train" for k in self.kos] for b in self.bins])
        self.screen = predictors.Screen(self.deltas, self.ctrl, self.genes, self.split)

    def run(self, name):
        out = {}
        for r in predictors.run(name, self.screen).collect():
            out.setdefault((r.bin, r.ko), {})[r.gene] = r.delta
        return {k: np.array([v[g] for g in GENES]) for k, v in out.items()}

    def test_rect(self):
        return [(i, j) for i, b in enumerate(self.bins) for j, k in enumerate(self.kos)
                if any(self.label[(x, k)] == "test" for x in self.bins)
                and any(self.label[(b, y)] == "test" for y in self.kos)]


@pytest.mark.parametrize("name, lam", [("Ridge", 1.0), ("LinearAdditive", 1e-8)])
@pytest.mark.parametrize("scenario", ["UnseenPert", "UnseenPair"])
def test_ridge_matches_the_full_solve(spark, name, lam, scenario):
    case = Case(spark, scenario)
    bi, ki = np.where(case.mask)
    x = np.zeros((len(bi), len(case.kos) + len(case.bins)))
    x[np.arange(len(bi)), ki] = 1
    x[np.arange(len(bi)), len(case.kos) + bi] = 1
    y = case.d[bi, ki]
    w = np.linalg.solve(x.T @ x + lam * np.eye(x.shape[1]), x.T @ (y - y.mean(0)))
    got = case.run(name)
    for i, j in case.test_rect():
        want = w[j] + w[len(case.kos) + i] + y.mean(0)
        assert np.allclose(got[(case.bins[i], case.kos[j])], want, atol=1e-5)


def _low_rank_reference(case, bilinear, k=10):
    y = np.stack([case.d[case.mask[:, j], j].mean(0) for j in range(len(case.kos)) if case.mask[:, j].any()], 1)
    kos = [ko for j, ko in enumerate(case.kos) if case.mask[:, j].any()]
    if not bilinear:
        level = case.d + case.c[:, None, :]
        bins = case.mask.any(1)
        y = np.stack([level[case.mask[:, j], j].mean(0) for j in range(len(case.kos)) if case.mask[:, j].any()], 1)
        y = y - case.c[bins].mean(0)[:, None]
    index = {g: i for i, g in enumerate(GENES)}
    tokens = {ko: [t for t in ko.split("@")[0].split("+")] for ko in case.kos}
    center = y.mean(1)
    yc = y - center[:, None]
    if bilinear:
        emb = np.linalg.svd(yc.T, full_matrices=False)[2][:k].T
        keep = [i for i, ko in enumerate(kos) if ko in index]
        b = np.stack([emb[index[kos[i]]] for i in keep], 1)
        center = y[:, keep].mean(1)
        fit = y[:, keep] - center[:, None]
        label = lambda ko: emb[index[ko]] if ko in index else None
    else:
        z = yc - yc.mean(0)
        u, s, _ = np.linalg.svd(z, full_matrices=False)
        emb = (u * s)[:, :k]
        keep = [i for i, ko in enumerate(kos) if all(t in index for t in tokens[ko])]
        label = lambda ko: emb[[index[t] for t in tokens[ko]]].mean(0) if all(t in index for t in tokens[ko]) else None
        b = np.stack([label(kos[i]) for i in keep], 1)
        fit = yc[:, keep]
    eye = 0.1 * np.eye(emb.shape[1])
    core = np.linalg.solve(emb.T @ emb + eye, emb.T @ fit @ b.T) @ np.linalg.inv(b @ b.T + eye)
    return lambda ko: None if label(ko) is None else emb @ core @ label(ko) + center


@pytest.mark.parametrize("name, scenario", [("BilinearRidge", "UnseenPert"), ("LatentAdditive", "UnseenPert"), ("LatentAdditive", "UnseenPair")])
def test_low_rank_matches_numpy(spark, name, scenario):
    case = Case(spark, scenario, seed=2)
    case.screen.options["k"] = 3
    want = _low_rank_reference(case, name == "BilinearRidge", 3)
    got = case.run(name)
    seen = 0
    for i, j in case.test_rect():
        expected = want(case.kos[j])
        if expected is None:
            assert (case.bins[i], case.kos[j]) not in got
        else:
            seen += 1
            assert np.allclose(got[(case.bins[i], case.kos[j])], expected, atol=1e-6)
    assert seen > 0


def test_target_scaling_recovers_its_factor(spark):
    case = Case(spark)
    hit = F.array_contains(labels.target_tokens(F.col("ko")), F.col("gene"))
    case.screen.deltas = case.deltas.withColumn("d_all", F.when(hit, -0.7 * F.col("ctrl")).otherwise(F.col("d_all")))
    assert one(predictors.target_scale(case.screen), "scale") == pytest.approx(0.7)
    for (b, ko), row in case.run("TargetScaling").items():
        for g, v in zip(GENES, row):
            want = -0.7 * case.c[case.bins.index(b), GENES.index(g)] if g in ko.split("@")[0].split("+") else 0.0
            assert v == pytest.approx(want)


def test_target_scaling_rejects_degenerate_folds(spark):
    case = Case(spark, kos=["absent1", "absent2", "absent3"])
    with pytest.raises(Exception, match="no training target"):
        predictors.target_scale(case.screen).collect()
    case = Case(spark)
    case.screen.deltas = case.deltas.withColumn("ctrl", F.lit(0.0))
    with pytest.raises(Exception, match="control is zero"):
        predictors.target_scale(case.screen).collect()


def test_epistasis_without_training_combinations_is_additive(spark):
    kos = ["G0", "G1", "G2", "G3", "G0+G1"]
    case = Case(spark, "UnseenCombo", kos=kos)
    case.screen.split = case.split.withColumn("label", F.when(F.col("ko") == "G0+G1", "test").otherwise("train"))
    got = case.run("GlobalEpistasis")
    for i, b in enumerate(case.bins):
        assert np.allclose(got[(b, "G0+G1")], case.d[i, 0] + case.d[i, 1])


def test_every_predictor_is_registered_once():
    assert len(predictors.REGISTRY) == 19
    assert predictors.select_predictors("controls,Zero") == ["Tech-duplicate", "Interp-duplicate", "Zero"]
    assert "Additive" not in predictors.select_predictors("all", "UnseenPert")
    assert predictors.select_folds("0-2,4", 5) == [0, 1, 2, 4]
    with pytest.raises(KeyError):
        predictors.select_predictors("nobody")
    with pytest.raises(ValueError):
        predictors.register_predictor("Zero", "analytical", [])(lambda s: s)


# ---- metrics -----------------------------------------------------------------------------------
def test_missing_genes(spark):
    truth = spark.createDataFrame(
        [("b", k, f"f{i}", 3.0 if i == 4 else 0.0) for k in ("u", "v") for i in range(5)],
        "bin string, ko string, gene string, d_first double")
    pred = spark.createDataFrame([("s", 0, "p", "b", "v", f"f{i}", 0.0) for i in range(4)],
                                 "scenario string, fold int, predictor string, bin string, ko string, gene string, delta double")
    rect = spark.createDataFrame([("s", 0, "b", k) for k in ("u", "v")], "scenario string, fold int, bin string, ko string")
    frame = metrics.score_frame(pred, truth, rect)
    fill = metrics.row_metrics(frame, ["mse"], "fill", slices=[metrics.Slice("")]).collect()
    drop = metrics.row_metrics(frame, ["mse"], "drop", slices=[metrics.Slice("")]).collect()
    assert [(r.ko, r.value, r.n_genes_valid) for r in fill] == [("v", pytest.approx(1.8), 5)]
    assert [(r.ko, r.value, r.n_genes_valid) for r in drop] == [("v", 0.0, 4)]
    with pytest.raises(ValueError):
        metrics.row_metrics(frame, ["mse"], "other")


def test_constant_predictions_rank_in_the_middle(spark):
    rng = np.random.default_rng(0)
    rows = [(f"k{i:02d}", [0.0] * 5, [float(x) for x in rng.normal(size=5)]) for i in range(30)]
    prof = spark.createDataFrame(rows, "id string, p array<double>, t array<double>")
    assert {r.value for r in discrimination.cosine_rank(prof, [], size=7).collect()} == {0.5}
    same = prof.withColumn("p", F.col("t"))
    assert {r.value for r in discrimination.cosine_rank(same, [], size=7).collect()} == {0.0}
    assert one(discrimination.pds(same, [], "l2", size=7)) == 1.0
    assert one(discrimination.energy_distance(same, [], size=7)) == pytest.approx(0.0, abs=1e-9)
    single = same.where("id = 'k00'").withColumn("p", F.transform("t", lambda x: x + 1.0))
    assert one(discrimination.energy_distance(single, [])) == pytest.approx(np.sqrt(5))
    with pytest.raises(ValueError):
        discrimination.pds(prof, [], "other")


def test_principal_components_match_numpy(spark):
    x = np.random.default_rng(4).normal(size=(40, 6))
    df = spark.createDataFrame([([float(v) for v in r],) for r in x], "v array<double>")
    v, s = linear.right_singular(df, 3)
    want = np.linalg.svd(x, full_matrices=False)
    assert np.allclose(s, want[1][:3]) and np.allclose(np.abs(v.T), np.abs(want[2][:3]), atol=1e-8)


def test_catalogue_sizes():
    assert len(catalogue.headline_metrics()) == 16
    assert len(catalogue.metrics()) == 66 and len(catalogue.metrics(catalogue.REAL_DATA)) == 108


def test_empty_bins_stay_in_summaries(spark):
    rows = [("s", 0, "p", "b0", "k", "mse", 1.0, 0.5), ("s", 0, "q", "b1", "k", "mse", 2.0, 0.5)]
    df = spark.createDataFrame(rows, "scenario string, fold int, predictor string, bin string, ko string, metric string, value double, x double")
    got = {(r.predictor, r.view): r.n for r in meta.summarise(df, "value", ["predictor"], clean=False).collect()}
    assert got == {("p", "b0"): 1, ("p", "b1"): 0, ("p", "combined"): 1, ("q", "b0"): 0, ("q", "b1"): 1, ("q", "combined"): 1}


def test_unrepresentable_labels(spark):
    kos = spark.createDataFrame([(k,) for k in ("G4", "G2@0.7", "G2+G4", "offpanel")], "ko string")
    genes = spark.createDataFrame([(g,) for g in GENES], "gene string")
    assert [r.ko for r in training.unrepresentable(kos, genes).collect()] == ["offpanel"]
    marks = {(r.ko, r.gene): r.dose for r in training.perturbation_marker(kos, genes).collect()}
    assert marks[("G2@0.7", "G2")] == 0.7 and marks[("G2+G4", "G4")] == 1.0


def test_bulk_counts_zeros(spark):
    cells = spark.createDataFrame([(i, "b", "control" if i < 4 else "k", "first_half" if i % 2 else "second_half") for i in range(20)],
                                  "cell_id long, bin string, condition string, half string")
    expr = spark.createDataFrame([(i, "G0", 1.0) for i in range(0, 20, 4)], "cell_id long, gene string, x double")
    genes = spark.createDataFrame([("G0",), ("G1",)], "gene string")
    ctrl = bulk.control_bulk(expr, cells, genes)
    assert {r.gene: r.m for r in ctrl.collect()} == {"G0": 0.25, "G1": 0.0}
    d = bulk.deltas(bulk.half_bulk(expr, cells, genes), ctrl).where("gene = 'G0'").first()
    assert d.d_all == pytest.approx(0.0) and d.d_second == pytest.approx(0.25) and d.d_first == pytest.approx(-0.25)
