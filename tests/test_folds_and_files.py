"""Fold-wise nearest references against a plain search, and coordinate files with every kind of fault."""

import gzip
import random

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from deltascreen.operators import blocks, discrimination
from deltascreen.sources import batches


def words(folds, n):
    out = [0] * max(1, -(-n // blocks.FOLD_BITS))
    for f in folds:
        out[f // blocks.FOLD_BITS] |= 1 << f % blocks.FOLD_BITS
    return out


@pytest.mark.parametrize("n_folds", [1, 9, 130])
def test_every_fold_has_its_own_best_reference(spark, n_folds):
    rng = random.Random(n_folds)
    pick = lambda share: {f for f in range(n_folds) if rng.random() < share}
    profiles = [(f"p{i:02d}", f"place{i % 3}", [float(rng.randint(0, 3)) for _ in range(5)]) for i in range(40)]
    profiles[7] = ("p07", "place1", profiles[4][2])  # a tie
    own, wide, fits = {}, {}, {}
    for name, place, _ in profiles:
        asked = pick(0.5)
        own[name] = asked if place == "place0" else {f for f in asked if rng.random() < 0.5}
        wide[name] = asked - own[name]
        fits[name] = pick(0.3) if name > "p05" else set()
    rows = [(n, p, v, words(own[n], n_folds), words(wide[n], n_folds), words(fits[n], n_folds)) for n, p, v in profiles]
    df = spark.createDataFrame(rows, "id string, place string, v array<double>, own array<long>, wide array<long>, fits array<long>")
    found = discrimination.nearest_by_fold(df.select("id", "place", "own", "wide", "v"), df.select("id", "place", "fits", "v"), n_folds, size=6)
    want = set()
    for q, place, a in profiles:
        x = np.array(a) - np.mean(a)
        for f in own[q] | wide[q]:
            near = []
            for r, other, b in profiles:
                if f in fits[r] and (f in wide[q] or other == place):
                    y = np.array(b) - np.mean(b)
                    near.append((-round(float(x @ y / np.sqrt(x @ x * (y @ y) + 1e-8)), 9), r))
            if near:
                want.add((q, f, min(near)[1]))
    got = [(r.id, r.number, r.ref) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_fold_bits_are_sets(spark):
    df = spark.range(200).select((F.col("id") % 2).alias("k"), (F.col("id") % 100).cast("int").alias("n"))
    rows = {r.k: r.b for r in df.groupBy("k").agg(blocks.fold_bits(100, F.col("n"), F.col("n") % 3 == 0).alias("b")).collect()}
    assert rows == {k: words([n for n in range(100) if n % 2 == k and n % 3 == 0], 100) for k in (0, 1)}


@pytest.fixture
def matrix(tmp_path):
    def write(text, features="id1\tA\tx\nid2\tB\tx\n", barcodes="c1\nc2\n\nc4\n", pack=False):
        for name, content in (("matrix", text), ("features", features), ("barcodes", barcodes)):
            (gzip.open if pack else open)(tmp_path / (name + ".txt" + ".gz" * pack), "wt").write(content)
        return [str(tmp_path / (n + ".txt" + ".gz" * pack)) for n in ("matrix", "features", "barcodes")]

    return write


BANNER = "%%MatrixMarket matrix coordinate integer general\n% made by hand\n"


def test_blank_lines_count_and_files_follow_by_name(spark, tmp_path):
    for i in range(5):
        (tmp_path / f"part-{i}").write_text("".join(f"{i}-{k}\n" if k % 7 else "\n" for k in range(40)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    try:
        rows = batches.numbered_lines(spark, str(tmp_path), ["a", "gone"]).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted((r.idx, r.a) for r in rows) == [(40 * i + k + 1, f"{i}-{k}") for i in range(5) for k in range(40) if k % 7]
    assert all(r.gone is None for r in rows)


@pytest.mark.parametrize("pack", [False, True])
def test_an_entry_may_look_like_the_size_line(spark, matrix, pack):
    files = matrix(BANNER + "2 2 2\n2 2 2\n1  1 5\n", barcodes="c1\nc2\n", pack=pack)
    assert {tuple(r) for r in batches.read_matrix_market(spark, *files).collect()} == {("c2", "B", 2), ("c1", "A", 5)}


def test_turned_matrix_of_reals(spark, matrix):
    files = matrix(BANNER.replace("integer", "real") + "3 2 1\n3 2 0.25\n", barcodes="c1\nc2\nc3\n")
    assert [tuple(r) for r in batches.read_matrix_market(spark, *files).collect()] == [("c3", "B", 0.25)]


@pytest.mark.parametrize(
    "text, message",
    [
        ("2 2 1\n1 1 1\n", "no file has"),
        (BANNER.replace("general", "symmetric") + "2 2 1\n1 1 1\n", "only general"),
        (BANNER.replace("coordinate", "array") + "2 2\n", "only general"),
        (BANNER + "2 2\n1 1 1\n", "size line"),
        (BANNER, "size line"),
        (BANNER + "2 5 1\n1 1 1\n", "does not fit"),
        (BANNER + "2 2 3\n1 1 1\n", "1 entries where 3"),
    ],
)
def test_faulty_files_raise(spark, matrix, text, message):
    with pytest.raises(ValueError, match=message):
        batches.read_matrix_market(spark, *matrix(text, barcodes="c1\nc2\n"))


def test_an_index_outside_the_shape_fails_the_job(spark, matrix):
    with pytest.raises(PySparkException, match="outside the matrix"):
        batches.read_matrix_market(spark, *matrix(BANNER + "2 2 1\n3 1 1\n", barcodes="c1\nc2\n")).collect()


def test_hardest_baseline_falls_back(spark):
    from deltascreen.operators import meta
    from deltascreen.plans import catalogue

    default, candidates = catalogue.DEFAULT_BASELINE, catalogue.CANDIDATE_BASELINES
    first, second = candidates["UnseenPair"][:2]
    rows = [("UnseenPair", p, "b", k, "pearson_weighted", v) for p, k, v in [(first, "x", 0.1), (second, "x", 0.2), (first, "y", 0.9), (second, "y", 0.3)]]
    rows += [("UnseenPert", default["UnseenPert"], "b", "x", "mse", 0.5), ("UnseenCell", "Zero", "b", "x", "pearson_weighted", 0.5)]
    other = next(c for c in candidates["UnseenBoth"] if c != default["UnseenBoth"]) if len(candidates["UnseenBoth"]) > 1 else None
    rows += [("UnseenBoth", other, "b", "x", "mse", 0.5)] if other else []
    scores = spark.createDataFrame([(s, 0, *r) for s, *r in rows], "scenario string, fold int, predictor string, bin string, ko string, metric string, value double")
    table = catalogue.metric_table(spark)
    winner = lambda keys: {r.scenario: (r.predictor, r.avg_rank) for r in meta.hardest_baseline(scores, table, keys).where("is_hardest").collect()}
    want = {"UnseenPert": (default["UnseenPert"], None), "UnseenCell": (default["UnseenCell"], None)} | ({"UnseenBoth": (other, None)} if other else {})
    assert winner(None) == want | {"UnseenPair": (first, 1.0)}
    only = spark.createDataFrame([("b", "x")], "bin string, ko string")
    assert winner(only) == want | {"UnseenPair": (second, 1.0)}
    nothing = default["UnseenPair"] if default["UnseenPair"] in (first, second) else first
    assert winner(only.where("false")) == want | {"UnseenPair": (nothing, None)}
