"""Trained state: restored predictions equal fresh ones, and state of other tables is refused."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from deltascreen.operators import predictors, trained
from deltascreen.operators.scale import fresh_path
from deltascreen.plans.queries_predict import screen
from deltascreen.sources.testbed import open_testbed

LEARNED = ["TargetScaling", "Mean+TargetScaling", "Ridge", "LinearAdditive", "Correlation", "GlobalEpistasis", "BilinearRidge", "LatentAdditive"]


@pytest.fixture(scope="module")
def tables(spark):
    return screen(open_testbed(spark, "/root/testdata/sf0.001"))


def values(df):
    return {tuple(r[c] for c in ("predictor", *predictors.KEYS)): r.delta for r in df.collect()}


def test_every_learned_predictor_is_restored(spark, tables):
    assert set(LEARNED) == {n for n, p in predictors.REGISTRY.items() if p.needs_training}
    root = fresh_path(spark, "all-trained")
    some = F.col("scenario").isin("UnseenPert", "UnseenCombo") & (F.col("fold") == 0)
    s = replace(tables, split=tables.split.where(some), rect_table=tables.rect.where(some))
    trained.persist(LEARNED, s, root, 42)
    state = trained.restore(LEARNED, s, root, 42)
    blind = replace(s, split=s.split.where("label = 'test'"))
    restored, fresh = values(trained.apply_all(LEARNED, blind, state)), values(predictors.run_all(LEARNED, s))
    assert fresh and restored.keys() == fresh.keys() and {k[0] for k in fresh} == set(LEARNED)
    gaps = {n: max(abs(restored[k] - v) for k, v in fresh.items() if k[0] == n) for n in LEARNED}
    assert max(gaps.values()) < 1e-6, gaps


def test_untrained_folds_are_refused(spark, tables):
    root, name = fresh_path(spark, "refused"), ["TargetScaling"]
    with pytest.raises(trained.UntrainedError, match="missing"):
        trained.restore(name, tables, root, 42)
    assert trained.restore(name, tables, root, 42, strict=False).count() == 0
    trained.persist(name, replace(tables, split=tables.split.where("fold <> 1")), root, 42)
    with pytest.raises(trained.UntrainedError, match="1: missing"):
        trained.restore(name, tables, root, 42)
    state = trained.restore(name, tables, root, 42, strict=False)
    assert {r.fold for r in state.select("fold").distinct().collect()} == {r.fold for r in tables.split.select("fold").distinct().collect()} - {1}
    with pytest.raises(trained.UntrainedError, match="seed changed"):
        trained.restore(name, replace(tables, split=tables.split.where("fold <> 1")), root, 43)


def test_newest_version_counts_and_others_stay(spark, tables):
    root, name = fresh_path(spark, "versions"), ["GlobalEpistasis"]
    first = trained.persist(name, tables, root, 42)
    again = trained.persist(name, replace(tables, options={"epistasis_lam": 5.0}, split=tables.split.where("fold = 0")), root, 42)
    assert (first, again) == (0, 1)
    got = {(r.fold, r.version, r.reason) for r in trained.reasons(name, tables, root, 42).collect()}
    assert (0, 1, "recipe changed") in got and {g[1:] for g in got if g[0] != 0} == {(0, None)}
    five = replace(tables, options={"epistasis_lam": 5.0}, split=tables.split.where("fold = 0"))
    assert trained.restore(name, five, root, 42).where("part = 'fitted'").count() == 1


def test_a_version_without_manifest_is_invisible(spark, tables):
    root, name = fresh_path(spark, "half-written"), ["TargetScaling"]
    rows = trained.fit_all(name, tables)
    rows.write.partitionBy(*trained.KEY).parquet(f"{root}/coefficients/version=0")
    assert {r.reason for r in trained.reasons(name, tables, root, 42).collect()} == {"missing"}
    assert trained.persist(name, tables, root, 42) == 0
    assert {r.reason for r in trained.reasons(name, tables, root, 42).collect()} == {None}
    assert trained.restore(name, tables, root, 42).count() == rows.count()


def test_lost_shared_part_makes_every_fold_unusable(spark, tables):
    root, name = fresh_path(spark, "shared"), ["Correlation"]
    trained.persist(name, tables, root, 42)
    kept = spark.read.parquet(f"{root}/coefficients/version=0").where(F.col("part") != "profile")
    other = fresh_path(spark, "copied")
    kept.write.partitionBy(*trained.KEY).parquet(f"{other}/coefficients/version=0")
    spark.read.parquet(f"{root}/manifest/version=0").write.parquet(f"{other}/manifest/version=0")
    assert {r.reason for r in trained.reasons(name, tables, other, 42).collect()} == {"artefact missing: profile"}
