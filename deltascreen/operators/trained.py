"""Trained state: coefficient tables that are fitted once, stored in versions, checked and restored.

A fit gives rows ``(scenario, fold, part, bin, ko, gene, i, j, weight)``; which of the keys a part uses is
its own business. ``persist`` writes the rows of a version, then a manifest with the fingerprints of what
they were fitted on and the rows of every part. Only the manifest makes a version visible, so a job that
is lost half way leaves nothing behind. ``reasons`` compares the newest entry of every fold with the
current tables; ``restore`` reads what is reusable and refuses the rest.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deltascreen.operators import predictors
from deltascreen.operators.predictors import FOLD, STATE, Screen, as_state
from deltascreen.operators.scale import cut
from deltascreen.sources import store

KEY = ["predictor", *FOLD]
MARKS = ["seed", "axis", "split", "recipe"]
#: Scenario and fold of the parts that all folds of a predictor share.
SHARED = ("*", -1)


class UntrainedError(RuntimeError):
    """A prediction was asked for whose coefficients are missing or belong to other tables."""


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def fit_all(names: list[str], s: Screen) -> DataFrame:
    """State rows of several predictors on the scenarios they serve.

    Every fold with training pairs also has a row ``fitted`` with their number, so that a fold whose
    coefficients are all absent (and count as zero) is told from one that was never fitted.
    """

    def fit(name: str) -> DataFrame:
        own = predictors.scoped(name, s)
        seen = own.train.groupBy(*FOLD).agg(F.count(F.lit(1)).alias("n"))
        return predictors.REGISTRY[name].fit(own).unionByName(as_state(seen, "fitted", weight="n")).withColumn("predictor", F.lit(name))

    return _union([fit(n) for n in names])


def apply_all(names: list[str], s: Screen, state: DataFrame) -> DataFrame:
    """Predictions of several predictors from their state alone (the training pairs are not read)."""
    out = []
    for n in names:
        mine = state.where(F.col("predictor") == n).drop("predictor")
        out.append(predictors.REGISTRY[n].predict(predictors.scoped(n, s), mine).withColumn("predictor", F.lit(n)))
    return _union(out)


# ---- what a state belongs to --------------------------------------------------------------
def fingerprints(names: list[str], s: Screen, seed: int) -> DataFrame:
    """One row for each fold that a predictor serves, with what its state depends on."""
    spark = s.split.sparkSession
    rows = [
        (n, scenario, store.parameter_digest({"predictor": n, "version": store.VERSION, "parameters": predictors.REGISTRY[n].parameters(s.options)}))
        for n in names for scenario in predictors.REGISTRY[n].scenarios
    ]
    served = spark.createDataFrame(rows, "predictor string, scenario string, recipe string")
    axis = store.axis_fingerprint(s.genes).select("digest").scalar()
    split = store.split_fingerprint(s.split).select(*FOLD, F.concat_ws("-", "digest", "check_sum", "n").alias("split"))
    return split.join(served, "scenario").select(*KEY, F.lit(seed).cast("long").alias("seed"), axis.alias("axis"), "split", "recipe")


def _counts(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys, "part").agg(F.count(F.lit(1)).alias("n"))


def _parts(counts: DataFrame, keys: list[str]) -> DataFrame:
    """``parts``: rows of every part of a fold, those that all folds of the predictor share included."""
    shared = F.col("scenario") == SHARED[0]
    same = [k for k in keys if k not in FOLD]
    own = counts.where(~shared).groupBy(*keys).agg(F.collect_list(F.struct("part", "n")).alias("own"))
    common = counts.where(shared).groupBy(*same).agg(F.collect_list(F.struct("part", "n")).alias("common"))
    every = F.concat("own", F.coalesce("common", F.array().cast("array<struct<part:string,n:bigint>>")))
    return own.join(common, same, "left").select(*keys, F.map_from_entries(every).alias("parts"))


# ---- store --------------------------------------------------------------------------------
def _manifest(spark, root: str) -> DataFrame | None:
    found = store.read_if_written(spark, f"{root}/manifest")
    return None if found is None else found.withColumn("version", F.col("version").cast("int"))


def persist(names: list[str], s: Screen, root: str, seed: int) -> int:
    """Fit and store the state of ``names`` for every fold of ``s.split``; returns the version (one writer at a time).

    Folds without training pairs are not entered, so that they stay untrained.
    """
    spark = s.split.sparkSession
    before = _manifest(spark, root)
    last = before.agg(F.max("version")).first()[0] if before is not None else None
    version = 0 if last is None else last + 1
    path = f"{root}/coefficients/version={version}"
    fit_all(names, s).hint("rebalance", *KEY).write.mode("overwrite").partitionBy(*KEY).parquet(path)
    written = spark.read.parquet(path).withColumn("fold", F.col("fold").cast("int"))
    parts = _parts(_counts(written, KEY), KEY)
    fingerprints(names, s, seed).join(parts, KEY).write.mode("overwrite").parquet(f"{root}/manifest/version={version}")
    return version


def reasons(names: list[str], s: Screen, root: str, seed: int) -> DataFrame:
    """``(predictor, scenario, fold, version, reason)``: why a fold's newest state can't be used; null where it can.

    In this order: missing, seed, axis, split or recipe changed, artefact missing (a part is gone or has
    another number of rows than when it was written).
    """
    now = fingerprints(names, s, seed)
    manifest = _manifest(s.split.sparkSession, root)
    if manifest is None:
        return now.select(*KEY, F.lit(None).cast("int").alias("version"), F.lit("missing").alias("reason"))
    newest = manifest.groupBy(*KEY).agg(F.max_by(F.struct("version", *MARKS, "parts"), "version").alias("was"))
    stored = store.read_if_written(s.split.sparkSession, f"{root}/coefficients")
    have = _parts(_counts(_typed(stored), ["version", *KEY]), ["version", *KEY]) if stored is not None else None
    found = now.join(newest, KEY, "left").withColumn("version", F.col("was.version"))
    if have is None:
        found = found.withColumn("have", F.lit(None).cast("map<string,bigint>"))
    else:
        found = found.join(have.withColumnRenamed("parts", "have"), ["version", *KEY], "left")
    reason = F.when(F.col("was").isNull(), "missing")
    for mark in MARKS:
        reason = reason.when(F.col(f"was.{mark}") != F.col(mark), f"{mark} changed")
    lost = F.array_sort(F.map_keys(F.map_filter("was.parts", lambda part, n: ~F.coalesce(F.try_element_at("have", part), F.lit(0)).eqNullSafe(n))))
    reason = reason.when(F.size(lost) > 0, F.concat(F.lit("artefact missing: "), F.array_join(lost, ", ")))
    return found.select(*KEY, "version", reason.alias("reason"))


def _typed(stored: DataFrame) -> DataFrame:
    return stored.withColumns({"version": F.col("version").cast("int"), "fold": F.col("fold").cast("int")})


def restore(names: list[str], s: Screen, root: str, seed: int, strict: bool = True) -> DataFrame:
    """The reusable state of ``names`` for the folds of ``s.split``.

    ``strict`` raises ``UntrainedError`` when any fold has none that is reusable; else such folds are left out.
    """
    why = cut(reasons(names, s, root, seed), "state-reasons")
    unusable = why.where(F.col("reason").isNotNull()).orderBy(*KEY).limit(5).collect()
    if strict and unusable:
        raise UntrainedError("; ".join(f"{r.predictor} {r.scenario} {r.fold}: {r.reason}" for r in unusable))
    stored = store.read_if_written(s.split.sparkSession, f"{root}/coefficients")
    if stored is None:
        return s.split.sparkSession.createDataFrame([], f"predictor string, {predictors.STATE_SCHEMA}")
    usable = why.where(F.col("reason").isNull())
    own = usable.select("version", *KEY)
    shared = usable.select("version", "predictor", F.lit(SHARED[0]).alias("scenario"), F.lit(SHARED[1]).alias("fold")).distinct()
    return _typed(stored).join(own.unionByName(shared), ["version", *KEY], "left_semi").select("predictor", *STATE)
