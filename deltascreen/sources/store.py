"""Stored tables: predictions, metrics, audits, stamped stages and fingerprints."""

from __future__ import annotations

import hashlib
import json
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Raised when a stage's meaning changes, so that stages written before are not read.
VERSION = 3
PARTITIONS = ["dataset", "scenario", "fold", "predictor"]
KEYS = [*PARTITIONS, "bin", "ko", "gene"]


def read_if_written(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at ``path``, or None where nothing was committed (any file system Spark knows)."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


# ---- keyed sinks -------------------------------------------------------------------------
def upsert(df: DataFrame, path: str) -> None:
    """Replace the partitions present in ``df`` and keep all others."""
    (
        df.hint("rebalance", *PARTITIONS)  # large folds are split by size, small ones share a task
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy(*PARTITIONS).parquet(path)
    )


def upsert_scores(scores: DataFrame, path: str, roster: DataFrame, recomputed: DataFrame | None = None) -> None:
    """Metric rows of recomputed predictors; pairs outside the roster are not written.

    ``recomputed(dataset, scenario, fold, predictor)`` lists what was computed: a partition of it
    without rows is replaced by an empty mark, so that its old rows are gone.
    """
    valid = roster.select("scenario", "predictor").distinct()
    rows = scores.join(valid, ["scenario", "predictor"], "left_semi")
    if recomputed is not None:
        gone = recomputed.select(*PARTITIONS).distinct().join(rows.select(*PARTITIONS).distinct(), PARTITIONS, "left_anti")
        rows = rows.unionByName(gone, allowMissingColumns=True)
    upsert(rows, path)


def read_scores(spark: SparkSession, path: str, roster: DataFrame) -> DataFrame:
    """Stored metric rows of pairs that the roster has now; rows written before it changed are left out."""
    valid = roster.select("scenario", "predictor").distinct()
    rows = read_partitioned(spark, path).where(F.col("metric").isNotNull())
    return rows.join(valid, ["scenario", "predictor"], "left_semi")


def read_partitioned(spark: SparkSession, path: str) -> DataFrame:
    """All folds and predictors; partition columns come from the folder names."""
    df = spark.read.parquet(path)
    return df.withColumn("fold", F.col("fold").cast("int")).withColumn(
        "predictor", F.col("predictor").cast("string"))


def merge_scores(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Row-level form of the upsert: stored rows of other predictors, plus the fresh ones."""
    redone = fresh.select("dataset", "scenario", "fold", "predictor").distinct()
    return stored.join(redone, PARTITIONS, "left_anti").unionByName(fresh)


def pool_folds(parts: list[tuple[int, DataFrame]]) -> DataFrame:
    """One table from per-fold tables; a missing ``fold`` column is added."""
    named = [
        df if "fold" in df.columns else df.withColumn("fold", F.lit(fold).cast("int")) for fold, df in parts
    ]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), named)


def discover_csv(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """``{root}/{dataset}/{scenario}/pooled`` folders as one frame with both names as columns."""
    df = spark.read.schema(schema).option("header", True).csv(f"{root}/*/*/pooled")
    path = F.col("_metadata.file_path")
    part = lambda i: F.element_at(F.split(F.regexp_extract(path, r"^(.*)/pooled/", 1), "/"), i)
    return df.select(F.url_decode(part(-2)).alias("dataset"), F.url_decode(part(-1)).alias("scenario"), "*")


# ---- predictions -------------------------------------------------------------------------
def checked_predictions(predictions: DataFrame, bins: DataFrame, kos: DataFrame, genes: DataFrame) -> DataFrame:
    """Only known names, and no key twice (the job fails otherwise)."""
    known = (
        predictions.join(bins.select("bin", F.lit(True).alias("kb")).distinct(), "bin", "left")
        .join(kos.select("ko", F.lit(True).alias("kk")).distinct(), "ko", "left")
        .join(genes.select("gene", F.lit(True).alias("kg")), "gene", "left")
    )
    once = known.groupBy(*KEYS).agg(
        F.first("delta").alias("delta"), F.count(F.lit(1)).alias("n"),
        F.bool_and(F.col("kb") & F.col("kk") & F.col("kg")).alias("ok"))
    fail = lambda text: F.raise_error(F.concat_ws(" ", F.lit(text), "bin", "ko", "gene")).cast("double")
    value = (
        F.when(F.col("n") > 1, fail("duplicate key"))
        .when(~F.coalesce("ok", F.lit(False)), fail("unknown name"))
        .otherwise(F.col("delta"))
    )
    return once.select(*KEYS, value.alias("delta"))


def save_predictions(predictions: DataFrame, path: str) -> None:
    upsert(predictions, path)


def load_predictions(
    spark: SparkSession, path: str, genes: DataFrame, exact: bool = True, exempt: list[str] | None = None,
    dataset: str | None = None,
) -> DataFrame:
    """Stored predictions on the panel, of one dataset if it is named (each has its own panel).

    ``exact`` fails when a stored partition misses a panel feature or has an extra one (predictors in
    ``exempt`` are intersected instead); otherwise the intersection is returned.
    """
    df = read_partitioned(spark, path)
    if dataset is not None:
        df = df.where(F.col("dataset") == dataset)
    known = genes.select("gene", F.lit(True).alias("known"))
    if exact:
        n_panel = genes.agg(F.count(F.lit(1))).scalar()
        seen = df.select(*PARTITIONS, "gene").distinct().join(known, "gene", "left").groupBy(*PARTITIONS).agg(
            F.count("known").alias("n"), F.count_if(F.col("known").isNull()).alias("extra"))
        strict = ~F.col("predictor").isin(exempt or [])
        wrong = strict & ((F.col("n") != n_panel) | (F.col("extra") > 0))
        fail = F.raise_error(F.concat(F.lit("feature axis differs: "), "predictor")).cast("boolean")
        gate = seen.select(*PARTITIONS, F.when(wrong, fail).otherwise(F.lit(True)).alias("aligned"))
        df = df.join(gate, PARTITIONS).where("aligned").drop("aligned")
    return df.join(genes.select("gene"), "gene", "left_semi")


def axis_difference(predictions: DataFrame, genes: DataFrame) -> DataFrame:
    """Missing and extra features per predictor."""
    mine = predictions.select("predictor", "gene").distinct()
    extra = mine.join(genes, "gene", "left_anti").withColumn("side", F.lit("extra"))
    names = mine.agg(F.array_sort(F.collect_set("predictor"))).scalar()
    wanted = genes.select("gene").withColumn("predictor", F.explode(names))
    gone = wanted.join(mine, ["predictor", "gene"], "left_anti").withColumn("side", F.lit("missing"))
    columns = ["predictor", "side", "gene"]
    return extra.select(*columns).unionByName(gone.select(*columns))


# ---- legacy dictionaries -----------------------------------------------------------------
def explode_dictionary(entries: DataFrame) -> DataFrame:
    """``dict: map<key, array<struct<gene, score, p>>>`` -> one row per entry."""
    return (
        entries.select(F.explode("dict").alias("key", "values"))
        .select("key", F.explode("values").alias("v")).select("key", "v.*")
    )


def dictionary_key(dataset: str, bin_col: str = "bin", ko_col: str = "ko", single_bin: bool = False):
    return F.concat_ws("_", F.lit(dataset), *([] if single_bin else [F.col(bin_col)]), F.col(ko_col))


# ---- stamps and fingerprints --------------------------------------------------------------
def parameter_digest(parameters: dict) -> str:
    return hashlib.sha256(json.dumps(parameters, sort_keys=True).encode()).hexdigest()


def content_stamp(df: DataFrame) -> str:
    """Order-free digest of a table's columns and rows, from one aggregate over it."""
    row = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    marks = (F.count(F.lit(1)), F.bit_xor(row), F.sum(F.pmod(row, F.lit(1_000_003))))
    return parameter_digest({"columns": df.dtypes, "rows": [str(x) for x in df.agg(*marks).first()]})


def stamped_stage(
    spark: SparkSession, root: str, name: str, parameters: dict, build, required: list[str], inputs: list[str] | None = None,
) -> DataFrame:
    """Reuse a written stage when its stamp matches and it has the required columns; else rebuild.

    The stamp covers the parameters, the code's version and ``inputs``, the content stamps of what
    the stage is built from.
    """
    key = {"parameters": parameters, "version": VERSION, "inputs": inputs or []}
    path = f"{root}/{name}/stamp={parameter_digest(key)}"
    df = read_if_written(spark, path)
    if df is not None and set(required) <= set(df.columns):
        return df
    built = build()
    built.write.mode("overwrite").parquet(path)
    return spark.read.schema(built.schema).parquet(path)


def axis_fingerprint(genes: DataFrame) -> DataFrame:
    """Digest of the sorted feature names (a bounded axis)."""
    names = F.array_join(F.array_sort(F.collect_list("gene")), ",")
    return genes.agg(F.sha2(names, 256).alias("digest"), F.count(F.lit(1)).alias("n"))


def split_fingerprint(pair_split: DataFrame) -> DataFrame:
    """Order-free digest per fold: no group is gathered, rows are hashed and combined."""
    text = F.concat_ws("|", F.length("bin").cast("string"), F.length("ko").cast("string"), "bin", "ko", "label")
    h = F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")
    return pair_split.select("scenario", "fold", h.alias("h")).groupBy("scenario", "fold").agg(
        F.bit_xor("h").alias("digest"), F.sum(F.col("h") % 1_000_003).alias("check_sum"), F.count(F.lit(1)).alias("n"))
