"""Scores normalised between a negative and a positive control, filters, summaries, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from deltascreen.functions import labels
from deltascreen.plans import catalogue
from deltascreen.plans.catalogue import GLOBAL

KEYS = ["scenario", "fold", "bin", "ko", "metric"]


def dataset_key(*tables: DataFrame) -> list[str]:
    """``dataset`` where every table has it: bins and labels of one dataset say nothing about another."""
    return ["dataset"] if all("dataset" in t.columns for t in tables) else []


def signed(higher: Column, a: Column, b: Column) -> Column:
    """a - b, mirrored where lower values are better."""
    return F.when(higher, a - b).otherwise(b - a)


def drf(pos: Column, neg: Column, higher: Column, perfect: Column) -> Column:
    """Share of the distance to perfection that the positive control covers."""
    return signed(higher, pos, neg) / (signed(higher, perfect, neg) + F.lit(1e-6))


def with_controls(
    scores: DataFrame, metric_table: DataFrame, baselines: DataFrame | None = None,
    negative: str = catalogue.NEGATIVE_CONTROL, positive: str = catalogue.POSITIVE_CONTROL,
) -> DataFrame:
    """Every score row with the negative, positive and baseline score of its key.

    ``baselines([dataset,] scenario, baseline_predictor)`` names the baseline (the scenario default
    otherwise). One window on the key replaces a join per control; rows whose key lacks a control
    drop out, as in an inner join.
    """
    if baselines is None:
        pairs = [F.lit(x) for kv in catalogue.DEFAULT_BASELINE.items() for x in kv]
        named = scores.withColumn("baseline_predictor", F.create_map(*pairs)[F.col("scenario")])
    else:
        named = scores.join(baselines, [*dataset_key(scores, baselines), "scenario"])
    key = W.partitionBy(*dataset_key(scores), *KEYS)
    at = lambda cond: F.max(F.when(cond, F.col("value"))).over(key)
    neg = F.col("predictor") == negative
    return (
        named.withColumns({
            "m_neg": at(neg),
            "n_neg": F.max(F.when(neg, F.col("n_genes_valid"))).over(key),
            "m_pos": at(F.col("predictor") == positive),
            "m_base": at(F.col("predictor") == F.col("baseline_predictor")),
        })
        .where("m_neg IS NOT NULL AND m_pos IS NOT NULL AND m_base IS NOT NULL")
        .join(metric_table.select("metric", "higher_is_better", "perfect"), "metric")
    )


def saturation(higher: Column, base: Column, neg: Column, pos: Column) -> Column:
    return signed(higher, base, neg) / (signed(higher, pos, neg) + F.lit(1e-8))


def captured(higher: Column, pred: Column, base: Column, neg: Column, pos: Column) -> Column:
    bottom = signed(higher, pos, neg)
    return F.when(F.abs(bottom) >= 1e-12, signed(higher, pred, base) / bottom)


def captured_fraction(scores: DataFrame, metric_table: DataFrame, baselines: DataFrame | None = None) -> DataFrame:
    """Per row: saturation of the baseline, captured fraction of the predictor, dynamic range."""
    h, base, neg, pos = (F.col(c) for c in ("higher_is_better", "m_base", "m_neg", "m_pos"))
    return with_controls(scores, metric_table, baselines).withColumnRenamed("value", "m_pred").withColumns({
        "bs": saturation(h, base, neg, pos),
        "cf": captured(h, F.col("m_pred"), base, neg, pos),
        "drf": drf(pos, neg, h, F.col("perfect")),
    })


def baseline_saturation(scores: DataFrame, metric_table: DataFrame, baselines: DataFrame | None = None) -> DataFrame:
    """One row per key: where the baseline lands between the controls."""
    full = captured_fraction(scores, metric_table, baselines)
    return full.where(F.col("predictor") == F.col("baseline_predictor")).drop("predictor", "m_pred", "cf")


# ---- filters -----------------------------------------------------------------------------
def filter_drf(df: DataFrame, threshold: float = 0.2) -> DataFrame:
    return df.where(F.col("drf") > threshold)


def filter_pos_ge_neg(df: DataFrame) -> DataFrame:
    return df.where(signed(F.col("higher_is_better"), F.col("m_pos"), F.col("m_neg")) >= 0)


def filter_min_genes(df: DataFrame, n: int = 10, column: str = "n_genes_valid") -> DataFrame:
    return df.where(F.col(column) >= n)


def explode_cutoffs(cutoffs: DataFrame) -> DataFrame:
    """``bins: map<bin, struct<snr, edist, pearson>>`` -> one row per bin."""
    return cutoffs.select(F.explode("bins").alias("bin", "c")).select("bin", "c.*")


def pass_keys(signal: DataFrame, kind: str, cutoffs: DataFrame | None = None, alpha: float = 0.05,
              threshold: float | None = None) -> DataFrame:
    """(bin, canonical label) keys that pass a signal filter."""
    rows = signal.withColumn("ko", labels.combo_key(F.col("ko")))
    if kind == "etest":
        return rows.where(F.col("e_test_p") < alpha).select("bin", "ko").distinct()
    columns = {"snr": ("snr", "snr"), "rho": ("rho", "pearson"), "edist": ("e_distance", "edist")}
    if kind == "nsr_or_rho":
        return pass_keys(signal, "snr", cutoffs).union(pass_keys(signal, "rho", cutoffs)).distinct()
    if kind not in columns:
        raise ValueError(f"unknown filter {kind!r}")
    value, cut = columns[kind]
    finite = F.col(value).isNotNull() & ~F.isnan(value)
    if threshold is not None and kind != "edist":
        return rows.where(finite & (F.col(value) > threshold)).select("bin", "ko").distinct()
    limits = cutoffs.select("bin", F.col(cut).alias("limit"))
    return rows.join(limits, "bin").where(finite & (F.col(value) > F.col("limit"))).select("bin", "ko").distinct()


def restrict_by_keys(df: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows whose (bin, canonical label) is a key."""
    named = df.withColumn("__ko", labels.combo_key(F.col("ko")))
    return named.join(keys.select("bin", F.col("ko").alias("__ko")), ["bin", "__ko"], "left_semi").drop("__ko")


# ---- baselines ---------------------------------------------------------------------------
def candidate_table(spark) -> DataFrame:
    rows = [(s, c, i) for s, cands in catalogue.CANDIDATE_BASELINES.items() for i, c in enumerate(cands)]
    return spark.createDataFrame(rows, "scenario string, predictor string, place int")


def hardest_baseline(scores: DataFrame, metric_table: DataFrame, keys: DataFrame | None = None,
                     metrics: list[str] = catalogue.HARDEST_METRICS) -> DataFrame:
    """Average rank of every candidate over the ranking metrics, best first; ``is_hardest`` marks
    the winner of its scenario (and dataset).

    ``keys(bin, ko)`` are the labels that rank (all, when absent). A scenario in which nothing can be ranked
    has one row without a rank: its default baseline, or its first candidate that is scored when the default is not.
    """
    own = [*dataset_key(scores), "scenario"]
    real = scores.where(F.col("ko") != GLOBAL)
    kept = real.where(F.col("metric").isin(metrics))
    if keys is not None:
        kept = restrict_by_keys(kept, keys)
    med = (
        kept.join(candidate_table(scores.sparkSession), ["scenario", "predictor"])
        .groupBy(*own, "metric", "predictor", "place").agg(F.median("value").alias("m"))
        .join(metric_table.select("metric", "higher_is_better"), "metric")
        .withColumn("m", F.round("m", 9))
    )
    best = W.partitionBy(*own, "metric").orderBy(
        F.when(F.col("higher_is_better"), -F.col("m")).otherwise(F.col("m")), "place")
    avg = (
        med.withColumn("r", F.row_number().over(best))
        .groupBy(*own, "predictor", "place").agg(F.avg("r").alias("avg_rank"))
    )
    first = W.partitionBy(*own).orderBy("avg_rank", "place")
    ranked = avg.withColumn("is_hardest", F.row_number().over(first) == 1).drop("place")
    default = F.create_map(*[F.lit(x) for kv in catalogue.DEFAULT_BASELINE.items() for x in kv])[F.col("scenario")]
    rest = scores.select(*own, "predictor").distinct().join(ranked.select(*own).distinct(), own, "left_anti")
    scored = real.select(*own, "predictor").distinct().join(candidate_table(scores.sparkSession), ["scenario", "predictor"])
    fallback = (
        rest.select(*own).distinct().join(
            scored.groupBy(*own).agg(F.min_by("predictor", "place").alias("first"), F.collect_set("predictor").alias("names")), own, "left")
        .withColumn("default", default)
        .select(*own, F.when(F.array_contains("names", F.col("default")) | F.col("first").isNull(), F.col("default"))
                .otherwise(F.col("first")).alias("predictor"))
    )
    return ranked.unionByName(
        fallback.select(*own, "predictor", F.lit(None).cast("double").alias("avg_rank"), F.lit(True).alias("is_hardest")))


# ---- summaries ---------------------------------------------------------------------------
def summarise(df: DataFrame, value: str, groups: list[str], clean: bool = True, drf_threshold: float = 0.2,
              medians: list[str] | None = None) -> DataFrame:
    """n, mean, median and deviation per group: one row per bin (with more than one bin, empty
    ones included) and a ``combined`` row."""
    real = df.where((F.col("bin") != GLOBAL) & (F.col("ko") != GLOBAL))
    bins = real.where("bin IS NOT NULL").agg(F.array_sort(F.collect_set("bin"))).scalar()
    work = filter_drf(filter_pos_ge_neg(real), drf_threshold) if clean else real
    v = F.col(value).cast("double")
    sides = [F.median(c).cast("double").alias(c) for c in medians or []]
    stats = (
        work.groupingSets([[*groups, "bin"], groups], *groups, "bin")
        .agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.median(v).alias("median"),
             F.stddev_samp(v).alias("std"), F.grouping("bin").alias("__all"), *sides)
        .withColumn("view", F.when(F.col("__all") == 1, "combined").otherwise(F.col("bin")))
        .drop("bin", "__all")
    )
    views = F.when(F.size(bins) > 1, F.concat(bins, F.array(F.lit("combined")))).otherwise(
        F.array(F.lit("combined")))
    wanted = work.select(*groups).distinct().withColumn("view", F.explode(views))
    same = [wanted[g].eqNullSafe(stats[g]) for g in groups] + [wanted["view"] == stats["view"]]
    return wanted.join(stats, same, "left").select(
        *[wanted[g] for g in groups], wanted["view"], F.coalesce("n", F.lit(0)).alias("n"),
        "mean", "median", "std", *(medians or []),
    )


def overlap(scores: DataFrame, within: list[str]) -> DataFrame:
    """(bin, ko) covered by every predictor of the group."""
    real = scores.where((F.col("ko") != GLOBAL) & (F.col("bin") != GLOBAL))
    n_all = real.groupBy(*within).agg(F.count_distinct("predictor").alias("n_all"))
    mine = real.groupBy(*within, "bin", "ko").agg(F.count_distinct("predictor").alias("n"))
    return mine.join(n_all, within).where("n = n_all").select(*within, "bin", "ko")


def on_overlap(table: DataFrame, shared: DataFrame) -> DataFrame:
    return table.join(shared, [*dataset_key(table, shared), "scenario", "bin", "ko"], "left_semi")


def metric_distributions(fill: DataFrame, drop: DataFrame) -> DataFrame:
    """Distribution per (scenario, predictor, metric) x missing-feature mode x (full, overlapping)."""
    own = [*dataset_key(fill, drop), "scenario"]
    shared = overlap(fill, own)
    both = fill.withColumn("missing_genes", F.lit("fill")).unionByName(
        drop.withColumn("missing_genes", F.lit("drop")))
    every = both.withColumn("pert_set", F.lit("full")).unionByName(
        on_overlap(both, shared).withColumn("pert_set", F.lit("overlapping")))
    return summarise(
        every, "value", [*own, "predictor", "metric", "missing_genes", "pert_set"], clean=False,
        medians=["n_genes_valid", "n_genes_native"],
    ).withColumnsRenamed({"n": "n_perturbations", "n_genes_valid": "n_genes"})


# ---- coverage ----------------------------------------------------------------------------
def handles(kos: DataFrame, genes: DataFrame, predictors: DataFrame) -> DataFrame:
    """Forecast per (predictor, label): can it be predicted, and if not, why.

    ``predictors(predictor)``; the label facts are computed once, the rule is one expression.
    """
    panel = genes.select("gene", F.lit(True).alias("known"))
    tokens = kos.select("ko", F.explode_outer(labels.target_tokens(F.col("ko"))).alias("gene"))
    found = tokens.join(panel, "gene", "left").groupBy("ko").agg(
        F.count("gene").alias("n_targets"), F.count_if("known").alias("n_known"))
    parts = kos.select("ko", F.explode(F.split("ko", r"\+")).alias("part"))
    have = kos.select(F.col("ko").alias("part"), F.lit(True).alias("present"))
    comp = parts.join(have, "part", "left").groupBy("ko").agg(
        F.count(F.lit(1)).alias("n_parts"), F.count_if("present").alias("n_present"))
    dose = kos.select("ko", F.trim(F.substring_index("ko", "@", 1)).alias("part")).join(
        have, "part", "left").select("ko", F.coalesce("present", F.lit(False)).alias("base_present"))
    facts = found.join(comp, "ko").join(dose, "ko")
    p = F.col("predictor")
    some, every = F.col("n_known") > 0, F.col("n_known") == F.col("n_targets")
    missing = F.lit("target_not_in_panel")
    reason = (
        F.when(p == "BilinearRidge",
               F.when(F.col("n_targets") > 1, "single_gene_only").when(~every, missing))
        .when(p == "LatentAdditive", F.when(~(every & some), missing))
        .when(p.isin("TargetScaling", "TargetZero"), F.when(~some, missing))
        .when(p.isin("Additive", "Matching-mean", "GlobalEpistasis"),
              F.when(F.col("n_parts") != 2, "combo_arity")
              .when(F.col("n_present") < 2, "combo_component_missing"))
        .when(p == "Scaled-delta",
              F.when(~F.col("ko").contains("@"), "combo_arity")
              .when(~F.col("base_present"), "combo_component_missing"))
    )
    names = predictors.agg(F.array_sort(F.collect_set("predictor"))).scalar()
    return facts.withColumn("predictor", F.explode(names)).select(
        "predictor", "ko", reason.isNull().alias("ok"), reason.alias("reason"))


def coverage(scores: DataFrame, forecast: DataFrame) -> DataFrame:
    """Per scored (scenario, bin, ko): fold, overlap, who handled it, and why the others did not."""
    real = scores.where((F.col("ko") != GLOBAL) & (F.col("bin") != GLOBAL))
    own = [*dataset_key(scores), "scenario"]
    pair = [*own, "bin", "ko"]
    done = real.groupBy(*pair).agg(
        F.min("fold").alias("fold"), F.array_sort(F.collect_set("predictor")).alias("handled_by"))
    everyone = real.groupBy(*own).agg(F.array_sort(F.collect_set("predictor")).alias("predictors"))
    rows = done.join(everyone, own)
    absent = rows.select(
        *pair, F.explode(F.array_except("predictors", "handled_by")).alias("predictor"))
    why = absent.join(forecast.where("NOT ok"), [*dataset_key(absent, forecast), "predictor", "ko"], "left").select(
        *pair, "predictor", F.coalesce("reason", F.lit("no_valid_prediction")).alias("reason"))
    told = F.create_map(*[F.lit(x) for kv in catalogue.REASONS.items() for x in kv])
    explained = F.struct("reason", told[F.col("reason")].alias("explanation"))
    reasons = why.groupBy(*pair).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("predictor", explained)))).alias("not_handled_by"))
    return rows.join(reasons, pair, "left").select(
        *pair, "fold", "handled_by", "not_handled_by",
        (F.size("handled_by") == F.size("predictors")).alias("in_overlap"))


def coverage_summary(scores: DataFrame) -> DataFrame:
    """Handled and unhandled pairs per predictor, and the share."""
    real = scores.where((F.col("ko") != GLOBAL) & (F.col("bin") != GLOBAL))
    own = [*dataset_key(scores), "scenario"]
    total = real.select(*own, "bin", "ko").distinct().groupBy(*own).agg(F.count(F.lit(1)).alias("total"))
    mine = real.select(*own, "predictor", "bin", "ko").distinct().groupBy(*own, "predictor").agg(
        F.count(F.lit(1)).alias("handled"))
    return mine.join(total, own).select(
        *own, "predictor", "handled", (F.col("total") - F.col("handled")).alias("not_handled"),
        F.round(F.col("handled") / F.col("total"), 4).alias("frac"))


def coverage_json(report: DataFrame) -> DataFrame:
    """One JSON document per pair."""
    return report.select(*dataset_key(report), "scenario", F.to_json(F.struct(*report.columns)).alias("json"))
