"""Data-quality and leakage checks. Every check returns rows ``(check, scope, ok, detail)``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from deltascreen.functions import labels
from deltascreen.operators import splits
from deltascreen.operators.scale import cut, scalar

FOLD = ["scenario", "fold"]
REQUIRED = {
    "cells": ["cell_id", "condition", "bin", "half"],
    "expr": ["cell_id", "gene", "x"],
    "genes": ["gene", "gene_ord"],
    "deltas": ["bin", "ko", "gene", "d_all", "d_first", "d_second"],
    "pair_split": ["scenario", "fold", "bin", "ko", "label"],
}
LOG_MAX_STORE, LOG_MAX_MODEL = 50.0, 30.0


def row(df: DataFrame, check: str, ok: Column, detail: Column, scope: Column | None = None) -> DataFrame:
    return df.select(
        F.lit(check).alias("check"), (F.lit("all") if scope is None else scope).alias("scope"),
        F.coalesce(ok, F.lit(False)).alias("ok"), detail.cast("string").alias("detail"),
    )


def fold_scope() -> Column:
    return F.concat_ws("/", "scenario", F.col("fold").cast("string"))


def union(*checks: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)


def structural(spark, tables: dict[str, DataFrame]) -> DataFrame:
    """Required tables and columns (schema only, no scan)."""
    rows = []
    for name, columns in REQUIRED.items():
        have = set(tables[name].columns) if name in tables else set()
        missing = sorted(set(columns) - have)
        rows.append(("structural", name, not missing, ",".join(missing)))
    return spark.createDataFrame(rows, "check string, scope string, ok boolean, detail string")


def counts_layer(counts: DataFrame) -> DataFrame:
    one = counts.agg(
        F.count_if((F.col("cnt") != F.round("cnt")) | (F.col("cnt") < 0)).alias("bad"), F.count(F.lit(1)).alias("n"))
    return row(one, "integral_counts", (F.col("bad") == 0) & (F.col("n") > 0), F.col("bad"))


def batch_column(cells: DataFrame, column: str = "batch") -> DataFrame:
    one = cells.agg(F.count_distinct(column).alias("n"))
    return row(one, "batch_column", F.col("n") > 0, F.col("n"))


def hvg_count(genes: DataFrame, expected: int, slack: int = 200) -> DataFrame:
    one = genes.agg(F.count_if("hvg").alias("n"))
    return row(one, "hvg_count", F.col("n") >= expected - slack, F.col("n"))


def missing_targets(kos: DataFrame, genes: DataFrame) -> DataFrame:
    """Targets that are not on the feature axis, one row each (warnings)."""
    tokens = kos.select(F.explode(labels.target_tokens(F.col("ko"))).alias("gene")).distinct()
    return row(tokens.join(genes.select("gene"), "gene", "left_anti"), "missing_target", F.lit(False),
               F.col("gene"), F.col("gene"))


def missing_singles(kos: DataFrame) -> DataFrame:
    """Components of combinations without a row of their own."""
    parts = kos.where(F.col("ko").contains("+")).select("ko", F.explode(F.split("ko", r"\+")).alias("part"))
    gone = parts.join(kos.select(F.col("ko").alias("part")), "part", "left_anti")
    return row(gone, "missing_single", F.lit(False), F.col("part"), F.col("ko"))


def missing_bases(kos: DataFrame) -> DataFrame:
    """Doses without a full-dose row."""
    doses = kos.where(F.col("ko").contains("@")).select("ko", F.substring_index("ko", "@", 1).alias("base"))
    gone = doses.join(kos.select(F.col("ko").alias("base")), "base", "left_anti")
    return row(gone, "missing_base", F.lit(False), F.col("base"), F.col("ko"))


def grid_complete(table: DataFrame, name: str) -> DataFrame:
    """Row count equals bins x labels x features."""
    one = table.agg(
        F.count(F.lit(1)).alias("n"),
        (F.count_distinct("bin") * F.count_distinct("ko") * F.count_distinct("gene")).alias("want"))
    return row(one, "grid_complete", F.col("n") == F.col("want"),
               F.concat_ws("/", F.col("n").cast("string"), F.col("want").cast("string")), F.lit(name))


def split_labels(pair_split: DataFrame, folds: dict[str, int]) -> DataFrame:
    """Known labels only, and every fold present."""
    known = F.col("label").isin("train", "val", "test", "unassigned")
    per = pair_split.groupBy("scenario").agg(
        F.count_if(~known).alias("bad"), F.count_distinct("fold").alias("n"))
    want = F.create_map(*[F.lit(x) for kv in folds.items() for x in kv])[F.col("scenario")]
    return row(per, "split_labels", (F.col("bad") == 0) & (F.col("n") == want), F.col("n"), F.col("scenario"))


def finite(table: DataFrame, columns: list[str], name: str) -> DataFrame:
    bad = reduce(lambda a, b: a | b, [
        F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf")) for c in columns])
    return row(table.agg(F.count_if(bad).alias("n")), "finite", F.col("n") == 0, F.col("n"), F.lit(name))


def weight_sanity(weights: DataFrame) -> DataFrame:
    """Weights exist, sit on called features, and no called row is without weight."""
    per = weights.groupBy("bin", "ko").agg(
        F.sum("w").alias("w"), F.sum(F.when(~F.col("deg"), F.col("w")).otherwise(0.0)).alias("off"),
        (F.bool_or("deg") & (F.sum("w") <= 0)).alias("starved"))
    one = per.agg(F.sum("w").alias("w"), F.sum("off").alias("off"), F.count_if("starved").alias("starved"))
    return union(
        row(one, "weights_present", F.col("w") > 0, F.round("w", 4)),
        row(one, "weights_on_calls", F.col("off") <= 0.5 * F.col("w"), F.round("off", 4)),
        row(one, "weights_not_starved", F.col("starved") == 0, F.col("starved")),
    )


def audit_sanity(audit: DataFrame, max_share: float = 0.5) -> DataFrame:
    return row(audit, "qc_gate_share", F.col("n_removed") <= max_share * F.col("n_before"),
               F.col("n_removed"), F.col("gate"))


def normalisation_declared(metadata: DataFrame) -> DataFrame:
    """The metadata row with the depth column and the retention exists."""
    one = metadata.agg(F.count_if(F.col("depth_column").isNotNull()).alias("n"))
    return row(one, "normalisation_declared", F.col("n") > 0, F.col("n"))


def half_sizes(cells: DataFrame, kos: DataFrame, min_cells: int = 4) -> DataFrame:
    sizes = (
        cells.join(kos.select(F.col("ko").alias("condition")), "condition", "left_semi")
        .groupBy("bin", "condition", "half").agg(F.count(F.lit(1)).alias("n"))
    )
    return row(sizes.agg(F.min("n").alias("n")), "min_cells_per_half", F.col("n") >= min_cells, F.col("n"))


def log_range(expr: DataFrame, top: float = LOG_MAX_STORE) -> DataFrame:
    one = expr.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    return row(one, "log_range", (F.col("lo") >= 0) & (F.col("hi") < top), F.round("hi", 4))


def same_keys(a: DataFrame, b: DataFrame, keys: list[str], name: str) -> DataFrame:
    both = a.select(*keys).distinct().withColumn("l", F.lit(1)).join(
        b.select(*keys).distinct().withColumn("r", F.lit(1)), keys, "full")
    one = both.agg(F.count_if(F.col("l").isNull() | F.col("r").isNull()).alias("n"))
    return row(one, "same_keys", F.col("n") == 0, F.col("n"), F.lit(name))


def two_halves(cells: DataFrame) -> DataFrame:
    one = cells.agg(F.concat_ws(",", F.array_sort(F.collect_set("half"))).alias("h"))
    return row(one, "two_halves", F.col("h") == "first_half,second_half", F.col("h"))


def pair_leakage(grid: DataFrame) -> DataFrame:
    """``grid(scenario, fold, bin, ko, in_train, in_val, in_test)``: roles do not overlap."""
    per = grid.groupBy(*FOLD).agg(
        F.count_if(F.col("in_train") & F.col("in_test")).alias("tt"),
        F.count_if(F.col("in_train") & F.col("in_val")).alias("tv"))
    return union(
        row(per, "train_test_disjoint", F.col("tt") == 0, F.col("tt"), fold_scope()),
        row(per, "train_val_disjoint", F.col("tv") == 0, F.col("tv"), fold_scope()))


def masks_present(pair_split: DataFrame, masks: DataFrame) -> DataFrame:
    """Scenarios whose training side is no rectangle carry explicit pair masks."""
    need = pair_split.where(F.col("scenario").isin(splits.PAIR_MASK_SCENARIOS)).select(*FOLD).distinct()
    have = masks.select(*FOLD).distinct().withColumn("have", F.lit(True))
    return row(need.join(have, FOLD, "left"), "pair_mask_present", F.col("have"), F.lit(""), fold_scope())


def conventions(pair_split: DataFrame) -> DataFrame:
    """Shape rules per scenario, beyond plain disjointness."""
    n_bins = scalar(pair_split.agg(F.count_distinct("bin")))
    is_test, is_train = F.col("label") == "test", F.col("label") == "train"
    pert = pair_split.where("scenario = 'UnseenPert'")
    consistent = (
        pert.groupBy(*FOLD, "ko").agg(F.count_if(is_test).alias("n"))
        .groupBy(*FOLD).agg(F.count_if((F.col("n") > 0) & (F.col("n") < n_bins)).alias("bad")))
    once = pert.where(is_test).select("fold", "ko").distinct().groupBy("ko").agg(F.count(F.lit(1)).alias("n"))
    covered = once.agg(F.count_if(F.col("n") != 1).alias("bad"), F.count(F.lit(1)).alias("n"))
    n_kos = scalar(pert.agg(F.count_distinct("ko")))
    pair = pair_split.where("scenario = 'UnseenPair' AND label <> 'unassigned'")
    trained = (
        pair.groupBy(*FOLD, "ko").agg(F.bool_or(is_train).alias("t"))
        .groupBy(*FOLD).agg(F.count_if(~F.col("t")).alias("bad")))
    sizes = pair_split.groupBy(*FOLD).agg(F.count_if(is_train).alias("tr"), F.count_if(is_test).alias("te"))
    return union(
        row(consistent, "held_in_every_bin", F.col("bad") == 0, F.col("bad"), fold_scope()),
        row(covered, "tested_exactly_once", (F.col("bad") == 0) & (F.col("n") == n_kos), F.col("n"), F.lit("UnseenPert")),
        row(trained, "trained_in_some_bin", F.col("bad") == 0, F.col("bad"), fold_scope()),
        row(sizes, "no_empty_fold", (F.col("tr") > 0) & (F.col("te") > 0), F.col("te"), fold_scope()),
    )


def nested_blocks(pair_split: DataFrame) -> DataFrame:
    """Single test labels of UnseenPert that UnseenBoth does not hold out in the same fold."""
    test = pair_split.where("label = 'test'")
    singles = test.where("scenario = 'UnseenPert'").where(labels.is_single(F.col("ko"))).select("fold", "ko").distinct()
    both = test.where("scenario = 'UnseenBoth'").select("fold", "ko").distinct()
    gone = singles.join(both, ["fold", "ko"], "left_anti").groupBy("fold").agg(F.count(F.lit(1)).alias("n"))
    folds = singles.select("fold").distinct().join(gone, "fold", "left").fillna(0, ["n"])
    return row(folds, "nested_blocks", F.col("n") == 0, F.col("n"), F.col("fold").cast("string"))


def bulk_identities(bulk: DataFrame, deltas: DataFrame, ctrl: DataFrame, tol: float = 1e-9) -> DataFrame:
    """All-cell mean = weighted halves; delta = mean - control."""
    halves = bulk.groupBy("bin", "ko", "gene").agg(
        (F.sum(F.col("m") * F.col("n_cells")) / F.sum("n_cells")).alias("whole"))
    j = deltas.join(halves, ["bin", "ko", "gene"]).join(ctrl.select("bin", "gene", F.col("m").alias("c")), ["bin", "gene"])
    one = j.agg(F.max(F.abs(F.col("m_all") - F.col("whole"))).alias("a"),
                F.max(F.abs(F.col("d_all") - (F.col("m_all") - F.col("c")))).alias("d"))
    return union(row(one, "weighted_halves", F.col("a") <= tol, F.round("a", 6)),
                 row(one, "delta_of_means", F.col("d") <= tol, F.round("d", 6)))


def zero_completed(cells: DataFrame, expr: DataFrame, genes: DataFrame) -> DataFrame:
    """A row for every cell and feature of the axis, ``x`` being zero where the cell has no entry.

    A cell's entries (at most one a feature) are packed, met by their cell and completed in place, so
    rows that were made up for the zeros are not exchanged.
    """
    known = expr.join(genes.select("gene"), "gene", "left_semi")
    own = F.collect_list(F.struct("gene", F.coalesce("x", F.lit(0.0)).alias("x")))
    packed = known.groupBy("cell_id").agg(own.alias("__own"))
    axis = scalar(genes.agg(F.collect_set("gene")))
    zero = lambda gene: F.struct(gene.alias("gene"), F.lit(0.0).alias("x"))
    absent = F.array_except(axis, F.coalesce(F.col("__own.gene"), F.array().cast("array<string>")))
    zeros = F.transform("__absent", zero)
    every = F.when(F.col("__own").isNull(), zeros).otherwise(F.concat("__own", zeros))
    met = cells.join(packed, "cell_id", "left").withColumn("__absent", absent)
    return met.select(*cells.columns, F.inline(every))


def bulk_agreement(a: DataFrame, b: DataFrame, keys: list[str], tol: float = 1e-9) -> DataFrame:
    """Two routes to the same means agree and cover the same keys."""
    j = a.select(*keys, F.col("m").alias("x")).join(b.select(*keys, F.col("m").alias("y")), keys, "full")
    one = j.agg(F.count_if(F.col("x").isNull() | F.col("y").isNull()).alias("gap"),
                F.max(F.abs(F.col("x") - F.col("y"))).alias("d"))
    return row(one, "bulk_agreement", (F.col("gap") == 0) & (F.col("d") <= tol), F.round("d", 6))


def truth_axis(scores: DataFrame, deltas: DataFrame, rect: DataFrame, tol: float = 1e-3) -> DataFrame:
    """Stored mse of the technical duplicate matches the first half, not all cells or the second
    half."""
    mine = scores.where("predictor = 'Tech-duplicate' AND metric = 'mse'").agg(F.avg("value").alias("v"))
    sq = lambda c: (F.col("d_second") - F.col(c)) * (F.col("d_second") - F.col(c))
    keys = [*FOLD, "bin", "ko"]
    per = rect.join(deltas, ["bin", "ko"]).groupBy(*keys).agg(
        *[F.avg(sq(c)).alias(c) for c in ("d_first", "d_all", "d_second")])
    cand = per.agg(*[F.avg(c).alias(c) for c in ("d_first", "d_all", "d_second")])
    v = scalar(mine)
    gap = lambda c: F.abs(F.col(c) - v)
    best = F.array_min(F.array(*[F.struct(gap(c).alias("g"), F.lit(c).alias("c")) for c in ("d_first", "d_all", "d_second")]))
    return row(cand, "truth_axis", (best["c"] == "d_first") & (gap("d_first") < tol), best["c"])


def full_coverage(scores: DataFrame, dropping: list[str]) -> DataFrame:
    """Predictors without a drop rule cover every scored pair of their scenario."""
    real = scores.where("ko <> '_global_'")
    total = real.select(*FOLD, "bin", "ko").distinct().groupBy("scenario").agg(F.count(F.lit(1)).alias("total"))
    mine = real.select(*FOLD, "predictor", "bin", "ko").distinct().groupBy("scenario", "predictor").agg(
        F.count(F.lit(1)).alias("n"))
    j = mine.join(total, "scenario").where(~F.col("predictor").isin(dropping))
    return row(j, "full_coverage", F.col("n") == F.col("total"), F.col("n"), F.concat_ws("/", "scenario", "predictor"))


def prediction_alignment(predictions: DataFrame, pair_split: DataFrame) -> DataFrame:
    """Stored labels are test labels of their fold."""
    test = pair_split.where("label = 'test'").select(*FOLD, "ko").distinct().withColumn("known", F.lit(True))
    kos = predictions.select(*FOLD, "predictor", "ko").distinct().join(test, [*FOLD, "ko"], "left")
    per = kos.groupBy(*FOLD, "predictor").agg(F.count_if(F.col("known").isNull()).alias("n"))
    return row(per, "prediction_labels", F.col("n") == 0, F.col("n"),
               F.concat_ws("/", "scenario", F.col("fold").cast("string"), "predictor"))


def role_counts(cell_split: DataFrame, cells: DataFrame, columns: list[str]) -> DataFrame:
    """Cells ``n`` per fold, group and role, stored once: partial counts leave the tasks, not a row per cell and fold."""
    rows = splits.with_groups(cell_split, cells, columns)
    return cut(rows.groupBy(*FOLD, *columns, "label").agg(F.count(F.lit(1)).alias("n")), "role-counts")


def _cells_if(condition: Column) -> Column:
    return F.sum(F.when(condition, F.col("n")).otherwise(F.lit(0)))


def leak_gate(cells: DataFrame, cell_split: DataFrame, bin_scenarios: list[str] = splits.BIN_SCENARIOS) -> DataFrame:
    """Leak report per (scenario, fold) from per-cell roles.

    Where bins are held out the unit is (bin, label), elsewhere the label. Controls never leak; the
    ones labelled test are counted.
    """
    rows = role_counts(cell_split, cells, ["bin", "condition"])
    ctrl = labels.is_control_loose(F.col("condition"))
    by_pair = F.col("scenario").isin(bin_scenarios)
    unit = F.when(by_pair, F.concat_ws("|", "bin", "condition")).otherwise(F.col("condition"))
    tagged = rows.withColumn("unit", F.when(~ctrl, unit))
    counts = tagged.groupBy(*FOLD).agg(
        _cells_if(F.col("label") == "train").alias("n_train"), _cells_if(F.col("label") == "val").alias("n_val"),
        _cells_if(F.col("label") == "test").alias("n_test"),
        _cells_if((F.col("label") == "test") & F.col("unit").isNull()).alias("n_control_in_test"))
    units = (
        tagged.where("unit IS NOT NULL").groupBy(*FOLD, "unit").agg(
            F.bool_or(F.col("label") == "test").alias("te"), F.bool_or(F.col("label").isin("train", "val")).alias("tv"))
        .groupBy(*FOLD).agg(F.count_if("te").alias("n_test_units"), F.count_if(F.col("te") & F.col("tv")).alias("n_leaked")))
    return counts.join(units, FOLD, "left").fillna(0, ["n_test_units", "n_leaked"]).select(
        *FOLD, F.when(by_pair, "pair").otherwise("condition").alias("mode"), "n_train", "n_val", "n_test",
        "n_test_units", "n_leaked", "n_control_in_test",
        ((F.col("n_leaked") == 0) & (F.col("n_test") > 0)).alias("ok"))


def mask_leak(pair_split: DataFrame) -> DataFrame:
    """Pairs that train and test at once, from the masks."""
    tr = splits.train_pairs(pair_split)
    te = splits.test_pairs(pair_split)
    hit = tr.intersect(te).groupBy(*FOLD).agg(F.count(F.lit(1)).alias("n"))
    jobs = pair_split.select(*FOLD).distinct().join(hit, FOLD, "left").fillna(0, ["n"])
    return row(jobs, "mask_leak", F.col("n") == 0, F.col("n"), fold_scope())


def preflight(cells: DataFrame, cell_split: DataFrame, expr: DataFrame, covariate: str = "bin",
              need_covariate: bool = True) -> DataFrame:
    """What an external trainer needs: controls in training, covariates, roles, scale."""
    rows = role_counts(cell_split, cells, list(dict.fromkeys([covariate, "condition"])))
    ctrl = labels.is_control(F.col("condition"))
    per = rows.groupBy(*FOLD).agg(
        _cells_if(ctrl & (F.col("label") == "train")).alias("ctrl"),
        _cells_if(F.col("label") == "train").alias("tr"), _cells_if(F.col("label") == "test").alias("te"),
        F.count_distinct(covariate).alias("cov"))
    lists = rows.where(~ctrl & F.col("label").isin("train", "val", "test")).select(*FOLD, "condition", covariate, "label").distinct()
    unit = ["condition", covariate]
    clash = (
        lists.groupBy(*FOLD, *unit).agg(F.count(F.lit(1)).alias("n"))
        .groupBy(*FOLD).agg(F.count_if(F.col("n") > 1).alias("bad")))
    return union(
        row(per, "control_in_train", F.col("ctrl") > 0, F.col("ctrl"), fold_scope()),
        row(per, "roles_present", (F.col("tr") > 0) & (F.col("te") > 0), F.col("te"), fold_scope()),
        row(per, "covariate_values", F.col("cov") >= (2 if need_covariate else 1), F.col("cov"), fold_scope()),
        row(clash, "lists_disjoint", F.col("bad") == 0, F.col("bad"), fold_scope()),
        log_range(expr, LOG_MAX_MODEL),
    )


def vocabulary_coverage(kos: DataFrame, vocabulary: DataFrame, min_share: float = 0.5) -> DataFrame:
    tokens = kos.select(F.explode(labels.target_tokens(F.col("ko"))).alias("gene")).distinct()
    known = vocabulary.select("gene", F.lit(True).alias("known")).distinct()
    one = tokens.join(known, "gene", "left").agg((F.count("known") / F.count(F.lit(1))).alias("share"))
    return row(one, "vocabulary_coverage", F.col("share") >= min_share, F.round("share", 4))


def prediction_shape(predictions: DataFrame, rect: DataFrame, n_genes: Column) -> DataFrame:
    """Rows never exceed the rectangle, keys are unique, and something finite was emitted."""
    want = rect.groupBy(*FOLD).agg(F.count(F.lit(1)).alias("pairs"))
    finite_one = F.col("delta").isNotNull() & ~F.isnan("delta") & (F.abs("delta") < float("inf"))
    per = (
        predictions.groupBy(*FOLD, "predictor", "bin", "ko", "gene")
        .agg(F.count(F.lit(1)).alias("c"), F.count_if(finite_one).alias("f"))
        .groupBy(*FOLD, "predictor").agg(F.count(F.lit(1)).alias("n"), F.max("c").alias("dup"), F.sum("f").alias("f")))
    j = per.join(want, FOLD, "left")
    ok = (F.col("dup") == 1) & (F.col("n") <= F.col("pairs") * n_genes) & (F.col("f") > 0)
    return row(j, "prediction_shape", ok, F.col("n"), F.concat_ws("/", "scenario", F.col("fold").cast("string"), "predictor"))


def rollup(checks: DataFrame, warnings: list[str] | None = None) -> DataFrame:
    """Errors and warnings per check."""
    soft = F.col("check").isin(warnings or ["missing_target", "missing_single", "missing_base", "batch_column"])
    return checks.groupBy("check").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~F.col("ok") & ~soft).alias("n_errors"),
        F.count_if(~F.col("ok") & soft).alias("n_warnings"))


def require(checks: DataFrame, warnings: list[str] | None = None) -> DataFrame:
    """Fail the job when the roll-up holds an error."""
    bad = F.raise_error(F.concat(F.lit("check failed: "), "check")).cast("bigint")
    return rollup(checks, warnings).withColumn(
        "n_errors", F.when(F.col("n_errors") == 0, F.col("n_errors")).otherwise(bad))
