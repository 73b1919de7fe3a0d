"""Tables for external trainers, and their predictions read back as deltas."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deltascreen.functions import labels
from deltascreen.operators import splits
from deltascreen.operators.bulk import on_pairs
from deltascreen.operators.scale import scalar

FOLD = ["scenario", "fold"]
# Smallest scale, and covariate names that carry no information.
SIGMA_FLOOR = 1e-6
DEGENERATE_COVARIATES = ["none", "all", "nothing"]


def norm_stats(deltas: DataFrame, ctrl: DataFrame, pair_split: DataFrame) -> DataFrame:
    """Mean and population deviation per feature over training profiles and the control profile
    of every training bin."""
    train = splits.train_pairs(pair_split)
    profiles = on_pairs(deltas.select("bin", "ko", "gene", F.col("m_all").alias("m")), train)
    bins = train.select(*FOLD, "bin").distinct()
    controls = bins.join(ctrl.select("bin", "gene", "m"), "bin")
    columns = [*FOLD, "gene", "m"]
    return (
        profiles.select(*columns).unionByName(controls.select(*columns))
        .groupBy(*FOLD, "gene")
        .agg(
            F.avg("m").alias("mu"),
            F.greatest(F.stddev_pop("m"), F.lit(SIGMA_FLOOR)).alias("sigma"),
            F.count(F.lit(1)).alias("n_samples"),
        )
    )


def perturbation_marker(kos: DataFrame, genes: DataFrame) -> DataFrame:
    """Sparse marker: the dose at every target feature that exists."""
    tokens = kos.select(
        "ko", labels.dose_of(F.col("ko")).alias("dose"),
        F.explode(F.array_distinct(labels.dose_targets(F.col("ko")))).alias("gene"),
    )
    return tokens.join(genes.select("gene"), "gene").select("ko", "gene", "dose")


def unrepresentable(kos: DataFrame, genes: DataFrame) -> DataFrame:
    """Labels without any target on the feature axis."""
    return kos.select("ko").join(perturbation_marker(kos, genes).select("ko").distinct(), "ko", "left_anti")


def pair_table(deltas: DataFrame, pair_split: DataFrame, stats: DataFrame, genes: DataFrame,
               label: str = "train") -> DataFrame:
    """Standardised control, marker and target per (fold, bin, ko, gene)."""
    pairs = pair_split.where(F.col("label") == label).select(*FOLD, "bin", "ko")
    marker = perturbation_marker(deltas.select("ko").distinct(), genes)
    return (
        on_pairs(deltas, pairs)
        .join(stats, [*FOLD, "gene"])
        .join(marker, ["ko", "gene"], "left")
        .select(
            *FOLD, "bin", "ko", "gene",
            ((F.col("ctrl") - F.col("mu")) / F.col("sigma")).alias("x_wt"),
            F.coalesce("dose", F.lit(0.0)).alias("marker"),
            (F.col("d_all") / F.col("sigma")).alias("target"),
        )
    )


def validation_pairs(pair_split: DataFrame) -> DataFrame:
    """Validation labels in validation bins (training bins where no bin is held out), without any
    training or test pair."""
    val = pair_split.where("label = 'val'")
    kos = val.select(*FOLD, "ko").distinct()
    bins = val.select(*FOLD, "bin").distinct()
    taken = pair_split.where("label IN ('train', 'test')").select(*FOLD, "bin", "ko")
    # a rectangle's test side is part of the test mask as well
    masked = F.col("scenario").isin(splits.PAIR_MASK_SCENARIOS)
    rect = splits.rectangle(pair_split.where(~masked), "test")
    return (
        kos.join(bins, FOLD)
        .join(taken.unionByName(rect).distinct(), [*FOLD, "bin", "ko"], "left_anti")
        .select(*FOLD, "bin", "ko")
    )


def map_external(
    predictions: DataFrame, deltas: DataFrame, test: DataFrame, covariate: str | None = "covariate"
) -> DataFrame:
    """External absolute profiles -> deltas on the shared features of the test pairs.

    ``predictions(condition, covariate, gene, value)`` may hold one or many rows per label; labels
    match order-free with guides re-attached, covariates match without case and only when there
    is more than one bin and at least one informative covariate.
    """
    key = labels.combo_key_with_guides
    absolute = predictions.withColumn("key", key(F.col("condition")))
    n_bins = scalar(deltas.agg(F.count_distinct("bin")))
    wanted = test.withColumn("key", key(F.col("ko")))
    if covariate is None:
        absolute = absolute.withColumn("cov", F.lit("*"))
        use = F.lit(False)
    else:
        cov = F.lower(F.col(covariate))
        informative = scalar(predictions.agg(F.bool_or(~cov.isin(DEGENERATE_COVARIATES))))
        use = F.coalesce((n_bins > 1) & informative, F.lit(False))
        absolute = absolute.withColumn("cov", F.when(use, cov).otherwise("*"))
    wanted = wanted.withColumn("cov", F.when(use, F.lower("bin")).otherwise("*"))
    means = absolute.groupBy("key", "cov", "gene").agg(F.avg("value").alias("value"))
    ctrl = deltas.select("bin", "ko", "gene", "ctrl")
    return (
        wanted.join(means, ["key", "cov"])
        .join(ctrl, ["bin", "ko", "gene"])
        .select(*FOLD, "bin", "ko", "gene", (F.col("value") - F.col("ctrl")).alias("delta"))
    )


def model_input_cells(
    cells: DataFrame, cell_split: DataFrame, keep_test: bool = False, known: list[str] | None = None,
    covariate: str = "bin",
) -> DataFrame:
    """Cells handed to an external model: training and validation cells (all cells when the
    scenario holds out labels everywhere), without unknown ``ctrl`` labels; the covariate column
    stays only when it has two values or more."""
    rows = cells.join(cell_split, "cell_id")
    if not keep_test:
        rows = rows.where(F.col("label").isin("train", "val"))
    loose = labels.is_control_loose(F.col("condition"), [])
    fine = ~loose | F.col("condition").isin([*labels.CONTROL_LABELS, *(known or [])])
    n_values = scalar(cells.agg(F.count_distinct(covariate)))
    return rows.where(fine).withColumn(
        "model_label", labels.to_model_label(F.col("condition"))
    ).withColumn("model_covariate", F.when(n_values >= 2, F.col(covariate)).otherwise("none"))


def vocabulary_lists(condition_lists: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Condition lists with a flag: every target is in the vocabulary."""
    known = vocabulary.select("gene", F.lit(True).alias("known")).distinct()
    keys = [c for c in condition_lists.columns]
    tokens = condition_lists.withColumn("gene", F.explode(labels.target_tokens(F.col("condition"))))
    return (
        tokens.where(~labels.is_control(F.col("gene")))
        .join(known, "gene", "left")
        .groupBy(*keys)
        .agg(F.bool_and(F.coalesce("known", F.lit(False))).alias("in_vocabulary"))
    )


def covariates_to_predict(cells: DataFrame, cell_split: DataFrame, covariate: str = "bin") -> DataFrame:
    """Covariates of the test cells with the number of control cells they bring."""
    test = (
        splits.with_groups(cell_split.where("label = 'test'"), cells, [covariate])
        .select(*FOLD, covariate).distinct()
    )
    ctrl = (
        cells.where(labels.is_control(F.col("condition")))
        .groupBy(covariate).agg(F.count(F.lit(1)).alias("n_control"))
    )
    return test.join(ctrl, covariate, "left").fillna(0, ["n_control"])


def residualise(values: DataFrame, baseline: DataFrame, keys: list[str], sign: int = -1) -> DataFrame:
    """Subtract (or with ``sign=1`` add back) a baseline; rows without one stay unchanged."""
    base = baseline.select(*keys, "gene", F.col("value").alias("__base"))
    return values.join(base, [*keys, "gene"], "left").withColumn(
        "value", F.col("value") + sign * F.coalesce("__base", F.lit(0.0))
    ).drop("__base")


def baseline_profiles(deltas: DataFrame, per_covariate: bool = True) -> DataFrame:
    """Baseline = control mean + delta, per (bin, condition) or per condition."""
    level = F.col("ctrl") + F.col("d_all")
    named = deltas.select("bin", F.col("ko").alias("condition"), "gene", level.alias("value"))
    if per_covariate:
        return named
    return named.groupBy("condition", "gene").agg(F.avg("value").alias("value"))


def direction_aware_loss(rows: DataFrame, keys: list[str], lam: float = 0.1) -> DataFrame:
    """Mean fourth-power error plus a squared sign-of-change penalty, as a metric.

    Expects ``pred``, ``truth`` and ``ctrl`` levels.
    """
    e = F.col("pred") - F.col("truth")
    s = F.signum(F.col("truth") - F.col("ctrl")) - F.signum(F.col("pred") - F.col("ctrl"))
    n = F.count(F.lit(1))
    return rows.groupBy(*keys).agg(
        (F.sum(e * e * e * e) / n + lam * F.sum(s * s) / n).alias("loss")
    )


def vocabulary(genes: DataFrame) -> DataFrame:
    """Sorted distinct feature names."""
    return genes.select("gene").distinct().orderBy("gene")


def unscale(scaled: DataFrame, stats: DataFrame, kos: DataFrame, genes: DataFrame) -> DataFrame:
    """Model output times sigma over the test rectangle; unrepresentable labels are withheld."""
    return (
        scaled.join(unrepresentable(kos, genes), "ko", "left_anti")
        .join(stats.select(*FOLD, "gene", "sigma"), [*FOLD, "gene"])
        .select(*FOLD, "bin", "ko", "gene", (F.col("scaled") * F.col("sigma")).alias("delta"))
    )
