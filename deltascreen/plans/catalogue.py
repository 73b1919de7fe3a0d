"""Metrics, suffixes, scenario defaults and the dataset catalogue."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

TOP_K = 200
TOP_EXPRESSED = 1000
TOP_SUFFIX = "_top_200_most_affected_genes_per_perturbation"
EXPRESSED_SUFFIX = "_top_1000_expressed_genes_global"

# base metric -> (higher is better, perfect value, category)
BASES = {
    "mse": (False, 0.0, "error"),
    "mae": (False, 0.0, "error"),
    "pearson": (True, 1.0, "correlation"),
    "r2": (True, 1.0, "correlation"),
    "r2_centered": (True, 1.0, "correlation"),
    "ccc": (True, 1.0, "correlation"),
    "spearman": (True, 1.0, "correlation"),
    "frac_correct_direction": (True, 1.0, "direction"),
}

# suffix -> (feature set, only labels that are regulators)
SUFFIXES = {
    "": ("all", False),
    "_within": ("within", True),
    "_outside": ("outside", True),
    "_go_within": ("go_within", False),
    "_go_outside": ("go_outside", False),
    "_ppi_within": ("ppi_within", False),
    "_ppi_outside": ("ppi_outside", False),
    "_pathway_within": ("pathway_within", False),
    "_pathway_outside": ("pathway_outside", False),
    "_tf_target_within": ("tf_target_within", True),
    "_tf_target_outside": ("tf_target_outside", True),
    "_across_TF_perturbations": ("all", True),
    TOP_SUFFIX: ("all", False),
    EXPRESSED_SUFFIX: ("top_1000_expressed", False),
    "_weighted": ("all", False),
    "_var_weighted": ("all", False),
}

STANDARD = ["", "_weighted", "_var_weighted", "_within", "_outside", "_across_TF_perturbations",
            TOP_SUFFIX, EXPRESSED_SUFFIX]
REAL_DATA = ["", "_weighted", "_var_weighted", "_go_within", "_go_outside", "_ppi_within",
             "_ppi_outside", "_pathway_within", "_pathway_outside", "_tf_target_within",
             "_tf_target_outside", "_across_TF_perturbations", TOP_SUFFIX, EXPRESSED_SUFFIX]

# metric -> (higher is better, perfect value, category)
STANDALONE = {
    "fold_change_gap": (False, 0.0, "error"),
    "var_ratio_log_error": (False, 0.0, "distributional"),
    "pds_cosine": (True, 1.0, "discrimination"),
    "pds_l2": (True, 1.0, "discrimination"),
    "pds_l1": (True, 1.0, "discrimination"),
    "effect_size_auroc": (True, 1.0, "discrimination"),
    "cosine_rank": (False, 0.0, "discrimination"),
    "gsea_up": (True, 1.0, "enrichment"),
    "gsea_down": (True, 1.0, "enrichment"),
}

HEADLINE = [
    "mse", "mse_weighted", "mse" + TOP_SUFFIX,
    "pearson", "pearson_weighted", "pearson" + TOP_SUFFIX,
    "r2", "r2_weighted", "ccc", "ccc_weighted", "frac_correct_direction",
    "pds_cosine", "cosine_rank", "var_ratio_log_error", "gsea_up", "gsea_down",
]

DEFAULT_BASELINE = {
    "UnseenPert": "Mean-over-perturbations",
    "UnseenCell": "Mean-over-cell-types",
    "UnseenBoth": "Mean-over-perturbations-and-cell-types",
    "UnseenPair": "Two-way-mean",
    "UnseenDose": "Scaled-delta",
    "UnseenCombo": "Additive",
}
CANDIDATE_BASELINES = {
    "UnseenPert": ["Mean-over-perturbations", "Mean-over-perturbations-and-cell-types", "TargetScaling",
                   "Mean+TargetScaling"],
    "UnseenCell": ["Mean-over-cell-types", "Mean-over-perturbations-and-cell-types", "TargetScaling",
                   "Mean+TargetScaling"],
    "UnseenBoth": ["Mean-over-perturbations-and-cell-types", "TargetScaling", "Mean+TargetScaling"],
    "UnseenPair": ["Two-way-mean", "Mean-over-perturbations", "Mean-over-cell-types",
                   "Mean-over-perturbations-and-cell-types", "TargetScaling", "Mean+TargetScaling"],
    "UnseenDose": ["Scaled-delta", "TargetScaling"],
    "UnseenCombo": ["Additive", "Matching-mean", "TargetScaling"],
}
HARDEST_METRICS = ["mse_weighted", "pearson_weighted", "ccc_weighted", "gsea_up", "gsea_down"]
NEGATIVE_CONTROL = "Zero"
POSITIVE_CONTROL = "Interp-duplicate"
GLOBAL = "_global_"

REASONS = {
    "target_not_in_panel": "target features are not on the panel",
    "single_gene_only": "only single labels are handled",
    "combo_arity": "only two-way combinations (or doses) are handled",
    "combo_component_missing": "a component of the label has no data of its own",
    "no_valid_prediction": "no valid prediction was produced",
}

# dataset -> scenario -> folds
DATASETS = {
    "adamson16": {"UnseenPert": 5},
    "frangieh21": {"UnseenPert": 5},
    "norman19": {"UnseenCombo": 2},
    "sunshine23": {"UnseenCombo": 2},
    "wessels23": {"UnseenCombo": 2},
    "replogle20": {"UnseenCombo": 2},
    "replogle22": {"UnseenPert": 5, "UnseenBoth": 5},
    "mcfaline23": {"UnseenPert": 5, "UnseenCell": 3, "UnseenBoth": 5, "UnseenPair": 5},
    "jiang24": {"UnseenPert": 5, "UnseenCell": 5, "UnseenBoth": 5, "UnseenPair": 5},
    "xatlas_orion": {"UnseenPert": 5, "UnseenBoth": 5},
    "ecoli_synthetic": {"UnseenPert": 3, "UnseenCell": 3, "UnseenBoth": 3, "UnseenPair": 3,
                        "UnseenDose": 3, "UnseenCombo": 3},
}
DEFAULT_N_HVG = 8192
HVG_OVERRIDES = {"replogle22": 7226, "ecoli_synthetic": 2853}


def expected_hvg(dataset: str) -> int:
    return HVG_OVERRIDES.get(dataset, DEFAULT_N_HVG)


@dataclass(frozen=True)
class Metric:
    name: str
    base: str
    suffix: str
    category: str
    higher_is_better: bool
    perfect_value: float
    feature_set: str
    regulators_only: bool
    headline: bool


def metrics(suffixes: list[str] = STANDARD) -> list[Metric]:
    """Base x suffix expansion plus the standalone metrics."""
    out = []
    for base, (higher, perfect, category) in BASES.items():
        for suffix in suffixes if category != "direction" else [""]:
            features, regulators = SUFFIXES[suffix]
            name = base + suffix
            out.append(Metric(name, base, suffix, category, higher, perfect, features,
                              regulators or category == "direction", name in HEADLINE))
    for name, (higher, perfect, category) in STANDALONE.items():
        out.append(Metric(name, "", "", category, higher, perfect, "all", False, name in HEADLINE))
    return out


def headline_metrics() -> list[Metric]:
    return [m for m in metrics() if m.headline]


def metric_table(spark: SparkSession, suffixes: list[str] = STANDARD) -> DataFrame:
    rows = [(m.name, m.base, m.suffix, m.category, m.higher_is_better, m.perfect_value, m.headline)
            for m in metrics(suffixes)]
    return spark.createDataFrame(
        rows, "metric string, base string, suffix string, category string, higher_is_better boolean, "
              "perfect double, headline boolean")


def job_table(spark: SparkSession) -> DataFrame:
    """One row per (dataset, scenario, fold)."""
    rows = [(d, s, f) for d, plan in DATASETS.items() for s, n in plan.items() for f in range(n)]
    return spark.createDataFrame(rows, "dataset string, scenario string, fold int")
