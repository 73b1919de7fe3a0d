"""Perturbation-label functions: Column in, Column out, all evaluated in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Label vocabularies that decide which rows are kept.
CONTROL_LABELS = ["control", "ctrl", "non-targeting"]
SENTINELS = ["", "nan", "*", "?", "none", "null"]
NON_TARGETING_GUIDES = [
    "NO_SITE", "ONE_NON-GENE_SITE", "NON-GENE_SITE", "NO-TARGET", "NON-TARGETING",
    "NONTARGETING", "NT", "SAFE-HARBOR", "SCRAMBLE",
]
UNASSIGNED_GUIDES = ["", "nan", "none", "null"]


def is_control(label: Column) -> Column:
    """Exact control vocabulary, ignoring case and surrounding blanks."""
    return F.lower(F.trim(label)).isin(CONTROL_LABELS)


def is_control_loose(label: Column, labels: list[str] | None = None) -> Column:
    """Exact list, or any label that contains ``ctrl``."""
    exact = label.isin(labels or CONTROL_LABELS)
    return F.coalesce(exact | F.lower(label).contains("ctrl"), F.lit(False))


def clean_label(raw: Column) -> Column:
    """Canonical label; NULL where the row has to be dropped."""
    text = F.trim(F.coalesce(raw, F.lit("")))
    at = F.instr(text, "@")
    base = F.when(at > 0, F.substring_index(text, "@", 1)).otherwise(text)
    dose = F.when(at > 0, F.substr(text, at)).otherwise("")
    strip = lambda token: F.regexp_replace(F.trim(token), r"_\d+$", "")
    parts = F.transform(
        F.split(base, r"\+"),
        lambda part: F.transform(F.split(part, ";"), lambda t: strip(t)),
    )
    broken = F.exists(
        parts, lambda part: F.exists(part, lambda token: F.lower(token).isin(SENTINELS))
    )
    joined = F.array_join(
        F.array_sort(F.transform(parts, lambda part: F.array_join(part, ";"))), "+"
    )
    return (
        F.when(F.lower(text).isin(SENTINELS), F.lit(None).cast("string"))
        .when(F.lower(text).isin(CONTROL_LABELS), F.lit("control"))
        .when(broken, F.lit(None).cast("string"))
        .otherwise(F.concat(joined, dose))
    )


def target_tokens(ko: Column) -> Column:
    """Target features of a label as an array; the dose suffix is ignored."""
    base = F.substring_index(ko, "@", 1)
    tokens = F.transform(F.split(F.translate(base, ";", "+"), r"\+"), lambda t: F.trim(t))
    return F.filter(tokens, lambda token: token != "")


def label_arity(label: Column) -> Column:
    """0 for controls, otherwise the number of target tokens."""
    return F.when(is_control(label), F.lit(0)).otherwise(F.size(target_tokens(label)))


def dose_of(ko: Column) -> Column:
    """Dose after the last ``@``; 1.0 when there is none or it is not a number."""
    suffix = F.substring_index(ko, "@", -1).try_cast("double")
    return F.when(ko.contains("@"), F.coalesce(suffix, F.lit(1.0))).otherwise(F.lit(1.0))


def dose_targets(ko: Column) -> Column:
    """Targets before the last ``@``; a non-numeric suffix belongs to the name."""
    is_dose = ko.contains("@") & F.substring_index(ko, "@", -1).try_cast("double").isNotNull()
    base = F.when(is_dose, F.regexp_replace(ko, r"@[^@]*$", "")).otherwise(ko)
    tokens = F.transform(F.split(F.translate(base, ";", "+"), r"\+"), lambda t: F.trim(t))
    return F.filter(tokens, lambda token: token != "")


def strict_dose(ko: Column) -> Column:
    """Dose after the first ``@``; NULL when absent or not a number."""
    after = F.substr(ko, F.instr(ko, "@") + 1)
    return F.when(ko.contains("@"), after.try_cast("double"))


def dose_base(ko: Column) -> Column:
    return F.when(strict_dose(ko).isNotNull(), F.substring_index(ko, "@", 1))


def combo_key(ko: Column) -> Column:
    """Order-free key: ``A+B`` equals ``B+A``."""
    return F.array_join(F.array_sort(F.split(ko, r"\+")), "+")


def combo_key_with_guides(label: Column) -> Column:
    """Like :func:`combo_key`, but a purely numeric token is the guide of the token before it."""
    tokens = F.filter(F.split(label, r"\+"), lambda token: token != "")
    empty = F.array().cast("array<string>")

    def fold(done: Column, token: Column) -> Column:
        last = F.element_at(done, -1)
        merged = F.concat(
            F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.concat(last, F.lit("_"), token))
        )
        numeric = token.rlike(r"^\d+$") & (F.size(done) > 0)
        return F.when(numeric, merged).otherwise(F.concat(done, F.array(token)))

    return F.array_join(F.array_sort(F.aggregate(tokens, empty, fold)), "+")


def is_single(ko: Column) -> Column:
    return ~ko.contains("+") & ~ko.contains("@")


def is_combo(ko: Column) -> Column:
    return ko.contains("+")


def guide_token_to_target(token: Column) -> Column:
    """Default tokenizer: the text before the trailing ``_<n>``."""
    return F.regexp_replace(token, r"_\d+$", "")


def guide_targets(guide: Column, sep: str = ";", token_to_target=guide_token_to_target) -> Column:
    """Set of features a guide string targets.

    NULL means unassigned, an empty array means assigned to non-targeting guides only.
    ``token_to_target`` is a Column -> Column function.
    """
    raw = F.filter(F.transform(F.split(guide, sep, -1), lambda t: F.trim(t)), lambda t: t != "")
    named = F.filter(
        F.transform(raw, lambda t: token_to_target(t)), lambda t: ~F.upper(t).isin(NON_TARGETING_GUIDES)
    )
    unassigned = guide.isNull() | F.lower(F.trim(guide)).isin(UNASSIGNED_GUIDES)
    return F.when(~unassigned, F.array_distinct(named))


def guide_class_count(column: Column, mapping: dict[str, int]) -> Column:
    """Number of targets by guide class; unmapped classes give NULL."""
    pairs = [F.lit(v) for kv in mapping.items() for v in kv]
    return F.create_map(*pairs)[column]


def parenthesised_control(raw: Column) -> Column:
    """Labels that open with ``(`` are controls; otherwise keep the text before ``_``."""
    return F.when(raw.startswith("("), F.lit("control")).otherwise(
        F.substring_index(raw, "_", 1)
    )


def underscore_combo(raw: Column) -> Column:
    """``A_B`` written as ``A+B``."""
    return F.regexp_replace(raw, "_", "+")


def condition_from_flags(
    control: Column, double: Column, single: Column, a: Column, b: Column, marker: str = "NegCtrl"
) -> Column:
    """Label from three flags and two component names; ambiguous rows raise."""
    yes = lambda c: F.coalesce(c.cast("string").try_cast("double") == 1.0, F.lit(False)) | F.coalesce(
        F.lower(c.cast("string")) == "true", F.lit(False)
    )
    a_neg, b_neg = a.contains(marker), b.contains(marker)
    fail = lambda text: F.raise_error(F.concat(F.lit(text), a, F.lit(", "), b)).cast("string")
    return (
        F.when(yes(control), F.lit("control"))
        .when(yes(double), F.concat_ws("+", F.array_sort(F.array(a, b))))
        .when(yes(single) & a_neg & ~b_neg, b)
        .when(yes(single) & b_neg & ~a_neg, a)
        .when(yes(single), fail("ambiguous single row: "))
        .otherwise(fail("row is not control, single or double: "))
    )


def to_model_label(condition: Column) -> Column:
    """Control becomes ``ctrl``; a single becomes ``X+ctrl``; combos stay."""
    return (
        F.when(is_control(condition), F.lit("ctrl"))
        .when(condition.contains("+"), condition)
        .otherwise(F.concat(condition, F.lit("+ctrl")))
    )


def from_model_label(label: Column) -> Column:
    """Target list of a model-format label."""
    return F.filter(F.split(label, r"\+"), lambda t: (t != "ctrl") & (t != ""))
