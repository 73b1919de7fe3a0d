"""Per-row quality gates, depth handling, normalisation and feature filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deltascreen.functions import labels
from deltascreen.functions.numeric import clip, depth_normalise
from deltascreen.operators.scale import cut, exact_median, scalar

# Published defaults of the gates.
MITO_PREFIXES = ["MT-", "MT_"]
MITO_FLOOR, MITO_CAP, N_MADS, MAD_SCALE = 0.10, 0.20, 3.0, 1.4826
MITO_MAX_REMOVED, MITO_WARN_REMOVED = 0.50, 0.20
COMPLETE_MIN, EXCESS_MAX = 0.90, 1.05
SHIPPED_LOW, SHIPPED_HIGH = 0.67, 1.5
DEPTH_CANDIDATES = ["ncounts", "nCount_RNA", "n.umi", "UMI_count"]


def clean_cells(cells: DataFrame, raw: str = "condition_raw", out: str = "condition") -> DataFrame:
    """Cleaned label; rows without a usable label are dropped."""
    return cells.withColumn(out, labels.clean_label(F.col(raw))).where(F.col(out).isNotNull())


def label_audit(cells: DataFrame, raw: str = "condition_raw") -> DataFrame:
    """Dropped and renamed labels with counts, in one pass over the cells."""
    cleaned = labels.clean_label(F.col(raw))
    return (
        cells.select(F.col(raw).alias("label"), cleaned.alias("to"))
        .where(F.col("to").isNull() | (F.col("label") != F.col("to")))
        .groupBy("label", "to")
        .agg(F.count(F.lit(1)).alias("count"))
        .select(
            F.when(F.col("to").isNull(), "sentinel").otherwise("cleaned").alias("category"),
            "label",
            "count",
            F.when(F.col("to").isNull(), "dropped: empty or sentinel token")
            .otherwise(F.concat(F.lit("renamed to "), "to"))
            .alias("reason"),
        )
    )


def cell_totals(counts: DataFrame) -> DataFrame:
    """Row sum and number of detected features per cell."""
    return counts.groupBy("cell_id").agg(
        F.sum("cnt").alias("total"), F.count(F.lit(1)).alias("n_genes")
    )


def integrality(counts: DataFrame, column: str = "cnt") -> DataFrame:
    """Number of entries that are not whole numbers (a full pass, not a sample)."""
    return counts.agg(
        F.count(F.lit(1)).alias("n_entries"),
        F.count_if(F.col(column) != F.round(F.col(column))).alias("n_not_integral"),
    )


def require_counts(counts: DataFrame, column: str = "cnt") -> DataFrame:
    """Same rows; a non-integral entry fails the job when it is read."""
    ok = F.col(column) == F.round(F.col(column))
    bad = F.raise_error(F.lit("matrix is not integral, so its row sums are not counts"))
    return counts.withColumn(column, F.when(ok, F.col(column)).otherwise(bad.cast("bigint")))


def resolve_depth(cells: DataFrame, column: str | None, totals: DataFrame | None = None) -> DataFrame:
    """``depth`` from the declared column (finite and > 0, else the job fails) or the row sum."""
    if column is None:
        return cells.join(totals.select("cell_id", F.col("total").cast("double").alias("depth")), "cell_id")
    if column not in cells.columns:
        raise KeyError(f"depth column {column!r} is not in the table")
    value = F.col(column).cast("string").try_cast("double")
    good = value.isNotNull() & ~F.isnan(value) & (value > 0) & (value < F.lit(float("inf")))
    bad = F.raise_error(F.lit(f"{column} has non-positive or non-finite entries"))
    return cells.withColumn("depth", F.when(good, value).otherwise(bad.cast("double")))


def depth_profile(cells: DataFrame, totals: DataFrame, candidates: list[str]) -> DataFrame:
    """Per candidate depth column: bad entries, constancy, and the exact median of total/depth."""
    joined = cells.join(totals.select("cell_id", "total"), "cell_id")
    long = joined.select(
        "total",
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(c).alias("candidate"),
                        F.col(c).cast("string").try_cast("double").alias("depth"),
                    )
                    for c in candidates
                ]
            )
        ).alias("s"),
    ).select("total", "s.*")
    bad = F.col("depth").isNull() | F.isnan("depth") | (F.col("depth") <= 0)
    stats = long.groupBy("candidate").agg(
        F.count_if(bad).alias("n_bad"),
        (F.min("depth") == F.max("depth")).alias("is_constant"),
    )
    ratio = long.where(~bad).select("candidate", (F.col("total") / F.col("depth")).alias("ratio"))
    return stats.join(exact_median(ratio, ["candidate"], "ratio", "retention"), "candidate", "left")


def count_retention(
    cells: DataFrame, totals: DataFrame, declared: str | None = None,
    candidates: list[str] | None = None,
) -> DataFrame:
    """One row: the depth column used, the retained share, and whether that contradicts the
    declaration (``ok``)."""
    if declared is not None:
        prof = depth_profile(cells, totals, [declared])
        contradiction = F.when(F.col("n_bad") > 0, "bad depth entries").when(
            F.col("retention") > EXCESS_MAX, "matrix exceeds the declared depth"
        )
        return prof.select(
            F.col("candidate").alias("depth_column"), "retention", contradiction.alias("problem")
        )
    names = [c for c in (candidates or DEPTH_CANDIDATES) if c in cells.columns]
    if not names:
        return cells.sparkSession.range(1).select(
            F.lit("none").alias("depth_column"),
            F.lit(None).cast("double").alias("retention"),
            F.lit(None).cast("string").alias("problem"),
        )
    order = F.create_map(*[F.lit(x) for i, c in enumerate(names) for x in (c, i)])
    usable = (
        (F.col("n_bad") == 0) & ~F.col("is_constant") & (F.col("retention") <= EXCESS_MAX)
    )
    first = depth_profile(cells, totals, names).agg(
        F.min_by(
            F.when(usable, F.struct(F.col("candidate"), F.col("retention"))),
            F.when(usable, order[F.col("candidate")]),
        ).alias("s")
    )
    return first.select(
        F.coalesce("s.candidate", F.lit("none")).alias("depth_column"),
        F.col("s.retention").alias("retention"),
        F.when(
            F.col("s.retention") < COMPLETE_MIN, "matrix is incomplete but no depth is declared"
        ).alias("problem"),
    )


def enforce(report: DataFrame, problem: str = "problem") -> DataFrame:
    """Turn a report row with a problem into a job failure."""
    return report.withColumn(
        problem,
        F.when(F.col(problem).isNotNull(), F.raise_error(F.col(problem)).cast("string")),
    )


def normalise(
    counts: DataFrame, cells: DataFrame, depth: str = "depth", target_sum: float = 1e4, carry: list[str] | None = None,
) -> DataFrame:
    """``v`` = count / depth * target_sum and ``x`` = log1p(v); ``carry`` adds columns of the cell from the same join."""
    joined = counts.join(cells.select("cell_id", depth, *(carry or [])), "cell_id")
    v = F.when(F.col(depth) > 0, depth_normalise(F.col("cnt"), F.col(depth), target_sum)).otherwise(
        F.raise_error(F.lit("cell with zero total")).cast("double")
    )
    return joined.select("cell_id", "gene", "cnt", v.alias("v"), *(carry or [])).withColumn("x", F.log1p("v"))


def is_mito(gene: Column) -> Column:
    upper = F.upper(gene)
    return upper.startswith(MITO_PREFIXES[0]) | upper.startswith(MITO_PREFIXES[1])


def mito_fraction(counts: DataFrame, depth: DataFrame | None = None) -> DataFrame:
    """Mitochondrial share per cell over the declared depth (or the row sum)."""
    per = counts.groupBy("cell_id").agg(
        F.sum(F.when(is_mito(F.col("gene")), F.col("cnt")).otherwise(0)).alias("mito"),
        F.sum("cnt").alias("total"),
        F.count(F.lit(1)).alias("n_genes"),
    )
    if depth is not None:
        per = per.join(depth.select("cell_id", "depth"), "cell_id")
    base = F.col("depth") if depth is not None else F.col("total")
    frac = F.when(base > 0, F.col("mito") / base).otherwise(0.0)
    return per.select("cell_id", "n_genes", "total", frac.alias("mito_frac"))


def require_fractions(frac: DataFrame) -> DataFrame:
    bad = F.raise_error(F.lit("mitochondrial fraction above 1: wrong denominator")).cast("double")
    return frac.withColumn(
        "mito_frac", F.when(F.col("mito_frac") <= 1.0, F.col("mito_frac")).otherwise(bad)
    )


def shipped_fraction(cells: DataFrame, column: str) -> DataFrame:
    """Shipped value as a fraction: percent when its maximum exceeds 1; missing and NaN become NULL."""
    value = F.nanvl(F.col(column).cast("double"), F.lit(None).cast("double"))
    top = scalar(cells.agg(F.max(value)))
    return cells.select("cell_id", F.when(top <= 1.0, value).otherwise(value / 100.0).alias("shipped"))


def with_shipped(frac: DataFrame, shipped: DataFrame) -> DataFrame:
    """``frac`` with the shipped fractions in place of the computed ones (missing: 0)."""
    joined = frac.drop("mito_frac").join(shipped, "cell_id", "left")
    return joined.withColumn("mito_frac", F.coalesce("shipped", F.lit(0.0))).drop("shipped")


def require_agreement(frac: DataFrame, shipped: DataFrame) -> DataFrame:
    """``frac``, or a failure where its median is far from the shipped one's."""
    ok = scalar(cross_check_fraction(frac, shipped).select("ok"))
    bad = F.raise_error(F.lit("computed and shipped mitochondrial fractions disagree")).cast("double")
    return frac.withColumn("mito_frac", F.when(F.coalesce(ok, F.lit(True)), F.col("mito_frac")).otherwise(bad))


def cross_check_fraction(frac: DataFrame, shipped: DataFrame) -> DataFrame:
    """Computed against shipped median; ``ok`` is NULL when either median is zero."""
    a = exact_median(frac, [], "mito_frac", "m")
    b = exact_median(shipped, [], "shipped", "m")
    both = frac.sparkSession.range(1).select(
        scalar(a).alias("computed"), scalar(b).alias("shipped")
    )
    ratio = F.when((F.col("computed") > 0) & (F.col("shipped") > 0), F.col("computed") / F.col("shipped"))
    return both.withColumn("ratio", ratio).withColumn(
        "ok", F.col("ratio").between(SHIPPED_LOW, SHIPPED_HIGH)
    )


def mito_threshold(
    frac: DataFrame, floor: float = MITO_FLOOR, cap: float = MITO_CAP, n_mads: float = N_MADS
) -> DataFrame:
    """One row: median, scaled MAD and the clipped cut-off, from exact distributed medians.

    The fractions are passed over six times, so the one narrow column is written first.
    """
    frac = cut(frac.select("mito_frac"), "mito_frac")
    med = exact_median(frac, [], "mito_frac", "med")
    dev = frac.select(F.abs(F.col("mito_frac") - scalar(med)).alias("dev"))
    mad = exact_median(dev, [], "dev", "mad")
    one = frac.sparkSession.range(1).select(
        scalar(med).alias("median"), (scalar(mad) * MAD_SCALE).alias("mad")
    )
    cutoff = F.coalesce(clip(F.col("median") + n_mads * F.col("mad"), floor, cap), F.lit(floor))
    return one.withColumn("cutoff", F.when(F.col("median").isNull(), F.lit(floor)).otherwise(cutoff))


def guide_check(cells: DataFrame, n_targets: Column) -> DataFrame:
    """Cells whose guides target more features than the label declares."""
    return cells.withColumn("n_targets", n_targets).withColumn(
        "violation",
        F.coalesce(F.col("n_targets") > labels.label_arity(F.col("condition")), F.lit(False)),
    )


def guide_summary(checked: DataFrame) -> DataFrame:
    return checked.agg(
        F.count(F.lit(1)).alias("n_cells"),
        F.count_if(F.col("n_targets").isNull()).alias("n_unassigned"),
        F.count_if("violation").alias("n_violations"),
    )


def qc_flags(
    cells: DataFrame, frac: DataFrame, min_genes: int = 200, mito_max: float | None = None,
    n_targets: Column | None = None, apply_mito: bool = True,
    floor: float = MITO_FLOOR, cap: float = MITO_CAP,
) -> DataFrame:
    """One row per cell with one boolean per gate.

    The adaptive cut-off is taken from the cells that pass the first gate. Cells without any
    count have no row in ``frac`` and count as zero features.
    """
    zero = {"n_genes": 0, "total": 0, "mito_frac": 0.0}
    joined = cells.join(frac, "cell_id", "left").fillna(zero)
    flagged = joined.withColumn("pass_genes", F.col("n_genes") >= min_genes)
    if not apply_mito:
        limit = F.lit(float("inf"))
    elif mito_max is not None:
        limit = F.lit(mito_max)
    else:
        survivors = frac.where(F.col("n_genes") >= min_genes)
        limit = scalar(mito_threshold(survivors, floor, cap).select("cutoff"))
    flagged = flagged.withColumn("mito_cutoff", limit).withColumn(
        "pass_mito", F.col("mito_frac") < F.col("mito_cutoff")
    )
    if n_targets is None:
        return flagged.withColumn("pass_guide", F.lit(True))
    return guide_check(flagged, n_targets).withColumn("pass_guide", ~F.col("violation"))


def qc_keep(flagged: DataFrame) -> DataFrame:
    return flagged.where(F.col("pass_genes") & F.col("pass_mito") & F.col("pass_guide"))


def qc_audit(flagged: DataFrame, guide_declared: bool = True, mito_applied: bool = True) -> DataFrame:
    """One row per gate, including gates that were skipped; all from one aggregate."""
    g, m, u = F.col("pass_genes"), F.col("pass_mito"), F.col("pass_guide")
    one = flagged.agg(
        F.count(F.lit(1)).alias("n_before"),
        F.count_if(g & m & u).alias("n_after"),
        F.count_if(~g).alias("r1"),
        F.count_if(g & ~m).alias("r2"),
        F.count_if(g & m & ~u).alias("r3"),
        F.count_if(g).alias("at2"),
    )
    row = lambda gate, applied, removed, base: F.struct(
        F.lit(gate).alias("gate"), F.lit(applied).alias("applied"),
        F.col(removed).alias("n_removed"), F.col(base).alias("n_entering"),
    )
    gates = F.array(
        row("min_genes", True, "r1", "n_before"),
        row("mito", mito_applied, "r2", "at2"),
        row("guide_moi", guide_declared, "r3", "at2"),
    )
    share = F.col("n_removed") / F.greatest(F.col("n_entering"), F.lit(1))
    status = (
        F.when((F.col("gate") == "mito") & (share > MITO_MAX_REMOVED), "error")
        .when((F.col("gate") == "mito") & (share > MITO_WARN_REMOVED), "warning")
        .otherwise("ok")
    )
    return (
        one.select("n_before", "n_after", F.explode(gates).alias("s"))
        .select("n_before", "n_after", "s.*")
        .withColumn("status", status)
        .drop("n_entering")
    )


def require_audit(audit: DataFrame) -> DataFrame:
    bad = F.raise_error(F.lit("mitochondrial gate removes most cells")).cast("string")
    return audit.withColumn("status", F.when(F.col("status") == "error", bad).otherwise(F.col("status")))


def target_genes(cells: DataFrame, condition: str = "condition") -> DataFrame:
    """Distinct features targeted by any non-control label; a label without target raises."""
    distinct = cells.select(F.col(condition).alias("ko")).distinct().where(~labels.is_control(F.col("ko")))
    tokens = labels.target_tokens(F.col("ko"))
    checked = F.when(F.size(tokens) > 0, tokens).otherwise(
        F.raise_error(F.concat(F.lit("label without target: "), F.col("ko"))).cast("array<string>")
    )
    return distinct.select(F.explode(checked).alias("gene")).distinct()


def filter_genes(counts: DataFrame, targets: DataFrame, min_cells: int = 3) -> DataFrame:
    """Features detected in at least ``min_cells`` cells, or targeted by a label."""
    seen = counts.where("cnt > 0").groupBy("gene").agg(F.count(F.lit(1)).alias("n_cells"))
    return (
        seen.join(targets.withColumn("is_target", F.lit(True)), "gene", "left")
        .fillna(False, ["is_target"])
        .where((F.col("n_cells") >= min_cells) | F.col("is_target"))
    )


def annotate_targets(genes: DataFrame, targets: DataFrame) -> DataFrame:
    return genes.join(targets.withColumn("is_target", F.lit(True)), "gene", "left").fillna(
        False, ["is_target"]
    )


def missing_targets(genes: DataFrame, targets: DataFrame) -> DataFrame:
    return targets.join(genes, "gene", "left_anti")


def panel(genes: DataFrame) -> DataFrame:
    """Union of the highly variable and the targeted features."""
    return genes.where(F.col("hvg") | F.col("is_target"))


def full_coverage(cells: DataFrame, min_cells: int = 4, by_half: bool = True) -> DataFrame:
    """Labels with enough cells in every bin (and in both halves when ``by_half``)."""
    slot = ["bin", "half"] if by_half else ["bin"]
    n_slots = F.lit(2 if by_half else 1)
    n_bins = scalar(cells.agg(F.count_distinct("bin")))
    return (
        cells.where(~labels.is_control(F.col("condition")))
        .groupBy(F.col("condition").alias("ko"), *slot)
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") >= min_cells)
        .groupBy("ko")
        .agg(F.count(F.lit(1)).alias("slots"))
        .where(F.col("slots") == n_bins * n_slots)
        .select("ko")
    )


def restrict_to_coverage(cells: DataFrame, kos: DataFrame) -> DataFrame:
    """Controls plus the cells of the covered labels."""
    covered = kos.select(F.col("ko").alias("condition")).withColumn("covered", F.lit(True))
    return cells.join(covered, "condition", "left").where(
        F.col("covered") | labels.is_control(F.col("condition"))
    ).drop("covered")


def subset(expr: DataFrame, cells: DataFrame, genes: DataFrame) -> DataFrame:
    """Row and column subset of a big table."""
    return expr.join(genes.select("gene"), "gene", "left_semi").join(
        cells.select("cell_id"), "cell_id", "left_semi"
    )
