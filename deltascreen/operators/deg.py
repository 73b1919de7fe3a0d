"""Differential effect per feature: rank test, Welch test, false-discovery control, weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from deltascreen.functions import labels
from deltascreen.functions.numeric import clip, two_sided_normal_p
from deltascreen.functions.tdist import t_two_sided_p
from deltascreen.operators.bulk import grouped_sum
from deltascreen.operators.entries import carries, roll_up
from deltascreen.operators.scale import cut, spread, tasks_for, value_buckets

# Fold change reported where a mean is zero, and the call threshold.
CLIP_VALUE = 20.0
ALPHA = 0.05
MIN_CELLS = 4
# value buckets of the rank test per doubling of the value
STEPS_PER_OCTAVE = 8


def bh_rows(df: DataFrame, row: list[str], p: str = "p", tie: str = "gene", out: str = "padj") -> DataFrame:
    """Step-up adjustment inside each row; a row holds at most one value per feature."""
    asc = W.partitionBy(*row).orderBy(p, tie)
    whole = W.partitionBy(*row)
    down = W.partitionBy(*row).orderBy(F.col(p).desc(), F.col(tie).desc()).rowsBetween(
        W.unboundedPreceding, 0
    )
    scaled = F.col(p) * F.count(F.lit(1)).over(whole) / F.row_number().over(asc)
    return df.withColumn("__s", scaled).withColumn(
        out, F.least(F.lit(1.0), F.min("__s").over(down))
    ).drop("__s")


def bh_pooled(
    df: DataFrame, keys: list[str], p: str = "p", salt: list[str] | None = None, out: str = "padj",
    n_buckets: int = 256,
) -> DataFrame:
    """Step-up adjustment over a whole pool without sorting the pool in one task.

    Equal p-values collapse to one row first. The distinct values are cut into ordered buckets;
    bucket counts give every bucket its starting rank, bucket minima give the carry of the
    reverse running minimum. Rows at p = 1 need no lookup (their adjusted value is 1), so they
    are scattered by ``salt`` instead of meeting on one join key.
    """
    pool = df.groupBy(*keys, p).agg(F.count(F.lit(1)).alias("__c"))
    sizes = pool.groupBy(*keys).agg(F.sum("__c").alias("__m"))
    marked = value_buckets(pool.where(F.col(p) < 1.0), keys, p, n_buckets)
    before = W.partitionBy(*keys).orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = (
        marked.groupBy(*keys, "__bucket").agg(F.sum("__c").alias("__rows"))
        .select(*keys, "__bucket", F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__start"))
    )
    up = W.partitionBy(*keys, "__bucket").orderBy(p).rowsBetween(W.unboundedPreceding, 0)
    raw = (
        marked.join(starts, [*keys, "__bucket"])
        .join(sizes, keys)
        .withColumn("__q", F.col(p) * F.col("__m") / (F.col("__start") + F.sum("__c").over(up)))
    )
    after = W.partitionBy(*keys).orderBy(F.col("__bucket").desc()).rowsBetween(W.unboundedPreceding, -1)
    carry = (
        raw.groupBy(*keys, "__bucket").agg(F.min("__q").alias("__low"))
        .select(*keys, "__bucket", F.min("__low").over(after).alias("__carry"))
    )
    down = W.partitionBy(*keys, "__bucket").orderBy(F.col(p).desc()).rowsBetween(W.unboundedPreceding, 0)
    adjusted = raw.join(carry, [*keys, "__bucket"]).select(
        *keys,
        F.col(p).alias("__p"),
        F.least(F.min("__q").over(down), F.col("__carry"), F.lit(1.0)).alias(out),
    )
    spread_key = F.lit(-1.0) - (F.pmod(F.hash(*(salt or keys)), F.lit(1024))).cast("double")
    keyed = df.withColumn("__p", F.when(F.col(p) < 1.0, F.col(p)).otherwise(spread_key))
    return keyed.join(adjusted, [*keys, "__p"], "left").drop("__p").withColumn(
        out, F.coalesce(out, F.lit(1.0))
    )


def _ties(t: Column) -> Column:
    d = t.cast("double")
    return d * d * d - d


def rank_statistics(
    expr: DataFrame, cells: DataFrame, genes: DataFrame, kos: DataFrame | None = None,
    min_cells: int = MIN_CELLS, continuity: bool = False, clip_value: float = CLIP_VALUE,
) -> DataFrame:
    """Tie-corrected Mann-Whitney U of every label against its bin's controls, per half and feature.

    The entries are shuffled once, by (bin, feature, value bucket), each entry as one row: halves and
    the whole are told apart behind the shuffle, in place. Buckets are steps of the logarithm, so a
    feature of a hot bin is split over many tasks. Ranks inside a bucket come from one ordered window;
    bucket totals carry the control counts below. Entries that carry their group are not joined to cells. Implicit zeros never become rows, they enter U and
    the tie term in closed form.
    """
    ctrl = labels.is_control(F.col("condition"))
    known = None if kos is None else kos.select(F.col("ko").alias("condition")).withColumn("__known", F.lit(True))
    tested_or_control = lambda df: df if known is None else df.join(known, "condition", "left").where(ctrl | F.col("__known")).drop("__known")
    used = tested_or_control(cells.select("cell_id", "bin", "half", "condition"))
    if carries(expr, ["bin", "half", "condition"]):
        entries = tested_or_control(expr.select("gene", "v", "bin", "half", "condition"))
    else:
        entries = expr.select("cell_id", "gene", "v").join(used, "cell_id")
    both = F.explode(F.array("half", F.lit("all")))
    sizes = (
        used.groupBy("bin", "half", "condition").agg(F.count(F.lit(1)).alias("n"))
        .withColumn("half", both)
        .groupBy("bin", "half", "condition").agg(F.sum("n").alias("n"))
    )
    place = ["bin", "half", "gene", "bucket"]
    hist = (
        entries
        .withColumn("bucket", F.floor(F.log2("v") * STEPS_PER_OCTAVE).cast("int"))
        .repartition(tasks_for(expr.sparkSession, expr.count()), "bin", "gene", "bucket")
        .groupBy(*place, "condition", "v").agg(F.count(F.lit(1)).alias("n"))
        .withColumn("half", both)
        .groupBy(*place, "condition", "v").agg(F.sum("n").alias("n"))
        .withColumn("is_ctrl", ctrl)
    )
    n = F.col("n")
    # a control row comes first among equal values, so it is the last control seen by its ties
    walk = W.partitionBy(*place).orderBy("v", F.col("is_ctrl").desc()).rowsBetween(W.unboundedPreceding, 0)
    seen = F.last(F.when(F.col("is_ctrl"), F.struct("v", "n")), ignorenulls=True).over(walk)
    c_eq = F.col("c_eq")
    local = (
        hist.withColumn("c_le", F.sum(F.when(F.col("is_ctrl"), n).otherwise(0)).over(walk))
        .withColumn("seen", seen)
        .withColumn("c_eq", F.when(F.col("seen.v") == F.col("v"), F.col("seen.n")).otherwise(0))
        .groupBy(*place, "condition", "is_ctrl")
        .agg(
            F.sum(n).alias("nnz"),
            F.sum(n * F.log1p("v")).alias("sx"),
            F.sum(n * (F.col("c_le") - c_eq / 2.0)).alias("u_in"),
            F.sum(F.when(F.col("is_ctrl"), _ties(n)).otherwise(_ties(c_eq + n) - _ties(c_eq))).alias("ties"),
        )
    )
    # read by the control side and the label side: written once, so the big shuffle runs once
    local = cut(local, "rank_local")
    below = W.partitionBy("bin", "half", "gene").orderBy("bucket").rangeBetween(W.unboundedPreceding, -1)
    stats = (
        local.withColumn("c_below", F.coalesce(
            F.sum(F.when(F.col("is_ctrl"), F.col("nnz")).otherwise(0)).over(below), F.lit(0)))
        .groupBy("bin", "half", "gene", "condition")
        .agg(
            F.sum("nnz").alias("nnz"), F.sum("sx").alias("sx"), F.sum("ties").alias("ties"),
            F.sum(F.col("u_in") + F.col("nnz") * F.col("c_below")).alias("u_nz"),
        )
    )
    control = stats.where(ctrl).select(
        "bin", "half", "gene", F.col("nnz").alias("nnz0"), F.col("sx").alias("sx0"),
        F.col("ties").alias("ties0"),
    )
    many = F.raise_error(F.concat(F.lit("more than one control label in bin "), F.col("bin"))).cast("bigint")
    n_control = sizes.where(ctrl).groupBy("bin", "half").agg(
        F.sum("n").alias("n0"), F.count(F.lit(1)).alias("labels")
    ).select("bin", "half", F.when(F.col("labels") == 1, F.col("n0")).otherwise(many).alias("n0"))
    tested = sizes.where(~ctrl & (F.col("n") >= min_cells)).withColumnRenamed("n", "n1")
    grid = spread(tested.join(n_control, ["bin", "half"]), genes, "gene")
    full = (
        grid.join(stats.where(~ctrl), ["bin", "half", "gene", "condition"], "left")
        .join(control, ["bin", "half", "gene"], "left")
        .fillna(0, ["nnz", "sx", "u_nz", "ties", "nnz0", "sx0", "ties0"])
    )
    n0, n1 = F.col("n0").cast("double"), F.col("n1").cast("double")
    z0, z1 = n0 - F.col("nnz0"), n1 - F.col("nnz")
    total = n0 + n1
    u = F.col("u_nz") + F.col("nnz") * z0 + z1 * z0 / 2.0
    tie = F.col("ties0") + F.col("ties") + _ties(z0 + z1)
    var = n0 * n1 / 12.0 * ((total + 1.0) - tie / (total * (total - 1.0)))
    gap = F.col("u") - n0 * n1 / 2.0
    if continuity:
        gap = F.signum(gap) * F.greatest(F.abs(gap) - 0.5, F.lit(0.0))
    mean1, mean0 = F.expm1(F.col("sx") / n1), F.expm1(F.col("sx0") / n0)
    fold_change = (
        F.when((F.col("nnz") == 0) & (F.col("nnz0") == 0), 1.0)
        .when(F.col("nnz0") == 0, clip_value)
        .when(F.col("nnz") == 0, 1.0 / clip_value)
        .otherwise(mean1 / mean0)
    )
    return (
        full.withColumn("u", u).withColumn("var", var)
        .withColumn("z", F.when(F.col("var") > 1e-9, gap / F.sqrt("var")).otherwise(0.0))
        .withColumn("p", F.when(F.col("var") > 1e-9, two_sided_normal_p(F.col("z"))).otherwise(1.0))
        .withColumn("fc", fold_change)
        .withColumn("substituted", (F.col("nnz") == 0) != (F.col("nnz0") == 0))
        .select(
            "bin", "half", F.col("condition").alias("ko"), "gene",
            F.col("n1").alias("n_cells"), "u", "z", "p", "fc", "substituted",
        )
    )


def effect_score(kind: str = "log2fc") -> Column:
    l2 = F.when(F.col("fc") > 0, F.log2("fc")).otherwise(0.0)
    if kind == "log2fc":
        return l2
    if kind == "signed_neglog10p":
        return F.signum(l2) * -F.log10(clip(F.coalesce("p", F.lit(1.0)), 1e-300, 1.0))
    raise ValueError(f"unknown score {kind!r}")


def rank_test(
    expr: DataFrame, cells: DataFrame, genes: DataFrame, kos: DataFrame | None = None,
    min_cells: int = MIN_CELLS, score: str = "log2fc", continuity: bool = False,
) -> DataFrame:
    """Rank statistics, score, and adjustment pooled over all labels and features of a (bin, half).

    The adjustment passes over the statistics several times, so they are written once first.
    """
    stats = rank_statistics(expr, cells, genes, kos, min_cells, continuity)
    written = cut(stats.withColumn("score", effect_score(score)), "rank_statistics")
    return bh_pooled(written, ["bin", "half"], salt=["ko", "gene"])


def require_one_control(cells: DataFrame) -> DataFrame:
    """Control labels per bin; more than one is an error the caller has to see."""
    ctrl = labels.is_control(F.col("condition"))
    n = F.count_distinct("condition")
    bad = F.raise_error(F.lit("more than one control label in a bin")).cast("bigint")
    return cells.where(ctrl).groupBy("bin").agg(F.when(n == 1, n).otherwise(bad).alias("n_labels"))


def welch_statistics(
    expr: DataFrame, cells: DataFrame, genes: DataFrame, kos: DataFrame | None = None,
    min_cells: int = MIN_CELLS, moments: DataFrame | None = None,
) -> DataFrame:
    """Welch t of each label against the rest of the tested labels, the rest taken as large as
    the group. The rest's moments are the pool total minus the group."""
    ctrl = labels.is_control(F.col("condition"))
    named = cells.where(~ctrl).withColumnRenamed("condition", "ko")
    if kos is not None:
        named = named.join(kos.select("ko"), "ko", "left_semi")
    keys = ["bin", "half", "ko"]
    sizes = named.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_cells)
    if moments is None:
        sums = grouped_sum(expr, named.join(sizes.select(*keys), keys, "left_semi"), keys)
    else:
        sums = roll_up(moments.withColumnRenamed("condition", "ko").join(sizes.select(*keys), keys, "left_semi"), keys)
    sums = sums.select(*keys, "gene", F.col("sx").alias("s"), F.col("sxx").alias("q"))
    totals = sums.groupBy("bin", "half", "gene").agg(F.sum("s").alias("ts"), F.sum("q").alias("tq"))
    pool = sizes.groupBy("bin", "half").agg(F.sum("n").alias("tn"))
    full = (
        spread(sizes.join(pool, ["bin", "half"]), genes, "gene")
        .join(sums, [*keys, "gene"], "left")
        .join(totals, ["bin", "half", "gene"], "left")
        .fillna(0.0, ["s", "q", "ts", "tq"])
    )
    one = F.lit(1.0)
    n = F.greatest(F.col("n").cast("double"), one)
    r = F.greatest((F.col("tn") - F.col("n")).cast("double"), one)
    mean_g, mean_r = F.col("s") / n, (F.col("ts") - F.col("s")) / r
    var_g = (F.col("q") / n - mean_g * mean_g) * n / F.greatest(n - 1, one)
    var_r = ((F.col("tq") - F.col("q")) / r - mean_r * mean_r) * r / F.greatest(r - 1, one)
    full = full.withColumn("vg", var_g / n).withColumn("vr", var_r / n)
    se = F.col("vg") + F.col("vr")
    bottom = (F.col("vg") * F.col("vg") + F.col("vr") * F.col("vr")) / F.greatest(n - 1, one)
    return full.select(
        *keys, "gene", "n",
        F.when(se > 0, (mean_g - mean_r) / F.sqrt(F.greatest(se, F.lit(0.0)))).otherwise(0.0).alias("t"),
        F.when(bottom > 0, se * se / bottom).otherwise(F.greatest(2.0 * n - 2.0, one)).alias("df"),
    )


def welch_test(
    expr: DataFrame, cells: DataFrame, genes: DataFrame, kos: DataFrame | None = None,
    min_cells: int = MIN_CELLS, moments: DataFrame | None = None,
) -> DataFrame:
    stats = welch_statistics(expr, cells, genes, kos, min_cells, moments)
    return bh_rows(
        stats.withColumn("p", t_two_sided_p(F.col("t"), F.col("df"))), ["bin", "half", "ko"]
    )


def gene_weights(deg: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """Weight = |score| / row maximum over called, measured features; direction where called.

    A row with calls but no measured one fails the job.
    """
    row = W.partitionBy("bin", "ko")
    called = F.col("padj") < alpha
    usable = called & ~F.col("substituted")
    a = F.when(usable, F.abs("score")).otherwise(0.0)
    top, any_called, any_usable = F.max("__a").over(row), F.max(called).over(row), F.max(usable).over(row)
    starved = F.raise_error(F.lit("row has called features but no measured one")).cast("double")
    return (
        deg.withColumn("__a", a)
        .withColumn("w", F.when(any_called & ~any_usable, starved)
                    .when(top > 0, F.col("__a") / top).otherwise(0.0))
        .select(
            "bin", "ko", "gene", "w", called.alias("deg"),
            F.when(called, F.signum("score")).otherwise(0.0).cast("int").alias("dir"),
        )
    )


def gene_weights_minmax(deg: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """Older rule: squared min-max of |score| per row; direction is not masked."""
    row = W.partitionBy("bin", "ko")
    a = F.abs("score")
    low, high = F.min(a).over(row), F.max(a).over(row)
    scaled = (a - low) / F.when(high > low, high - low).otherwise(1.0)
    return deg.select(
        "bin", "ko", "gene", (scaled * scaled).alias("w"), (F.col("padj") < alpha).alias("deg"),
        F.signum("score").cast("int").alias("dir"),
    )


def interpolation_alpha(deg: DataFrame) -> DataFrame:
    """1 - adjusted p of the second half; missing features give 0 at the join."""
    return deg.where("half = 'second_half'").select(
        "bin", "ko", "gene", clip(1.0 - F.coalesce("padj", F.lit(1.0)), 0.0, 1.0).alias("alpha")
    )
