"""Seeded draws: ranks of md5(seed | keys) replace a random generator, so every draw is
reproducible, independent per group, and exact at any scale."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from deltascreen.functions import labels
from deltascreen.operators.scale import cut, hash_rank, running_sum, scalar


def seeded_digest(seed: int, *keys: str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))


def seeded_uniform(seed: int, *keys: str) -> Column:
    """Uniform in [0, 1) from the first 48 bits of the digest."""
    return F.conv(F.substring(seeded_digest(seed, *keys), 1, 12), 16, 10).cast("double") / F.lit(
        float(2**48)
    )


def downsample(
    cells: DataFrame, min_cells: int = 12, control_cap: int = 8192, pert_cap: int | None = None,
    seed: int = 42,
) -> DataFrame:
    """Drop conditions below the floor and draw capped ones down, independently per group."""
    ranked = hash_rank(
        cells, ["bin", "condition"], seeded_digest(seed, "bin", "condition", "cell_id"), ["cell_id"]
    )
    cap = F.when(labels.is_control(F.col("condition")), F.lit(control_cap)).otherwise(
        F.lit(pert_cap if pert_cap is not None else 2**31 - 1)
    )
    return ranked.where((F.col("group_size") >= min_cells) & (F.col("rank") <= cap)).drop(
        "rank", "group_size"
    )


def keep_probabilities(
    cells: DataFrame, min_cells: int = 12, target_cap: int = 96, control_cap: int = 8192
) -> DataFrame:
    """Per-condition keep probability: the capped mean size for labels, a cap for controls."""
    sizes = cells.groupBy("condition").agg(F.count(F.lit(1)).alias("n"))
    ctrl = labels.is_control(F.col("condition"))
    mean = scalar(sizes.where(~ctrl & (F.col("n") >= min_cells)).agg(F.avg("n")))
    target = F.least(F.rint(mean), F.lit(float(target_cap)))
    goal = F.when(ctrl, F.lit(float(control_cap))).otherwise(target)
    return sizes.withColumn(
        "p",
        F.when(~ctrl & (F.col("n") < min_cells), 0.0).otherwise(
            F.least(F.lit(1.0), goal / F.col("n"))
        ),
    )


def bernoulli_sample(cells: DataFrame, probabilities: DataFrame, seed: int = 42) -> DataFrame:
    return cells.join(probabilities.select("condition", "p"), "condition").where(
        seeded_uniform(seed, "cell_id") < F.col("p")
    ).drop("p")


def half_limits(cells: DataFrame, keys: list[str], digest: Column) -> DataFrame:
    """For every group the last (digest, cell) of its first half, ``limit``, as stored rows.

    Counts of 256 digest buckets (combined before the shuffle) say in which bucket the middle lies, so only
    that bucket's rows, one in 256, are sorted. ``tied`` says that cells repeated in the group span the limit.
    """
    group = F.struct(F.lit(0).alias("__one"), *keys)
    at = F.struct(digest.alias("digest"), "cell_id")
    marked = cells.select(group.alias("__group"), at.alias("__at"), F.substring(digest, 1, 2).alias("__bucket"))
    whole = W.partitionBy("__group")
    upto, size = F.sum("__rows").over(whole.orderBy("__bucket")), F.sum("__rows").over(whole)
    goal = F.when(F.col("__size") < 2, F.col("__size")).otherwise(F.floor(F.col("__size") / 2))
    middle = (
        marked.groupBy("__group", "__bucket").agg(F.count(F.lit(1)).alias("__rows"))
        .withColumns({"__upto": upto, "__size": size}).withColumn("__take", goal - F.col("__upto") + F.col("__rows"))
        .where((F.col("__take") > 0) & (F.col("__take") <= F.col("__rows"))).select("__group", "__bucket", "__take")
    )
    near = marked.join(cut(middle, "half-middles"), ["__group", "__bucket"])
    within = F.row_number().over(whole.orderBy("__at")) <= F.col("__take")
    ends = near.withColumn("__in", within).groupBy("__group").agg(
        F.max(F.when(F.col("__in"), F.col("__at"))).alias("__limit"), F.min(F.when(~F.col("__in"), F.col("__at"))).alias("__next"))
    return cut(ends.select("__group", "__limit", F.coalesce(F.col("__limit") == F.col("__next"), F.lit(False)).alias("tied")), "half-limits")


def assign_halves(cells: DataFrame, keys: list[str], seed: int = 42) -> DataFrame:
    """50/50 split per group: floor(n/2) first, rest second; groups of one stay first.

    Rows are compared with their group's limit where they lie; only where a cell that is repeated in its
    group spans the limit are all rows ranked. ``cells`` is read three times.
    """
    digest = seeded_digest(seed, *keys, "cell_id")
    limits = half_limits(cells, keys, digest)
    if limits.where("tied").isEmpty():
        group, at = F.struct(F.lit(0).alias("__one"), *keys), F.struct(digest.alias("digest"), "cell_id")
        placed = cells.withColumn("__group", group).join(limits, "__group")
        return placed.select(*cells.columns, F.when(at <= F.col("__limit"), "first_half").otherwise("second_half").alias("half"))
    ranked = hash_rank(cells, keys, digest, ["cell_id"])
    first = (F.col("group_size") < 2) | (F.col("rank") <= F.floor(F.col("group_size") / 2))
    return ranked.withColumn(
        "half", F.when(first, "first_half").otherwise("second_half")
    ).drop("rank", "group_size")


def stratified(cells: DataFrame, per_stratum: int, key: str = "bin", seed: int = 42) -> DataFrame:
    """At most ``per_stratum`` seeded rows per stratum."""
    ranked = hash_rank(cells, [key], seeded_digest(seed, key, "cell_id"), ["cell_id"])
    return ranked.where(F.col("rank") <= per_stratum).drop("rank", "group_size")


def effect_weights(
    deltas: DataFrame, sigma: DataFrame, keys: list[str], alpha: float = 1.0, column: str = "d_all"
) -> DataFrame:
    """Weight per item ~ norm(delta / sigma)^alpha with mean 1; a zero total gives 1 everywhere.

    ``keys`` name the item; ``bin`` and ``ko`` are the last two, the ones before select the fold.
    """
    fold = [k for k in keys if k not in ("bin", "ko")]
    scaled = F.col(column) / F.col("sigma")
    norms = (
        deltas.join(sigma.select(*fold, "gene", "sigma"), [*fold, "gene"])
        .groupBy(*keys)
        .agg(F.pow(F.sqrt(F.sum(scaled * scaled)), F.lit(alpha)).alias("raw"))
    )
    if not fold:
        total, n = scalar(norms.agg(F.sum("raw"))), scalar(norms.agg(F.count(F.lit(1))))
        return norms.withColumn(
            "weight", F.when(total > 0, F.col("raw") * n / total).otherwise(1.0)
        ).drop("raw")
    totals = norms.groupBy(*fold).agg(F.sum("raw").alias("total"), F.count(F.lit(1)).alias("n"))
    return norms.join(totals, fold).select(
        *keys,
        F.when(F.col("total") > 0, F.col("raw") * F.col("n") / F.col("total")).otherwise(1.0).alias("weight"),
    )


#: Items and draws that one task walks along, on average.
WALK = 200_000
#: Stretches whose ends are carried in one window.
LANE = 1024


def weighted_draws(items: DataFrame, key: list[str], n_draws: int, seed: int = 42) -> DataFrame:
    """``n_draws`` weighted draws with replacement, in time linear in items plus draws.

    Items lie on [0, 1) as intervals by running weight (in the order of their digests), draws are seeded
    uniform points. Starts of intervals and points are one sequence: cut into as many stretches as the
    number of rows asks for, a draw takes the last item that starts at or before it in its stretch, or else
    the one with which the stretches before it end. No pair of an item and a draw is compared. Items with a
    weight of zero or NULL are never drawn; without items there are no draws.
    """
    spark = items.sparkSession
    weighted = items.where(F.col("weight") > 0).withColumn("__u", seeded_uniform(seed, *key))
    placed = cut(weighted, "draw_items")
    total, n_items = placed.agg(F.sum("weight"), F.count(F.lit(1))).first()
    stretches = max(1, -(-(n_items + n_draws) // WALK))
    edges = running_sum(placed, [], "__u", "weight", "__to", n_buckets=max(2, min(10_000, n_items // WALK)))
    item = F.struct(*key)
    starts = cut(edges.select(((F.col("__to") - F.col("weight")) / F.lit(total)).alias("at"), F.lit(None).cast("long").alias("draw"), item.alias("item")), "draw_starts")
    points = spark.range(n_draws if n_items else 0).select(
        seeded_uniform(seed + 1, "id").alias("at"), F.col("id").alias("draw"), F.lit(None).cast(starts.schema["item"].dataType).alias("item"))
    stretch = F.least(F.floor(F.col("at") * stretches), F.lit(stretches - 1)).cast("long")
    line = starts.unionByName(points).withColumn("stretch", stretch)
    # one row for each stretch: its last item, carried over the stretches behind it
    ends = starts.withColumn("stretch", stretch).groupBy("stretch").agg(F.max_by("item", "at").alias("end"))
    every = spark.range(stretches).select(F.col("id").alias("stretch")).join(ends, "stretch", "left")
    # stretches are carried in lanes of LANE, and the few lanes (a row for each) after one another
    lane, before = F.floor(F.col("stretch") / LANE), lambda w: w.rowsBetween(W.unboundedPreceding, -1)
    inside = before(W.partitionBy("lane").orderBy("stretch"))
    placed_ends = every.withColumn("lane", lane)
    of_lanes = placed_ends.groupBy("lane").agg(F.max_by("end", F.when(F.col("end").isNotNull(), F.col("stretch"))).alias("lane_end"))
    of_lanes = of_lanes.select("lane", F.last("lane_end", ignorenulls=True).over(before(W.partitionBy(F.lit(0)).orderBy("lane"))).alias("lane_carry"))
    carry = placed_ends.withColumn("carry", F.last("end", ignorenulls=True).over(inside)).join(of_lanes, "lane")
    carry = carry.select("stretch", F.coalesce("carry", "lane_carry").alias("carry"))
    walk = W.partitionBy("stretch").orderBy("at", F.col("draw").asc_nulls_first()).rowsBetween(W.unboundedPreceding, 0)
    held = line.withColumn("own", F.last("item", ignorenulls=True).over(walk)).where(F.col("draw").isNotNull())
    drawn = held.join(carry, "stretch", "left").withColumn("taken", F.coalesce("own", "carry"))
    return drawn.select("draw", "taken.*")
