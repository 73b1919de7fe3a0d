"""Scores that compare every profile with every other: rank, discrimination, energy distance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deltascreen.operators import blocks
from deltascreen.operators.scale import scalar


def _schema(df: DataFrame, group: list[str], rest: str) -> str:
    types = dict(df.dtypes)
    return ", ".join([*(f"{g} {types[g]}" for g in group), rest])


def _grouped(df: DataFrame, group: list[str]) -> tuple[DataFrame, list[str]]:
    return (df, group) if group else (df.withColumn("all_rows", F.lit("all")), ["all_rows"])


def cosine_rank(profiles: DataFrame, group: list[str], size: int = blocks.BLOCK) -> DataFrame:
    """Midrank of the own prediction among all predictions, per target, scaled to [0, 1].

    ``profiles`` holds ``id``, ``p`` and ``t`` arrays; 0 is best.
    """
    df, g = _grouped(profiles, group)
    n = df.groupBy(*g).agg(F.count(F.lit(1)).alias("k"))
    units = df.select(*g, "id", blocks.unit(F.col("p")).alias("p"), blocks.unit(F.col("t")).alias("t"))
    left = units.select(*g, "id", F.col("p").alias("v"))
    right = units.select(*g, "id", F.col("t").alias("v"), blocks.dot(F.col("p"), F.col("t")).alias("own"))
    schema = _schema(df, g, "id string, better bigint, equal bigint")
    parts = blocks.block_join(left, right, g, blocks.rank_kernel, schema, size)
    rank = (F.sum("better") + F.sum("equal") / 2.0) / F.greatest(F.first("k") - 1, F.lit(1))
    return parts.join(n, g).groupBy(*group, "id").agg(rank.alias("value"))


METRICS = ("cosine", "l1", "l2", "sign_cosine")


def pds(
    profiles: DataFrame, group: list[str], metric: str = "cosine", size: int = blocks.BLOCK,
) -> DataFrame:
    """Share of profiles whose nearest truth is their own (the first name wins ties)."""
    return pds_by_metric(profiles, group, [metric], size).drop("metric")


def pds_by_metric(profiles: DataFrame, group: list[str], metrics: list[str], size: int = blocks.BLOCK) -> DataFrame:
    """``pds`` of several metrics: profiles meet once for all of them."""
    for metric in metrics:
        if metric not in METRICS:
            raise ValueError(f"unknown metric {metric!r}")
    df, g = _grouped(profiles, group)
    p, t = F.col("p"), F.col("t")
    total = lambda fn: F.aggregate(F.zip_with(p, t, fn), F.lit(0.0), lambda s, v: s + v)
    sign = lambda c: F.transform(c, F.signum)
    own = {
        "cosine": 1.0 - blocks.dot(blocks.unit(p), blocks.unit(t)),
        "sign_cosine": 1.0 - blocks.dot(blocks.unit(sign(p)), blocks.unit(sign(t))),
        "l1": total(lambda a, b: F.abs(a - b)), "l2": F.sqrt(total(lambda a, b: (a - b) * (a - b))),
    }
    left = df.select(*g, "id", p.alias("v"), F.array(*[own[m] for m in metrics]).alias("own"))
    right = df.select(*g, "id", t.alias("v"))
    beats = [f"beats_{m}" for m in metrics]
    schema = _schema(df, g, ", ".join(["id string", *(f"{b} bigint" for b in beats)]))
    parts = blocks.block_join(left, right, g, blocks.nearest_kernel(metrics), schema, size)
    first = parts.groupBy(*g, "id").agg(*[F.sum(b).alias(b) for b in beats]).groupBy(*group).agg(
        *[(F.count_if(F.col(b) == 0) / F.count(F.lit(1))).alias(b) for b in beats])
    cells = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"beats_{m}").alias("value")) for m in metrics])
    return first.select(*group, F.explode(cells).alias("c")).select(*group, "c.metric", "c.value")


def energy_distance(profiles: DataFrame, group: list[str], size: int = blocks.BLOCK) -> DataFrame:
    """2 E|X-Y| - E|X-X'| - E|Y-Y'| with the diagonal included; one profile gives |X-Y|."""
    df, g = _grouped(profiles, group)
    n = df.groupBy(*g).agg(F.count(F.lit(1)).alias("k"))
    both = df.select(*g, "id", "p", "t")
    terms = blocks.block_join(both, both, g, blocks.energy_kernel, _schema(df, g, "total double"), size)
    k2 = F.first("k") * F.first("k")
    # with one profile the self terms are zero and the cross term counts once
    value = F.when(F.first("k") > 1, F.sum("total") / k2).otherwise(F.sum("total") / 2.0)
    return terms.join(n, g).groupBy(*group).agg(value.alias("value"))


def nearest_reference(queries: DataFrame, references: DataFrame, group: list[str]) -> DataFrame:
    """Most correlated reference per query; both sides hold ``id`` and ``v`` arrays."""
    q, g = _grouped(queries.withColumn("v", blocks.centred(F.col("v"))), group)
    r, _ = _grouped(references.withColumn("v", blocks.centred(F.col("v"))), group)
    parts = blocks.block_join(
        q, r, g, blocks.correlation_kernel, _schema(q, g, "id string, ref string, sim double")
    )
    first = F.min(F.struct((-F.round("sim", 9)).alias("far"), "ref", "sim")).alias("b")
    return parts.groupBy(*g, "id").agg(first).select(*group, "id", "b.ref", "b.sim")


def nearest_by_fold(queries: DataFrame, references: DataFrame, n_folds: int, size: int = blocks.BLOCK) -> DataFrame:
    """Most correlated reference of every query in every fold it asks for: ``id, number, ref, sim``.

    Both sides hold one row per profile (``id``, ``place``, ``v``), so every pair is compared once for all folds.
    ``own`` and ``wide`` are a query's folds in which references of its own place or of any place count, ``fits`` a
    reference's folds (bit sets, see ``blocks.fold_bits``). A query without wide folds only meets its own place;
    the others meet the references that fit somewhere where a query asks widely, and those of their own place.
    Ties go to the smallest name. A query with no reference in a fold has no row there.
    """
    every = "*"
    q = queries.withColumn("v", blocks.centred(F.col("v"))).withColumn(
        "pool", F.when(F.exists("wide", lambda w: w != 0), every).otherwise(F.concat(F.lit("="), "place"))
    )
    r = references.withColumn("v", blocks.centred(F.col("v")))
    words = range(max(1, -(-n_folds // blocks.FOLD_BITS)))
    asked = q.where(F.col("pool") == every)
    union = asked.agg(F.array(*[F.coalesce(F.bit_or(F.col("wide")[w]), F.lit(0).cast("bigint")) for w in words]).alias("u"))
    places = asked.select("place").distinct().withColumn("asked", F.lit(True))
    fits = F.exists(F.zip_with("fits", "widely", lambda a, b: a.bitwiseAND(b)), lambda w: w != 0)
    wide = r.join(places, "place", "left").withColumn("widely", scalar(union)).where(F.col("asked") | fits).drop("asked", "widely")
    wide = wide.withColumn("pool", F.lit(every))
    own = r.withColumn("pool", F.concat(F.lit("="), "place"))
    parts = blocks.block_join(
        q, own.unionByName(wide), ["pool"], blocks.by_blocks(blocks.masked_correlation_kernel, size),
        "pool string, id string, ref string, sim double, folds array<int>", size,
    )
    best = parts.select("id", "ref", "sim", F.explode("folds").alias("number")).groupBy("id", "number").agg(
        F.min(F.struct((-F.col("sim")).alias("far"), "ref")).alias("b")
    )
    return best.select("id", "number", F.col("b.ref").alias("ref"), (-F.col("b.far")).alias("sim"))
