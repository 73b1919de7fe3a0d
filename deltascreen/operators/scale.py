"""Building blocks that keep hot groups distributed.

Nothing here collects a group into one task: ranks, medians and running sums split a group
into buckets, aggregate per bucket, and carry offsets between the buckets.
"""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# parts of an axis that its entries are dealt into when groups are spread over it
LANES = 32
# values of a group that are counted one by one when its median is chosen
DIRECT = 8192
# rows that one task of a large exchange holds
ROWS_A_TASK = 500_000
_LOCAL_ROOT: dict[str, str] = {}


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for written stages; a private one only in local mode when none is set."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    root = spark.conf.get("spark.checkpoint.dir", None) or conf
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_ROOT:
        _LOCAL_ROOT[app] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return _LOCAL_ROOT[app]


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write a stage and read it back: short lineage, real statistics, survives lost executors."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tasks_for(spark: SparkSession, rows: int) -> int:
    """Tasks of an exchange of ``rows`` rows: their number grows with the rows, what one of them holds does not."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // ROWS_A_TASK))


def cut_by(df: DataFrame, name: str, key: str, n: int) -> DataFrame:
    """``cut`` in ``n`` buckets of ``key``: tables cut alike meet on ``key`` without an exchange.

    ``df`` should come in ``n`` partitions by ``key`` already, else every task writes a file a bucket.
    """
    path = fresh_path(df.sparkSession, name)
    table = path.rsplit("/", 1)[-1].replace("-", "_")
    df.write.bucketBy(n, key).sortBy(key).option("path", path).format("parquet").saveAsTable(table)
    return df.sparkSession.table(table)


def scalar(df: DataFrame) -> Column:
    """One-row, one-column frame as a scalar subquery (no join)."""
    return df.scalar()


def spread(groups: DataFrame, axis: DataFrame, name: str, lanes: int = LANES) -> DataFrame:
    """Every group with every entry of an axis of any size.

    Entries are dealt into lanes and every group meets every lane in an equi-join: Spark broadcasts
    a small axis, and a large one is joined lane by lane.
    """
    lane = F.pmod(F.xxhash64(name), F.lit(lanes))
    entries = axis.where(F.col(name).isNotNull()).select(name).distinct().withColumn("__lane", lane)
    every = F.sequence(F.lit(0).cast("bigint"), F.lit(lanes - 1).cast("bigint"))
    return groups.withColumn("__lane", F.explode(every)).join(entries, "__lane").drop("__lane")


def hash_rank(
    df: DataFrame, keys: list[str], digest: Column, tie: list[str], rank: str = "rank", size: str = "group_size",
) -> DataFrame:
    """Exact 1-based rank by a hex digest inside each group, plus the group size.

    A digest is uniform, so its first two digits cut every group, hot ones included, into 256
    equal buckets. Bucket counts (combined before the shuffle) give each bucket its starting rank;
    rows are only sorted inside their bucket. ``df`` is read twice. The keys are held as one struct,
    which is never NULL and equal where NULLs meet, so the join with the counts and the sort inside
    the buckets share one exchange of the rows.
    """
    group = F.struct(F.lit(0).alias("__one"), *keys)
    marked = df.withColumn("__digest", digest).withColumn("__bucket", F.substring("__digest", 1, 2)).withColumn("__group", group)
    whole = W.partitionBy("__group")
    before = whole.orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = (
        marked.groupBy("__group", "__bucket")
        .agg(F.count(F.lit(1)).alias("__rows"))
        .select(
            "__group", "__bucket", F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__start"),
            F.sum("__rows").over(whole).alias(size),
        )
    )
    inside = W.partitionBy("__group", "__bucket").orderBy("__digest", *tie)
    return (
        marked.join(starts, ["__group", "__bucket"])
        .withColumn(rank, F.col("__start") + F.row_number().over(inside))
        .drop("__digest", "__bucket", "__start", "__group")
        .select(*df.columns, size, rank)
    )


def value_buckets(df: DataFrame, keys: list[str], value: str, n_buckets: int = 256) -> DataFrame:
    """Add ``__bucket``: order-preserving, roughly equal buckets of ``value`` within each group.

    Edges are approximate quantiles (a mergeable sketch), so any edge error only changes the
    bucket sizes, never the order.
    """
    probs = F.array(*[F.lit(i / n_buckets) for i in range(1, n_buckets)])
    edges = df.groupBy(*keys).agg(F.percentile_approx(value, probs, F.lit(2000)).alias("__edges"))
    joined = df.join(edges, keys) if keys else df.withColumn("__edges", scalar(edges))
    below = F.size(F.filter("__edges", lambda e: e < F.col(value)))
    return joined.withColumn("__bucket", below).drop("__edges")


def running_sum(
    df: DataFrame, keys: list[str], value: str, amount: str, out: str, n_buckets: int = 256,
    descending: bool = False, how: str = "sum",
) -> DataFrame:
    """Running sum (or min) of ``amount`` in ``value`` order inside each group, bucket by bucket.

    ``value`` has to be distinct within the group.
    """
    fn = {"sum": F.sum, "min": F.min}[how]
    order = (lambda c: F.col(c).desc()) if descending else F.col
    marked = value_buckets(df, keys, value, n_buckets)
    per = marked.groupBy(*keys, "__bucket").agg(fn(amount).alias("__amount"))
    before = W.partitionBy(*keys).orderBy(order("__bucket")).rowsBetween(W.unboundedPreceding, -1)
    carry = per.select(*keys, "__bucket", fn("__amount").over(before).alias("__carry"))
    inside = (
        W.partitionBy(*keys, "__bucket").orderBy(order(value)).rowsBetween(W.unboundedPreceding, 0)
    )
    local = fn(amount).over(inside)
    total = (
        local + F.coalesce("__carry", F.lit(0)) if how == "sum" else F.least(local, F.col("__carry"))
    )
    return (
        marked.join(carry, [*keys, "__bucket"])
        .withColumn(out, total)
        .drop("__bucket", "__carry")
    )


def order_bits(df: DataFrame, value: str, out: str) -> DataFrame:
    """``df`` with the bits of a double as a whole number in the order of the values (zeros are one, NaN comes last).

    Scaling by powers of two is exact, so no bit is lost. The steps are columns of their own, so that none
    is written out more than once in the plan.
    """
    a, one = F.abs(F.col(value)), float(1 << 52)
    special = F.isnan(value) | (a == float("inf"))
    normal = ~special & (a >= 2.2250738585072014e-308)
    two = lambda e: F.pow(F.lit(2.0), e)
    near, safe = F.col("__near"), F.col("__safe")
    # the logarithm is rounded, so beside a power of two it can be one off
    e = F.when(two(near) > safe, near - 1).when((near < 1023) & (two(near + 1) <= safe), near + 1).otherwise(near)
    df = df.withColumn("__safe", F.when(normal, a).otherwise(1.0))
    df = df.withColumn("__near", F.least(F.floor(F.log2("__safe")).cast("double"), F.lit(1023.0))).withColumn("__e", e)
    size = (
        F.when(special, F.lit(2047 << 52) + F.isnan(value).cast("long"))
        .when(normal, (F.col("__e") + 1023).cast("long") * F.lit(1 << 52) + ((safe / two(F.col("__e")) - 1.0) * one).cast("long"))
        .otherwise((F.when(special | normal, 0.0).otherwise(a) / F.lit(5e-324)).cast("long"))
    )
    df = df.withColumn("__size", size).withColumn(out, F.when(F.col(value) < 0, -F.col("__size")).otherwise(F.col("__size")))
    return df.drop("__safe", "__near", "__e", "__size")


def exact_median(df: DataFrame, keys: list[str], value: str, out: str = "median") -> DataFrame:
    """Exact median per group by radix selection on the order-preserving bits of the values.

    A round counts the values by their next 16 bits (combined before the shuffle) and keeps, for each
    group, the at most two prefixes in which the middle lies: at most 131,072 counts a group. Once no
    group's prefixes hold more than ``DIRECT`` values, these are counted by all their bits and the middle is
    there. Only counts are summed in order, group by group. ``df`` is read twice: the first round and the second, which
    writes what is left where that is much. An empty input has no group, or a NULL median where ``keys`` is
    empty. NULLs are left out.
    """
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("__v"))
    if not keys:
        return _one_median(rows, out)
    rows = order_bits(rows, "__v", "__bits")
    before, shift = 64, 48
    middle = _stored_middle(rows, keys, None, before, shift)
    while shift:
        left = middle.agg(F.max(F.col("__m.lo.n") + F.col("__m.hi.n"))).first()[0]
        if left is None:
            break
        before, shift = shift, 0 if left <= DIRECT else shift - 16
        of = middle.select(*[F.col(k).alias(f"__of_{k}") for k in keys], "__m")
        rows = rows.join(of, [F.col(k).eqNullSafe(F.col(f"__of_{k}")) for k in keys])
        rows = rows.where(F.shiftright("__bits", before).isin(F.col("__m.lo.p"), F.col("__m.hi.p"))).select(*keys, "__v", "__bits")
        rows = cut(rows, "median-candidates") if shift else rows
        middle = _stored_middle(rows, keys, middle, before, shift)
    return middle.select(*keys, ((F.col("__m.lo.v") + F.col("__m.hi.v")) / 2.0).alias(out))


def _prefix_counts(rows: DataFrame, keys: list[str], shift: int) -> DataFrame:
    """For every group the count, least and greatest value of every prefix above ``shift``."""
    return rows.groupBy(*keys, F.shiftright("__bits", shift).alias("__p")).agg(
        F.count(F.lit(1)).alias("__n"), F.min("__v").alias("__v"), F.max("__v").alias("__w"))


def _one_median(rows: DataFrame, out: str) -> DataFrame:
    """The rounds for a single group: a round's counts (131,072 rows of four numbers at most) are on the driver.

    What is left is told by its values, which lie between the least and the greatest one of a prefix: a filter
    on the bits would be moved in front of their steps and hold these several times over.
    """
    before, shift, places = 64, 48, None
    while True:
        found = _prefix_counts(order_bits(rows, "__v", "__bits"), [], shift).toArrow().sort_by("__p")
        p, n, v, w = (found.column(c).to_numpy() for c in ("__p", "__n", "__v", "__w"))
        if not len(p):
            return rows.sparkSession.range(1).select(F.lit(None).cast("double").alias(out))
        chosen = []
        for parent, rank in places or [(None, (n.sum() - 1) // 2), (None, n.sum() // 2)]:
            low = 0 if parent is None else int(np.searchsorted(p >> (before - shift), parent))
            upto = np.cumsum(n[low:])
            at = int(np.searchsorted(upto, rank, side="right"))
            chosen.append((int(p[low + at]), int(rank - upto[at] + n[low + at]), float(v[low + at]), int(n[low + at]), float(w[low + at])))
        if not shift:
            return rows.sparkSession.range(1).select(F.lit((chosen[0][2] + chosen[1][2]) / 2.0).alias(out))
        places = [(c[0], c[1]) for c in chosen]
        before, shift = shift, 0 if sum(c[3] for c in chosen) <= DIRECT else shift - 16
        rows = rows.where(F.col("__v").between(chosen[0][2], chosen[0][4]) | F.col("__v").between(chosen[1][2], chosen[1][4]))
        rows = cut(rows, "median-candidates") if shift else rows


def _stored_middle(rows: DataFrame, keys: list[str], last: DataFrame | None, before: int, shift: int) -> DataFrame:
    """For every group the prefixes (all bits above ``shift``) that hold the two middle values, as stored rows."""
    counts = _prefix_counts(rows, keys, shift)
    if last is None:
        whole = W.partitionBy(*keys)
        total = F.sum("__n").over(whole)
        counts = counts.withColumns({"__parent": F.lit(0), "__lo": F.floor((total - 1) / 2), "__hi": F.floor(total / 2)})
        mine = {"__lo": F.lit(True), "__hi": F.lit(True)}
    else:
        of = last.select(*[F.col(k).alias(f"__of_{k}") for k in keys], F.col("__m").alias("__last"))
        counts = counts.join(of, [F.col(k).eqNullSafe(F.col(f"__of_{k}")) for k in keys])
        counts = counts.withColumns({
            "__parent": F.shiftright("__p", before - shift), "__lo": F.col("__last.lo.r"), "__hi": F.col("__last.hi.r")})
        mine = {f"__{w}": F.col("__parent") == F.col(f"__last.{w}.p") for w in ("lo", "hi")}
    run = F.sum("__n").over(W.partitionBy(*keys, "__parent").orderBy("__p").rowsBetween(W.unboundedPreceding, 0))
    counts = counts.withColumn("__upto", run)
    since = F.col("__upto") - F.col("__n")

    def place(rank: str) -> Column:
        here = mine[rank] & (since <= F.col(rank)) & (F.col(rank) < F.col("__upto"))
        one = F.struct((F.col(rank) - since).alias("r"), F.col("__p").alias("p"), F.col("__v").alias("v"), F.col("__n").alias("n"))
        return F.max(F.when(here, one))

    return cut(counts.groupBy(*keys).agg(F.struct(place("__lo").alias("lo"), place("__hi").alias("hi")).alias("__m")), "median-places")


def tile(rank: Column, size: Column, n: int) -> Column:
    """0-based block of a 1-based rank when ``size`` rows form ``n`` near-equal blocks and the
    first ``size % n`` blocks hold one row more."""
    small = F.floor(size / n)
    wide = size % n
    cutoff = wide * (small + 1)
    return F.when(rank <= cutoff, F.floor((rank - 1) / (small + 1))).otherwise(
        wide + F.floor((rank - 1 - cutoff) / F.greatest(small, F.lit(1)))
    ).cast("int")
