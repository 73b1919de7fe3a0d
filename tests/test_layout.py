"""Where the rows go: exchanges that plans must not have, ranks, medians and draws at their edges."""

import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from deltascreen.operators import bulk, entries, sampling, scale
from deltascreen.operators.scale import exact_median, hash_rank, order_bits
from deltascreen.plans.registry import all_queries
from deltascreen.sources.testbed import open_testbed

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


@pytest.mark.parametrize("name", ["A1_grouped_sum", "A2_grouped_sum_sq", "A3_pseudobulk", "A3_control_bulk", "A4_deltas", "T4_welch_t", "Q14_moments"])
def test_no_exchange_by_cell(spark, no_broadcast, name):
    open_testbed(spark, SF).stage("sums")
    exchanges = [line for line in plan(all_queries()[name](spark, SF)).splitlines() if "Exchange" in line]
    assert exchanges and not any("cell_id" in line for line in exchanges)


def test_sums_roll_up_to_what_the_join_gives(spark):
    tb = open_testbed(spark, SF)
    direct = bulk.grouped_sum(tb.stage("expr").select("cell_id", "gene", "x"), tb.stage("half_cells"), ["bin", "half"])
    rolled = entries.roll_up(tb.stage("sums"), ["bin", "half"])
    both = direct.join(rolled.select("bin", "half", "gene", F.col("sx").alias("s"), F.col("sxx").alias("q"), F.col("nnz").alias("n")), ["bin", "half", "gene"], "full")
    rows = both.collect()
    assert rows and all(r.nnz == r.n and r.sx == pytest.approx(r.s) and r.sxx == pytest.approx(r.q) for r in rows)


def test_rank_needs_one_exchange_of_the_rows(spark, no_broadcast):
    df = spark.range(1000).select("id", F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("k"), F.lit(None).cast("string").alias("z"))
    ranked = hash_rank(df, ["k", "z"], F.md5(F.col("id").cast("string")), ["id"])
    # of the rows, of their counts twice (by bucket and by group), and of the counts for the join
    assert sum("Exchange hashpartitioning" in line for line in plan(ranked).splitlines()) <= 4
    above = plan(ranked).split("SortMergeJoin")[0]
    assert "Window" in above and "Exchange" not in above
    got = ranked.collect()
    assert len(got) == 1000 and ranked.columns == ["id", "k", "z", "group_size", "rank"]
    for k in (None, 1, 2):
        own = [r for r in got if r.k == k]
        assert sorted(r["rank"] for r in own) == list(range(1, len(own) + 1)) and {r.group_size for r in own} == {len(own)}


def values():
    rng = np.random.default_rng(3)
    odd = [0.0, -0.0, 5e-324, -5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.7976931348623157e308, -1.7976931348623157e308, math.inf, -math.inf, 1.0, 1 - 2**-53, 1 + 2**-52, 8.0, 7.999999999999999, 0.1, 1 / 3]
    odd += [float(2.0**k) for k in range(-1074, 1024, 97)] + [float(np.nextafter(2.0**k, 0)) for k in range(-1000, 1024, 97)]
    return odd + rng.normal(size=200).tolist() + (10 ** rng.uniform(-300, 300, 200)).tolist()


def test_order_bits_are_the_bits(spark):
    v = values()
    got = [r.b for r in order_bits(spark.createDataFrame([(x,) for x in v], "v double"), "v", "b").collect()]
    for x, b in zip(v, got, strict=True):
        whole = struct.unpack("<q", struct.pack("<d", abs(x)))[0]
        assert b == (-whole if x < 0 else whole), x


@pytest.mark.parametrize("n, direct", [(1, 65_536), (2, 0), (7, 0), (200, 65_536), (200, 0), (201, 1)])
def test_medians_of_odd_values(spark, monkeypatch, n, direct):
    monkeypatch.setattr(scale, "DIRECT", direct)
    v = [x for x in values() if abs(x) < 1e200]
    some = [v[i] for i in np.random.default_rng(n).integers(0, len(v), n)]
    df = spark.createDataFrame([(None, x) for x in some] + [("a", 2.0), ("a", None), ("b", None)], "g string, v double")
    got = {r.g: r.median for r in exact_median(df, ["g"], "v").collect()}
    assert got == {None: np.median(some), "a": 2.0}
    assert exact_median(df.where("g IS NULL"), [], "v").collect()[0].median == np.median(some)


@pytest.mark.parametrize("walk", [7, 100_000])
def test_draws_take_the_interval_they_fall_into(spark, monkeypatch, walk):
    monkeypatch.setattr(sampling, "WALK", walk)
    monkeypatch.setattr(sampling, "LANE", 4)
    items = spark.createDataFrame([("a", 1.0), ("b", 1000.0), ("c", 0.0), ("d", None), ("e", 3.0), ("f", 1.0)], "k string, weight double")
    uniform = lambda df, seed, c: {r[0]: r[1] for r in df.select(c, sampling.seeded_uniform(seed, c)).collect()}
    weight, upto, edges = {"a": 1.0, "b": 1000.0, "e": 3.0, "f": 1.0}, 0.0, []
    for k, _ in sorted(((k, u) for k, u in uniform(items, 42, "k").items() if k in weight), key=lambda r: r[1]):
        edges.append((upto / 1005.0, k))
        upto += weight[k]
    points = uniform(spark.range(400), 43, "id")
    want = {i: max(e for e in edges if e[0] <= u)[1] for i, u in points.items()}
    got = {r.draw: r.k for r in sampling.weighted_draws(items, ["k"], 400).collect()}
    assert got == want
    assert sampling.weighted_draws(items.where("weight = 0"), ["k"], 5).count() == 0
