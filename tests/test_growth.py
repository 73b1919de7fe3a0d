"""What grows with the tables: rows that are exchanged, rows that one task holds, filters of the medians."""

import math

import pytest
from pyspark.sql import functions as F

from deltascreen.operators import quality, sampling, scale
from deltascreen.operators.scale import exact_median, hash_rank, order_bits, tasks_for
from deltascreen.plans.registry import all_queries
from deltascreen.sources import testbed
from test_layout import SF, no_broadcast, plan  # noqa: F401


def exchanges(df):
    return [line for line in plan(df).splitlines() if "Exchange" in line]


def ranked_halves(cells, keys):
    ranked = hash_rank(cells, keys, sampling.seeded_digest(42, *keys, "cell_id"), ["cell_id"])
    first = (F.col("group_size") < 2) | (F.col("rank") <= F.floor(F.col("group_size") / 2))
    return {(r.cell_id, r.half) for r in ranked.select("cell_id", F.when(first, "first_half").otherwise("second_half").alias("half")).collect()}


def test_halves_are_the_ranked_ones(spark):
    sizes = {("a", "x"): 1, ("a", None): 2, (None, "x"): 3, (None, None): 601, ("b", "x"): 1000}
    rows = [(i * 10_000 + j, *key) for i, (key, n) in enumerate(sizes.items()) for j in range(n)]
    cells = spark.createDataFrame(rows, "cell_id long, bin string, condition string")
    halves = sampling.assign_halves(cells, ["bin", "condition"])
    assert halves.columns == ["cell_id", "bin", "condition", "half"]
    got = halves.collect()
    assert {(r.cell_id, r.half) for r in got} == ranked_halves(cells, ["bin", "condition"]) and len(got) == len(rows)
    for (b, c), n in sizes.items():
        assert sum(r.half == "first_half" for r in got if (r.bin, r.condition) == (b, c)) == max(1, n // 2)


def test_halves_of_repeated_cells(spark):
    cells = spark.createDataFrame([(7, "a")] * 5, "cell_id long, bin string")
    got = [r.half for r in sampling.assign_halves(cells, ["bin"]).collect()]
    assert sorted(got) == ["first_half"] * 2 + ["second_half"] * 3
    assert sampling.assign_halves(cells.where("false"), ["bin"]).count() == 0


def test_halves_do_not_exchange_the_cells(spark):
    cells = scale.cut(spark.range(5000).select(F.col("id").alias("cell_id"), (F.col("id") % 3).cast("string").alias("bin")), "cells")
    assert not any("hashpartitioning" in line for line in exchanges(sampling.assign_halves(cells, ["bin"])))


def test_cells_and_entries_meet_without_an_exchange(spark, no_broadcast):  # noqa: F811
    tb = testbed.Testbed(spark, SF)
    entries, cells = tb.stage("expr"), tb.stage("half_cells")
    assert not exchanges(tb.counts.join(cells, "cell_id")) and not exchanges(entries.join(cells, "cell_id"))
    assert not exchanges(tb.totals)


def test_tasks_grow_with_the_rows(spark):
    n = spark.sparkContext.defaultParallelism
    assert tasks_for(spark, 0) == n and tasks_for(spark, 216_000_000) == 432 and tasks_for(spark, 216_000_001) == 433


def test_completed_cells(spark):
    cells = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "cell_id long, bin string")
    expr = spark.createDataFrame([(1, "g", 2.0), (1, "z", 9.0), (2, "g", 1.0), (2, "h", None), (4, "g", 5.0)], "cell_id long, gene string, x double")
    genes = spark.createDataFrame([("g",), ("h",)], "gene string")
    got = {(r.cell_id, r.bin, r.gene): r.x for r in quality.zero_completed(cells, expr, genes).collect()}
    assert got == {(1, "a", "g"): 2.0, (1, "a", "h"): 0.0, (2, "a", "g"): 1.0, (2, "a", "h"): 0.0, (3, "b", "g"): 0.0, (3, "b", "h"): 0.0}


def test_bulk_agreement_does_not_exchange_completed_cells(spark):
    df = all_queries()["V17_bulk_agreement"](spark, SF)
    assert not any("cell_id" in line for line in exchanges(df))


@pytest.mark.parametrize("direct", [0, 2, 8192])
def test_median_of_equal_and_odd_values(spark, monkeypatch, direct):
    monkeypatch.setattr(scale, "DIRECT", direct)
    median = lambda v: exact_median(spark.createDataFrame([(x,) for x in v], "v double"), [], "v").collect()[0].median
    assert median([0.0, -0.0, 0.0, 5.0]) == 0.0 and median([1.0, 1.0 + 2**-52, 3.0]) == 1.0 + 2**-52
    assert median([-1.0, 1.0]) == 0.0 and math.isnan(median([1.0, math.nan, math.nan])) and median([math.inf, 1.0, -math.inf]) == 1.0


def test_median_filters_the_values_themselves(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(scale, "DIRECT", 0)
    monkeypatch.setattr(scale, "cut", lambda df, name: seen.append(df) or df)
    exact_median(spark.range(100).select((F.col("id") / 7).alias("v")), [], "v").collect()
    whole = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert seen and not any("LOG2" in whole(df) for df in seen)
    assert "LOG2" in whole(order_bits(spark.range(3).select(F.col("id").cast("double").alias("v")), "v", "b"))
