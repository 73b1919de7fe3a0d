"""Gates count roles by group: no row per cell and fold is sent through a shuffle."""

import pytest
from pyspark.sql import functions as F

from deltascreen.operators import quality, splits

CELLS = [(i, f"b{i % 2}", ["control", "A", "B", "C"][i % 4]) for i in range(80)]
ROLES = [("S", f, b, k, ["train", "val", "test"][(f + j) % 3]) for f in (0, 1) for b in ("b0", "b1") for j, k in enumerate("ABC")]


@pytest.fixture(scope="module")
def tables(spark):
    cells = spark.createDataFrame(CELLS, "cell_id long, bin string, condition string")
    return cells, spark.createDataFrame(ROLES, "scenario string, fold int, bin string, ko string, label string")


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_carried_groups_give_the_same_gates(spark, tables):
    cells, split = tables
    plain, carried = splits.cell_labels(cells, split), splits.cell_labels(cells, split, carry=("bin", "condition"))
    x = spark.createDataFrame([(0.0,), (2.0,)], "x double")
    for gate in (lambda c: quality.leak_gate(cells, c), lambda c: quality.preflight(cells, c, x), lambda c: splits.grid_from_cells(cells, c),
                 lambda c: splits.condition_lists(cells, c)):
        assert sorted(map(repr, gate(plain).collect())) == sorted(map(repr, gate(carried).collect()))
    # a label that both trains and tests is seen in either form
    both = split.unionByName(split.where("ko = 'A'").withColumn("label", F.lit("test")))
    for carry in ((), ("bin", "condition")):
        rows = quality.leak_gate(cells, splits.cell_labels(cells, both, carry)).collect()
        assert sum(r.n_leaked for r in rows) >= 1 and not all(r.ok for r in rows)


def test_no_gate_meets_cells_again(tables):
    cells, split = tables
    carried = splits.cell_labels(cells, split, carry=("bin", "condition"))
    for found in (splits.grid_from_cells(cells, carried), splits.condition_lists(cells, carried), splits.with_groups(carried, cells, ["bin"])):
        assert plan_of(found).count("Join") == plan_of(carried).count("Join")
    # what the gate itself reads is the small stored table of counts
    assert "cell_id" not in plan_of(quality.leak_gate(cells, carried))
