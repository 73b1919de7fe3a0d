"""Hard negatives against scores of everything, on ties, repeated vectors, odd rows and many small shards."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from deltascreen.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int, score double, query string, block int, vec string"


def usable(rows):
    best = {}
    for i, x, label in rows:
        if i is None or label is None or x is None or any(v is None or not math.isfinite(v) for v in x):
            continue
        own = (label, [math.floor(256 * float(np.float32(v))) for v in x])
        best[i] = min(best.get(i, own), own)
    return best


def brute(rows, every):
    rows, out = usable(rows), set()
    for a, (label, x) in rows.items():
        if a % every:
            continue
        scored = sorted((-sum(p * q for p, q in zip(x, y, strict=True)), i, lab == label) for i, (lab, y) in rows.items() if i != a and len(y) == len(x))
        for minus, i, _ in [s for s in scored if s[2]][:5]:
            fits = [(-m, j) for m, j, same in scored if not same and 50 * -minus <= 100 * -m <= 95 * -minus]
            out |= {(a, i, rank + 1, j, -minus, score) for rank, (score, j) in enumerate(fits[:3])}
    return out


def found(spark, rows, every):
    df = spark.createDataFrame([(*r, 0.5, "q", 1, "v") for r in rows], SCHEMA)
    got = [tuple(r) for r in negatives.hard_negatives(df, F.col("id") % every == 0).collect()]
    assert len(got) == len(set(got))
    return set(got)


def made(seed, n, dims=6, centres=8):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(centres, dims))
    rows = []
    for i in range(n):
        c = int(rng.integers(centres))
        rows.append((i, [float(v) for v in centre[c] + 0.3 * rng.normal(size=dims)], c % 4 if rng.random() < 0.8 else int(rng.integers(4))))
    return rows


def test_many_shards_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(negatives, "SHARD_ROWS", 60)
    monkeypatch.setattr(negatives, "BLOCK_QUERIES", 10)
    rows = made(1, 500)
    rows += [(1000 + i, rows[7][1], i % 3) for i in range(80)]  # one vector for many ids and labels
    want = brute(rows, 9)
    assert want and found(spark, rows, 9) == want


def test_odd_rows(spark):
    rows = made(2, 60)
    rows += [(100, None, 1), (101, [None] * 6, 1), (102, [float("nan")] * 6, 1), (103, [float("inf")] * 6, 1), (104, [0.0] * 6, 1), (105, [1.0] * 6, None)]
    rows += [(None, [1.0] * 6, 1), (106, [1.0, 2.0], 1), (107, [1.0, 1.7], 2), (108, [1.0, 2.0], 1), (109, [], 1), (110, [], 2), (3, rows[3][1], 2), (3, rows[3][1], 2)]
    want = brute(rows, 2)
    assert any(r[0] == 106 for r in want) and found(spark, rows, 2) == want


def test_large_components_stay_exact(spark):
    rng = random.Random(3)
    rows = [(i, [rng.uniform(2**18, 2**20) for _ in range(4)], i % 2) for i in range(40)]
    assert max(r[4] for r in brute(rows, 4)) > negatives.EXACT
    assert found(spark, rows, 4) == brute(rows, 4)


def test_nothing_to_find(spark):
    assert found(spark, [], 5) == set()
    assert found(spark, made(4, 3), 50) == brute(made(4, 3), 50)
    assert found(spark, [(1, [1.0], 0)], 50) == set()


@pytest.mark.parametrize("n", [1, 63, 64, 65, 1500])
def test_boxes_hold_their_rows(n):
    x = np.random.default_rng(n).integers(-50, 50, (n, 5))
    order, tree = negatives.pack(x)
    assert sorted(order) == list(range(n))
    a = np.array([[3, -2, 0, 5, -7]])
    least, greatest = negatives.bounds(a[0], tree.low, tree.high)
    scores = x[order] @ a[0]
    covered = [(tree.first[i], tree.end[i]) for i in range(tree.leaves)]
    for i in range(tree.leaves, len(tree.low)):
        covered.append((covered[tree.first[i]][0], covered[tree.end[i] - 1][1]))
    assert covered[-1] == (0, n)
    assert all(least[i] <= scores[p:q].min() and scores[p:q].max() <= greatest[i] for i, (p, q) in enumerate(covered))
