"""All-against-all scores: few copies of a profile are sent, and the bounds lose no pair."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from deltascreen.operators import blocks, discrimination


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def profiles(spark, n=150, seed=3):
    """Vectors of which some are the same or nearly so; names do not follow their order."""
    rng = np.random.default_rng(seed)
    t = np.round(rng.normal(size=(n, 6)), 1)
    t[n // 2:n // 2 + 20] = t[:20]
    p = 0.5 * t + 0.5 * np.roll(t, -1, 0)
    p[-10:] = t[-10:] + 1e-12
    ids = [f"k{(i * 37) % n:03d}" for i in range(n)]
    rows = [(i, a.tolist(), b.tolist()) for i, a, b in zip(ids, p, t)]
    return ids, p, t, spark.createDataFrame(rows, "id string, p array<double>, t array<double>")


def test_profiles_are_sent_a_few_times_only(spark):
    df = spark.range(2000).select(F.col("id").cast("string").alias("id"), F.array(F.col("id") * 1.0).alias("v"))

    def kernel(a, b):
        return pd.DataFrame({"sent": [len(a)], "pairs": [len(a) * len(b)]})

    out = blocks.block_join(df.withColumn("g", F.lit(1)), df.withColumn("g", F.lit(1)), ["g"], kernel, "sent bigint, pairs bigint, g int", 16)
    row = out.agg(F.sum("sent").alias("sent"), F.sum("pairs").alias("pairs")).first()
    assert row.pairs == 2000 * 2000 and row.sent <= 4 * 2000


def brute(ids, p, t, metric):
    s = np.sign if metric == "sign_cosine" else np.asarray
    if "cosine" in metric:
        unit = lambda x: s(x) / (np.sqrt((s(x) ** 2).sum(1)) + 1e-8)[:, None]
        d = 1 - unit(p) @ unit(t).T
    else:
        e = p[:, None] - t[None]
        d = np.abs(e).sum(2) if metric == "l1" else np.sqrt((e * e).sum(2))
    names, own = np.array(ids), np.diag(d)[:, None]
    beats = (names[:, None] != names[None]) & (d < own - 1e-9) | (names[None] < names[:, None]) & (np.abs(d - own) <= 1e-9)
    return (~beats.any(1)).mean()


def test_all_metrics_in_one_join(spark, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK", 16)
    ids, p, t, df = profiles(spark)
    out = discrimination.pds_by_metric(df, [], list(discrimination.METRICS), size=40)
    assert plan_of(out).count("FlatMapCoGroupsInPandas") == 1
    assert {r.metric: r.value for r in out.collect()} == {m: pytest.approx(brute(ids, p, t, m)) for m in discrimination.METRICS}


@pytest.mark.parametrize("metric", ["l1", "l2"])
@pytest.mark.parametrize("scale", [1e-6, 1.0, 1e6])
def test_bounds_keep_every_near_pair(metric, scale):
    rng = np.random.default_rng(5)
    x, y = rng.normal(size=(40, 9)) * scale, rng.normal(size=(60, 9)) * scale
    y[:40] = x + rng.normal(size=(40, 9)) * scale * 1e-3
    e = x[:, None] - y[None]
    d = np.abs(e).sum(2) if metric == "l1" else np.sqrt((e * e).sum(2))
    own = np.median(d, axis=1)
    i, j, found = blocks._near(x, y, own, metric)
    assert set(zip(*np.nonzero(d <= own[:, None]))) <= set(zip(i, j))
    assert found == pytest.approx(d[i, j], rel=1e-12)


def test_energy_distance_in_one_join(spark):
    ids, p, t, df = profiles(spark)
    out = discrimination.energy_distance(df, [], size=40)
    mean = lambda a, b: np.sqrt(((a[:, None] - b[None]) ** 2).sum(2)).mean()
    assert plan_of(out).count("FlatMapCoGroupsInPandas") == 1
    assert out.first().value == pytest.approx(2 * mean(p, t) - mean(p, p) - mean(t, t), abs=1e-11)


def test_nearest_reference_without_a_sort_of_all_candidates(spark):
    ids, p, t, df = profiles(spark)
    out = discrimination.nearest_reference(df.select("id", F.col("p").alias("v")), df.select("id", F.col("t").alias("v")), [])
    assert "Window" not in plan_of(out)
    c = lambda x: x - x.mean(1)[:, None]
    a, b = c(p), c(t)
    sim = np.round(a @ b.T / np.sqrt((a * a).sum(1)[:, None] * (b * b).sum(1)[None] + 1e-8), 9)
    want = {ids[i]: min((-sim[i, j], ids[j]) for j in range(len(ids)))[1] for i in range(len(ids))}
    assert {r.id: r.ref for r in out.collect()} == want
