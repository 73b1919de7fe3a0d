"""Headline queries, timed one by one; prints one JSON line.

A run starts from the given parquet tables. The stored tables that operators share are built once
and reported as ``stage_*``; every query then reads them, as a deployed run does. The value is the
sum of both, so no work is left out.
"""

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = [
    "Q6_normalise", "Q9_mito_threshold", "Q11_qc_audit", "D1_downsample", "D3_half_split", "A3_pseudobulk",
    "A4_deltas", "T1_rank_test", "T4_welch_t", "T6_bh_pooled", "Q14_hvg", "X5_UnseenPair", "P19_Interp_duplicate",
    "M10_cosine_rank", "M21_score_all", "B3_captured_fraction", "V21_leak_gate", "flagship_unseen_pert",
]


STAGES = ["genes", "counts", "qc_cells", "half_cells", "expr", "sums", "ctrl", "bulk", "deltas", "deg", "weights",
          "pair_split", "rect"]


def main() -> None:
    from pyspark.sql import SparkSession

    from deltascreen.plans import registry
    from deltascreen.sources import testbed

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    queries = registry.all_queries()
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr("sum(l_quantity)").collect()
    wanted = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    seconds = {}
    testbed.forget()
    tables = testbed.open_testbed(spark, sf_dir)
    for name in STAGES:
        start = time.perf_counter()
        tables.stage(name)
        seconds[f"stage_{name}"] = round(time.perf_counter() - start, 3)
    for name in wanted:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": sf_dir.rsplit("sf", 1)[-1],
    }))
    spark.stop()


if __name__ == "__main__":
    main()
