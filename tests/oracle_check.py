"""Run registered queries against their DuckDB oracle: ``python tests/oracle_check.py [sf] [regex]``."""

import math
import re
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def session(cores=8):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    return spark


def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def canonical(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def cell(v):
        if isinstance(v, float):
            if math.isnan(v):
                return "NaN!"
            if v == 0 and math.copysign(1, v) < 0:
                return "-0!"
        return repr(v)

    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def compare(spark, con, sf_dir, fn, sql):
    df = fn(spark, sf_dir)
    got_names = df.columns
    got = canonical([tuple(r) for r in df.collect()], got_names)
    if sql is None:
        return ("rows", f"{len(got)} rows") if got else ("EMPTY", "no rows")
    rel = con.sql(sql)
    want_names = list(rel.columns)
    types = {n: str(t) for n, t in zip(want_names, rel.types)}
    want = canonical(rel.fetchall(), want_names)
    if sorted(got_names) != sorted(want_names):
        return "FAIL", f"columns {sorted(got_names)} vs {sorted(want_names)}"
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
             "boolean": "BOOLEAN"}
    for n, t in df.dtypes:
        if kinds.get(t) != types[n]:
            return "FAIL", f"type {n}: spark {t} duckdb {types[n]}"
    if len(got) != len(want):
        return "FAIL", f"{len(got)} rows vs {len(want)}; e.g. {got[:2]} vs {want[:2]}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return "FAIL", f"{len(bad)}/{len(got)} rows differ {sorted(got_names)}: {bad[:2]}"
    if not got:
        return "EMPTY", "both empty"
    return "ok", f"{len(got)} rows"


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    pattern = re.compile(sys.argv[2] if len(sys.argv) > 2 else ".")
    import __spark_entry__ as e

    sf_dir = f"/root/testdata/sf{sf}"
    spark, con = session(), duck(sf_dir)
    queries, oracles = e.queries(), e.oracle_sql()
    bad = 0
    for name, fn in queries.items():
        if not pattern.search(name):
            continue
        t = time.time()
        try:
            status, note = compare(spark, con, sf_dir, fn, oracles.get(name))
        except Exception as ex:  # noqa: BLE001
            status, note = "ERROR", f"{type(ex).__name__}: {str(ex).split("JVM stacktrace")[0][:700]}"
        bad += status in ("FAIL", "ERROR", "EMPTY")
        print(f"{status:6s} {name:34s} {time.time() - t:6.2f}s {note}", flush=True)
    print(f"{bad} bad")


if __name__ == "__main__":
    main()
