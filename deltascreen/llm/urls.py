"""URL filter: rules by host and path, and a logistic regression where no rule fits.

The regression reads character n-grams of the host and of the path, hashed to a fixed number of
weights, and is trained from a small table of labelled URLs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deltascreen.llm.common import join_heavy, unused

SIZES = (3, 4, 5)
WEIGHT_BITS = 15
#: Labelled URLs that the regression is fitted on at most (lowest hashes).
MAX_LABELLED = 20_000
EPOCHS, BATCH, RATE, DECAY, SEED = 12, 256, 0.05, 1e-6, 7

#: Fixed values: (verdict, host, path).
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)


def host_of(url: str) -> Column:
    """From after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    host = F.regexp_extract(_rest(url), "^([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: str) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def _rest(url: str) -> Column:
    at = F.instr(F.col(url), "://")
    return F.when(at > 0, F.col(url).substr(at + 3, F.lit(2147483647))).otherwise(F.lit(""))


def apply_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``urls(host, path, ...)`` with ``rule`` and ``rule_verdict`` of the longest rule that fits, else null.

    ``rules(verdict, host, path)`` fit their host and its subdomains where the path starts with
    theirs. Rules are looked up once for each distinct host, by as many of its last labels as some
    rule has; rows of a heavy host are not shuffled.
    """
    most = rules.agg(F.max(F.size(F.split("host", "[.]")))).first()[0] or 1
    listed, chosen = unused("_rules", urls), unused("_best", urls)
    hosts = urls.select("host").distinct()
    names = F.split("host", "[.]")
    tails = F.transform(F.sequence(F.greatest(F.lit(1), F.size(names) - (most - 1)), F.size(names)), lambda i: F.array_join(F.slice(names, i, F.size(names)), "."))
    rule = F.struct((F.length("r_host") + F.length("r_path")).alias("size"), F.concat("r_host", "r_path").alias("rule"), "r_path", "verdict")
    named = rules.select("verdict", F.col("host").alias("r_host"), F.col("path").alias("r_path"))
    fits = hosts.select("host", F.explode(F.array_distinct(tails)).alias("r_host")).join(named, "r_host").groupBy("host").agg(F.collect_list(rule).alias(listed))
    best = F.array_max(F.filter(listed, lambda r: F.startswith(F.col("path"), r["r_path"])))
    joined = join_heavy(urls, fits, "host", "left").withColumn(chosen, best)
    return joined.withColumns({"rule": F.col(f"{chosen}.rule"), "rule_verdict": F.col(f"{chosen}.verdict")}).drop(chosen, listed)


def rule_table(spark, rules=RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "verdict string, host string, path string")


def features(hosts: list[str], paths: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """``(row, weight number)`` of every n-gram; host and path have their own marks at both ends."""
    parts = [b"\x02" + h.encode() + b"\x03\x04" + p.encode() + b"\x05" for h, p in zip(hosts, paths, strict=True)]
    text = np.frombuffer(b"".join(parts), dtype=np.uint8).astype(np.uint64)
    owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    side = 2 * owner + np.concatenate([np.arange(len(p)) > len(h.encode()) + 1 for p, h in zip(parts, hosts, strict=True)] or [np.zeros(0, bool)])
    rows, cells = [np.zeros(0, int)], [np.zeros(0, int)]
    for n in SIZES:
        if len(text) < n:
            continue
        code = np.full(len(text) - n + 1, n, dtype=np.uint64)
        for k in range(n):
            code = code * np.uint64(0x9DDFEA08EB382D69) + text[k : len(text) - n + 1 + k]
        code = code * np.uint64(2) + (side[: len(code)] & 1).astype(np.uint64)
        code = (code ^ (code >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
        whole = side[: len(code)] == side[n - 1 :]
        rows.append(owner[: len(code)][whole])
        cells.append((code >> np.uint64(64 - WEIGHT_BITS)).astype(np.int64)[whole])
    return np.concatenate(rows), np.concatenate(cells)


def scores(weights: np.ndarray, bias: float, hosts: list[str], paths: list[str]) -> np.ndarray:
    """Probability of ``allow`` of each URL."""
    row, cell = features(hosts, paths)
    total = np.bincount(row, weights=weights[cell], minlength=len(hosts))
    count = np.maximum(np.bincount(row, minlength=len(hosts)), 1)
    return 1 / (1 + np.exp(-np.clip(total / np.sqrt(count) + bias, -50, 50)))


def fit(hosts: list[str], paths: list[str], labels: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and bias by adaptive gradient steps over the labelled URLs (label 1: allow)."""
    weights, squares, bias, bias_square = np.zeros(1 << WEIGHT_BITS), np.full(1 << WEIGHT_BITS, 1e-8), 0.0, 1e-8
    if not len(labels):
        return weights, bias
    row, cell = features(hosts, paths)
    order = np.argsort(row, kind="stable")
    row, cell = row[order], cell[order]
    heads = np.searchsorted(row, np.arange(len(labels) + 1))
    rng = np.random.default_rng(SEED)
    for _ in range(EPOCHS):
        shuffled = rng.permutation(len(labels))
        for at in range(0, len(shuffled), BATCH):
            some = shuffled[at : at + BATCH]
            size = heads[some + 1] - heads[some]
            own = np.repeat(np.arange(len(some)), size)
            cells = cell[np.repeat(heads[some] - np.cumsum(size) + size, size) + np.arange(size.sum())]
            root = 1 / np.sqrt(np.maximum(size, 1))
            z = np.bincount(own, weights=weights[cells], minlength=len(some)) * root + bias
            error = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - labels[some]) / len(some)
            slope = np.bincount(cells, weights=(error * root)[own], minlength=len(weights)) + DECAY * weights
            squares += slope * slope
            weights -= RATE * slope / np.sqrt(squares)
            bias_square += error.sum() ** 2
            bias -= RATE * error.sum() / np.sqrt(bias_square)
    return weights, bias


def judge(pages: DataFrame, rules: DataFrame, labelled: DataFrame | None = None, url_col: str = "url", max_labelled: int = MAX_LABELLED) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule``, ``verdict`` and ``score`` (probability of allow).

    The verdict is the rule's, else allow for a score of 0.5 or more. ``labelled(url, verdict)`` trains
    the regression, at most ``max_labelled`` distinct URLs of it by hash; without it, the pages that
    rules decide do. A null url, or one without ``://``, has an empty host and path and the score of
    the bias; so have all URLs if nothing is labelled. Repeated rows come back as often as given. Columns of ``pages``
    with these names are replaced.
    """
    made = ("host", "path", "rule", "rule_verdict", "verdict", "score")
    urls = pages.drop(*[c for c in made if c != url_col]).withColumns({"host": host_of(url_col), "path": path_of(url_col)})
    judged = apply_rules(urls, rules)
    if labelled is None:
        known = judged.select("host", "path", F.col("rule_verdict").alias("verdict"))
    else:
        known = labelled.select(host_of("url").alias("host"), path_of("url").alias("path"), "verdict")
    known = known.where(F.col("verdict").isin("allow", "block")).distinct()
    sample = known.orderBy(F.xxhash64("host", "path"), "host", "path", "verdict").limit(max_labelled).collect()
    weights, bias = fit([r.host for r in sample], [r.path for r in sample], np.array([r.verdict == "allow" for r in sample], dtype=float))

    @F.pandas_udf("double")
    def score(host: pd.Series, path: pd.Series) -> pd.Series:
        return pd.Series(scores(weights, bias, host.tolist(), path.tolist()))

    scored = judged.withColumn("score", score("host", "path"))
    return scored.withColumn("verdict", F.coalesce("rule_verdict", F.when(F.col("score") >= 0.5, "allow").otherwise("block"))).drop("rule_verdict")
