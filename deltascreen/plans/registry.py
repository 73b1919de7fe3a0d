"""Registered queries: each name has a Spark callable and, where SQL can say it, a DuckDB oracle.

Oracle statements share named CTEs; ``compose`` pulls in only the ones a statement needs.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from deltascreen.sources.testbed import Testbed, open_testbed

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
CTES: dict[str, str] = {}


def cte(name: str, body: str) -> None:
    CTES[name] = body.strip()


def compose(statement: str) -> str:
    """Prefix a statement with the CTEs it reaches, dependencies first."""
    order: list[str] = []

    def visit(text: str, own: str = "") -> None:
        for word in dict.fromkeys(re.findall(r"\b(?:FROM|JOIN)\s+([a-z_0-9]+)\b", text)):
            if word in CTES and word != own and word not in order:
                visit(CTES[word], word)
                order.append(word)

    visit(statement)
    if not order:
        return statement.strip()
    heads = ",\n".join(f"{n} AS MATERIALIZED ({CTES[n]})" for n in order)
    body = statement.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {heads},\n{body[5:]}"
    return f"WITH {heads}\n{body}"


def query(name: str, sql: str | None = None):
    """Register ``fn(testbed) -> DataFrame`` under ``name``."""

    def wrap(fn: Callable[[Testbed], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, sf_dir: fn(open_testbed(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


def r6(column: Column | str, digits: int = 6) -> Column:
    """Rounded double without a negative zero."""
    c = F.col(column) if isinstance(column, str) else column
    return F.round(c.cast("double"), digits) + F.lit(0.0)


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: r6(c, digits) for c in columns})


def long(column: Column | str) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    return c.cast("bigint")


def all_queries():
    _load()
    return dict(QUERIES)


def all_oracles():
    _load()
    return {k: compose(v) for k, v in ORACLES.items()}


def _load() -> None:
    from deltascreen.plans import (  # noqa: F401
        oracle_views,
        queries_bulk,
        queries_labels,
        queries_meta,
        queries_metrics,
        queries_predict,
        queries_quality,
        queries_sources,
        queries_splits,
    )
