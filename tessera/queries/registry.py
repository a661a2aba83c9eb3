"""Registered queries: a Spark callable and, where SQL can state it, the same query as SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

# Times are UTC. Joins on skewed keys are split at run time, also where a later step of the plan
# would have liked to reuse the partitioning of the join.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def query(sql: str | None = None, use: str = "", name: str | None = None):
    """Register ``fn(spark, sf_dir)`` under its name; ``use`` names the shared SQL tables."""

    def deco(fn):
        key = name or fn.__name__

        @wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            for name, value in SETTINGS.items():
                spark.conf.set(name, value)
            return fn(spark, sf_dir)

        if key in QUERIES:
            raise ValueError(f"{key} is registered twice")
        QUERIES[key] = run
        if sql is not None:
            SQL[key] = with_tables(use, sql)
        return fn

    return deco


def with_tables(use: str, sql: str) -> str:
    from .fixtures import SQL_TABLES

    wanted: list[str] = []

    def need(n: str):
        deps, _ = SQL_TABLES[n]
        for d in deps.split():
            need(d)
        if n not in wanted:
            wanted.append(n)

    for n in use.split():
        need(n)
    parts = ", ".join(f"{n} AS ({SQL_TABLES[n][1]})" for n in wanted)
    if not parts:
        return sql
    # A query with tables of its own continues the same WITH list.
    for head in ("WITH RECURSIVE ", "WITH "):
        if sql.startswith(head):
            return f"WITH RECURSIVE {parts}, {sql[len(head):]}"
    return f"WITH RECURSIVE {parts} {sql}"
