"""Named queries and their SQL counterparts: name -> callable of (spark, sf_dir), name -> DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with the SQL that gives the same rows if SQL can."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        if f.__name__ in QUERIES:
            raise ValueError(f"a query is registered already: {f.__name__}")
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql.strip()
        return f

    return add


def dispatch(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs a query by name."""
    if name not in QUERIES:
        raise KeyError(f"unknown query: {name}")
    return QUERIES[name](spark, sf_dir)


from storyline.plans import dedup, digest, feed, graph, incremental, remote, stages, stats, tables, texts, vectors  # noqa: E402, F401
