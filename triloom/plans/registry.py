"""Registration of example queries: a Spark plan and, where SQL can tell it, its DuckDB twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from triloom.plans.projection import Tables, sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, body: str | None = None, **ctes: str):
    """Registers f(tables) under a name; body is SQL over the domain tables, ctes more of its tables."""

    def add(f: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if body:
            ORACLES[name] = sql(body, **ctes)
        return f

    return add
