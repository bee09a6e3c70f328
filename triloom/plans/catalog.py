"""All registered queries over the domain tables, with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from triloom.plans import q_features, q_files, q_identifiers, q_ingest, q_intervals, q_states, q_trees  # noqa: F401  they register
from triloom.plans.projection import Tables
from triloom.plans.registry import ORACLES, QUERIES
from triloom.query import SamplesQuery


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of the samples that have the most frequent variant and lack the second."""
    t = Tables(spark, sf_dir)
    first, second = t.top(2)
    q = SamplesQuery.all(t)
    return (q.hasa(first) & ~q.hasa(second)).features_summary()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
