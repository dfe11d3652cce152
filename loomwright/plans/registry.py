"""All core queries and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomwright.plans import code_queries, insight_queries, integrity_queries, record_queries, reference_queries, relational_queries, scoring_queries, signal_queries, text_queries

_MODULES = (code_queries, insight_queries, integrity_queries, record_queries, reference_queries, relational_queries, scoring_queries, signal_queries, text_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in _MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.ORACLE.items()}
