"""Registry of named queries: Spark builder + (optional) DuckDB oracle SQL.

``__spark_entry__`` exposes this registry to the driver. A query builder takes
``(spark, sf_dir)`` and returns a lazy DataFrame; the oracle is an independent
SQL formulation over the raw driver tables (star views are inlined as CTEs).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    operators: tuple[str, ...]


REGISTRY: dict[str, Query] = {}


def register(name: str, operators: str, sql: str | None = None):
    def deco(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, fn, sql, tuple(operators.split()))
        return fn
    return deco


def load_all() -> dict[str, Query]:
    # importing the modules fills the registry
    from ferret.plans import (  # noqa: F401
        q_corpus,
        q_evaluation,
        q_maintenance,
        q_methodology,
        q_ranking,
        q_report,
        q_sources,
    )
    return REGISTRY
