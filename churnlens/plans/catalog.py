"""Registered queries: name -> (Spark callable(spark, sf_dir), DuckDB oracle SQL or None).

Each callable reads the driver's tables (through the S / R fixtures) and
returns a DataFrame whose column names equal the oracle's. Sections follow
``None`` as SQL (rows-only check) and are covered by tests instead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[Query, str | None]] = {}


def register(name: str, sql: str | None):
    def deco(fn: Query) -> Query:
        if name in REGISTRY:
            raise KeyError(f"duplicate query {name}")
        REGISTRY[name] = (fn, sql)
        return fn
    return deco


def load_all() -> dict[str, tuple[Query, str | None]]:
    # importing the section modules fills REGISTRY
    from churnlens.plans import (  # noqa: F401
        q_charts,
        q_choice,
        q_decision,
        q_dirty,
        q_explore,
        q_metrics,
        q_ml,
        q_quality,
        q_selection,
        q_sources,
    )
    return REGISTRY
