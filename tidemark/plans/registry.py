"""Registered queries: name -> (Spark builder, DuckDB oracle SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

REGISTRY: dict[str, tuple[QueryFn, str | None, str]] = {}


def query(name: str, sql: str | None = None, ops: str = ""):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name``.

    ``sql`` is the equivalent DuckDB SQL over the raw tables (None when the
    operator has no SQL twin; it is then tested against a brute-force
    restatement in ``tests/``).  ``ops`` lists the inventory ids covered.
    """
    def deco(fn: QueryFn) -> QueryFn:
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = (fn, sql, ops)
        return fn
    return deco


def load_all() -> dict[str, tuple[QueryFn, str | None, str]]:
    from . import q_alarms, q_combine, q_normalize, q_presets, q_series, q_store, q_topology, q_windows  # noqa: F401
    return REGISTRY
