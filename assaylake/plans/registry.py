"""Registered queries of the evidence operators and their DuckDB SQL.

A plan module registers a query by the decorator: its function gets a loader of tables and views and
returns a DataFrame; the SQL beside it says the same over {names}.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from assaylake.plans.bindings import duck, view

FLAGSHIP = "portfolio"
MODULES = ("facts", "screening", "selector", "decision", "gates", "literature", "novelty", "comparison", "controller", "scalars", "claims", "routing", "providers", "sinks")
_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_sql: dict[str, str] = {}


class Tables:
    """Loader of one folder's tables and binding views: t.orders, t.b_screening ..."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return view(self.spark, self.sf_dir, name)


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def register(f: Callable[[Tables], DataFrame]):
        _queries[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql is not None:
            _sql[f.__name__] = duck(sql)
        return f

    return register


def _load() -> None:
    for name in MODULES:
        importlib.import_module(f"assaylake.plans.{name}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_sql)
