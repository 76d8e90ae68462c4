"""Queries over the given tables, each with the SQL it is checked against.

The tables hold no images, so each query derives its manifest from them:

``img``    one image per embedding, 64-dimensional vectors tilted by place;
``shots``  one image per (order, line) of lineitem, without vectors;
``metric`` evaluation results from events.
"""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

_MODULES = (
    "scalars", "readers", "assignment", "curating", "retrieving", "batching", "profiling", "reporting",
)


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under *name*, with its oracle if SQL can express it."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise KeyError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def load_all() -> None:
    for module in _MODULES:
        import_module(f"registry.{module}")
