"""The registered queries of the time-series operators, with DuckDB SQL for those that SQL can express.

The tables of the driver stand for the usual inputs: `events` holds irregular series (dataset: event type, location: a group
of users), `lineitem` and `orders` multi-year daily series and column pairs.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
_MODULES = ("matching", "metrics", "series", "scaling", "frames")


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def register(function: Query) -> Query:
        _QUERIES[function.__name__] = function
        if sql:
            _SQL[function.__name__] = sql
        return function

    return register


def _load() -> None:
    for name in _MODULES:
        importlib.import_module(f"tidemark.plans.queries_{name}")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["collocated_agreement"](spark, sf_dir)


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
