"""Registry of named queries and their reference SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}

_MODULES = (
    "returns",
    "performance",
    "risk",
    "market_features",
    "macro",
    "labels",
    "allocation",
    "selection",
    "resampling",
    "payloads",
    "accounts",
    "options",
    "quality",
    "history",
    "rebalance",
    "streams",
    "structures",
)


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(fn: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"query registered twice: {name}")
        _QUERIES[name] = fn
        if sql is not None:
            _ORACLES[name] = sql
        return fn

    return keep


def _load() -> None:
    for module in _MODULES:
        importlib.import_module(f"tidemark.plans.{module}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLES)
