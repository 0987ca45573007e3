"""All reference queries with their SQL oracles, gathered from the plan modules."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

MODULES = ("temporal", "relational", "derive", "vector", "graph", "text", "streams", "extra", "match", "parsed")


def _modules():
    return [importlib.import_module(f"graphloom.plans.{name}") for name in MODULES]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for module in _modules():
        found |= {name: spec[0] for name, spec in module.QUERIES.items()}
    return found


def oracle_sql() -> dict[str, str]:
    found: dict[str, str] = {}
    for module in _modules():
        found |= {name: spec[1] for name, spec in module.QUERIES.items() if spec[1]}
    return found
