"""All registered queries and their SQL, collected from the section modules."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

SECTIONS = ["retrieval", "library", "source", "chunk", "network", "strategy", "stream", "store"]


def _modules():
    return [importlib.import_module(f"corpusloom.plans.{name}_plans") for name in SECTIONS]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for module in _modules():
        found.update(module.QUERIES)
    return found


def oracles() -> dict[str, str]:
    found: dict[str, str] = {}
    for module in _modules():
        found.update(module.ORACLES)
    return found
