"""The queries of the engine's own operators and their SQL; modules add themselves to ``MODULES``."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

MODULES = ["cells", "store", "files", "more"]


def all_queries() -> dict[str, Query]:
    return {k: q for m in MODULES for k, q in import_module(f"siftlake.plans.{m}").QUERIES.items()}


def all_sql() -> dict[str, str]:
    return {k: q for m in MODULES for k, q in import_module(f"siftlake.plans.{m}").SQL.items()}
