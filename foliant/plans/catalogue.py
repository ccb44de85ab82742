"""All queries of the core, by name, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

#: Each module has ``queries()`` and ``oracle_sql()``.
MODULES = ("changes_and_trees", "scalars", "retrieval", "structuring", "resolution", "relational", "memory", "reads", "evaluation", "incremental", "storage")


def _merged(what: str) -> dict:
    found: dict = {}
    for name in MODULES:
        own = getattr(import_module(f"foliant.plans.{name}"), what)()
        twice = found.keys() & own.keys()
        assert not twice, f"defined twice: {sorted(twice)}"
        found |= own
    return found


def queries() -> dict[str, Query]:
    return _merged("queries")


def oracle_sql() -> dict[str, str]:
    return _merged("oracle_sql")


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    return queries()["r1_bm25_topk"](spark, folder)
