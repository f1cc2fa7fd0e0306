"""Every query: a plan over the given tables and, where SQL can say it, its SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Query:
    plan: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


class Book:
    """Collects the queries of one module in definition order."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}

    def query(self, name: str, sql: str | None = None):
        def add(plan):
            self.queries[name] = Query(plan, sql)
            return plan
        return add


MODULES = ["catalog_queries", "library_queries", "ranking_queries", "duplicate_queries", "signal_queries", "feature_queries",
           "file_queries", "stream_queries"]



def all_queries() -> dict[str, Query]:
    out: dict[str, Query] = {}
    for module in MODULES:
        out.update(importlib.import_module(f"cratewise.plans.{module}").BOOK.queries)
    return out
