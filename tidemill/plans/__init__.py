"""Named queries over a data folder, each with the SQL that states the same result where SQL can."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    """Collects queries and their oracle SQL under one name each."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def __call__(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def add(function: Query) -> Query:
            if name in self.queries:
                raise ValueError(f"query {name} is registered twice")
            self.queries[name] = function
            if sql is not None:
                self.oracles[name] = sql
            return function

        return add


#: Modules with a ``REGISTRY``, in the order their queries are listed.
MODULES = ("events", "funds", "relational", "modeling", "governance", "metrics", "streams")


def registries() -> list[Registry]:
    return [importlib.import_module(f"{__name__}.{name}").REGISTRY for name in MODULES]
