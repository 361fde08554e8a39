"""Registry of named queries and the ANSI SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


@dataclass
class Catalog:
    queries: dict[str, Query] = field(default_factory=dict)
    oracles: dict[str, str] = field(default_factory=dict)
    inventory: dict[str, str] = field(default_factory=dict)

    def add(self, name: str, ids: str, sql: str | None = None) -> Callable[[Query], Query]:

        def register(fn: Query) -> Query:
            if name in self.queries:
                raise ValueError(f"duplicate query {name}")
            self.queries[name] = fn
            self.inventory[name] = ids
            if sql is not None:
                self.oracles[name] = sql
            return fn

        return register


catalog = Catalog()
