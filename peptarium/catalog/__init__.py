"""Registered queries over the driver tables, each next to its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


@dataclass
class Registry:
    queries: dict[str, Query]
    sql: dict[str, str]

    def add(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def register(fn: Query) -> Query:
            self.queries[name] = fn
            if sql is not None:
                self.sql[name] = sql
            return fn

        return register


REGISTRY = Registry({}, {})


def load() -> Registry:
    from peptarium.catalog import geometry, joins, predicates, scoring, sequences, stats, tables  # noqa: F401

    return REGISTRY
