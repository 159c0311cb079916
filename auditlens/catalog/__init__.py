"""Named queries over the star-schema and text tables, each with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Catalog:
    """Queries by name; ``sql`` holds the equivalent statement of those that have one."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def query(self, sql: str | None = None) -> Callable[[Query], Query]:
        def register(function: Query) -> Query:
            name = function.__name__
            if name in self.queries:
                raise ValueError(f"two queries named {name}")
            self.queries[name] = function
            if sql is not None:
                self.sql[name] = sql
            return function

        return register


CATALOG = Catalog()


def load_all() -> Catalog:
    """The catalog with every query module imported."""
    from . import detectors, evaluation, features, flows, sampling, sets, sources, streams, text  # noqa: F401

    return CATALOG
