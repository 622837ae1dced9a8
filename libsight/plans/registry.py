"""Registry of named queries and, where SQL can state them, their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from libsight.session import ship
from libsight.sources.fixtures import table, with_views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """Lazy access to input tables: ``t.ticks`` reads the view ``ticks``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = ship(spark), folder

    def __getattr__(self, name: str) -> DataFrame:
        return table(self.spark, self.folder, name)


def query(oracle: str | None = None) -> Callable[[Callable[[Tables], DataFrame]], Query]:
    """Register a query under its function name."""
    def register(fn: Callable[[Tables], DataFrame]) -> Query:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return fn(Tables(spark, folder))

        QUERIES[fn.__name__] = run
        if oracle is not None:
            ORACLES[fn.__name__] = with_views(oracle)
        return run
    return register
