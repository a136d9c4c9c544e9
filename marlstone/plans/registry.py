"""Named queries with the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


@dataclass
class Registry:
    queries: dict[str, Query] = field(default_factory=dict)
    oracles: dict[str, str] = field(default_factory=dict)

    def query(self, sql: str | None = None) -> Callable[[Query], Query]:
        """Register a query under the name of its function; ``sql`` is None where SQL cannot express it."""

        def add(f: Query) -> Query:
            name = f.__name__
            if name in self.queries:
                raise ValueError(f"two queries are called {name}")
            self.queries[name] = f
            if sql is not None:
                self.oracles[name] = sql
            return f

        return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
