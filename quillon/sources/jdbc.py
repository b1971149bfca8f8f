"""Tables of a relational database, over JDBC: read in parallel ranges, with filters and columns pushed down; written in batches."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession

from quillon.sources.catalog import Catalog

Result = TypeVar("Result")

#: Rows of a write's batch, seconds that a statement may take, tries after a failure and the seconds between them.
BATCH, TIMEOUT, RETRIES, WAIT = 10_000, 3_600, 3, 5.0


@dataclass
class JdbcStore:
    """A database. driver: the JDBC driver's class, whose jar must be on Spark's class path. ranges: table -> (column, lower bound, upper
    bound, partitions), for tables that are read by more than one task; rows beyond the bounds are read all the same."""

    spark: SparkSession
    url: str
    driver: str | None = None
    properties: dict[str, str] = field(default_factory=dict)
    ranges: dict[str, tuple[str, object, object, int]] = field(default_factory=dict)
    retries: int = RETRIES
    wait: float = WAIT

    def _options(self) -> dict[str, str]:
        out = {"url": self.url, "queryTimeout": str(TIMEOUT), "batchsize": str(BATCH), "fetchsize": str(BATCH)} | self.properties
        return out | ({"driver": self.driver} if self.driver else {})

    def retried(self, run: Callable[[], Result]) -> Result:
        """run(), again after a failure, as often as the store says."""
        for attempt in range(self.retries + 1):
            try:
                return run()
            except Exception:
                if attempt == self.retries:
                    raise
                time.sleep(self.wait)
        raise AssertionError

    def table(self, name: str) -> DataFrame:
        reader = self.spark.read.format("jdbc").options(**self._options()).option("dbtable", name)
        if name in self.ranges:
            column, low, high, n = self.ranges[name]
            reader = reader.options(partitionColumn=column, lowerBound=str(low), upperBound=str(high), numPartitions=str(n))
        return self.retried(reader.load)

    def query(self, sql: str) -> DataFrame:
        """The rows of a statement that the database runs."""
        return self.retried(lambda: self.spark.read.format("jdbc").options(**self._options()).option("query", sql).load())

    def append(self, df: DataFrame, name: str) -> None:
        """Rows added to a table, which is made if it is missing."""
        df.write.format("jdbc").options(**self._options()).option("dbtable", name).mode("append").save()

    def replace(self, df: DataFrame, name: str) -> None:
        """A table's rows replaced; the table itself, with its keys and indexes, stays."""
        df.write.format("jdbc").options(**self._options()).option("dbtable", name).option("truncate", "true").mode("overwrite").save()

    def catalog(self, names: list[str]) -> Catalog:
        """The named tables as a catalog, for sessions; each is looked up when a query first needs it."""
        return Catalog(self.spark, tables={n: (lambda _, n=n: self.table(n)) for n in names})
