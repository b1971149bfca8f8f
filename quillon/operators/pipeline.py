"""Configured feeds: extract, map, load, aggregate and purge, as a feed's configuration names them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators import etl
from quillon.operators.merge import merge
from quillon.operators.transactions import Snapshots
from quillon.plans.columns import BindError, ref
from quillon.sources.feeds import Configuration
from quillon.streaming.incremental import latest, no_older

Reader = Callable[[SparkSession, dict], DataFrame]


@dataclass
class Feed:
    """One feed. Its configuration: Source (what a reader gets), Table, Keys, Watermark (a time column), Columns (to -> source), Values (column
    -> text -> value), MaximumDays, LateDays and Aggregates (name -> Period, Grain, Measures as name -> [kind, column])."""

    name: str
    config: dict
    readers: dict[str, Reader]
    snapshots: Snapshots

    def extract(self, since: str | None = None) -> DataFrame:
        """The source's rows by the feed's column names; with since, those of LateDays before it and after."""
        source = self.config["Source"]
        if source["Kind"] not in self.readers:
            raise BindError(f"no reader {source['Kind']!r}")
        df = self.readers[source["Kind"]](self.snapshots.spark, source)
        values = self.config.get("Values", {})
        if "Columns" in self.config:
            df = etl.mapped(df, [etl.ColumnMap(to, own, values.get(to, {})) for to, own in self.config["Columns"].items()])
        if since is None:
            return df
        time = ref(self.config["Watermark"])
        mark = F.lit(since).cast(df.schema[self.config["Watermark"]].dataType)
        late = self.config.get("LateDays")
        return df.where(time > (mark - F.make_dt_interval(F.lit(late)) if late else mark))

    def load(self, rows: DataFrame) -> DataFrame:
        """The table after rows are merged in: the newest of each key, and none that is older than the table's."""
        keys, time, table = self.config["Keys"], self.config["Watermark"], self.config["Table"]
        new = latest(rows, keys, time)
        return merge(self.snapshots.read(table), new, keys, condition=no_older(time)) if table in self.snapshots.current()[1] else new

    def purge(self, table: DataFrame) -> DataFrame:
        """The table without what is older than its newest row by more than MaximumDays."""
        days, time = self.config.get("MaximumDays"), self.config["Watermark"]
        if days is None:
            return table
        newest = table.agg((F.max(ref(time)) - F.make_dt_interval(F.lit(days))).alias("m")).scalar()
        return table.where(ref(time) >= newest)

    def aggregates(self, table: DataFrame) -> dict[str, DataFrame]:
        return {name: etl.time_aggregate(table, self.config["Watermark"], a["Period"], a["Grain"], {n: tuple(m) for n, m in a["Measures"].items()}) for name, a in self.config.get("Aggregates", {}).items()}

    def watermark(self) -> str | None:
        table, time = self.config["Table"], self.config["Watermark"]
        if table not in self.snapshots.current()[1]:
            return None
        return self.snapshots.read(table).agg(F.max(ref(time)).cast("string").alias("m")).first()["m"]

    def run(self) -> int:
        """Extract since the watermark, load, purge and aggregate, published as one commit."""
        table = self.purge(self.load(self.extract(self.watermark())))
        self.snapshots.commit({self.config["Table"]: table})
        new = self.aggregates(self.snapshots.read(self.config["Table"]))
        return self.snapshots.commit(new) if new else self.snapshots.current()[0]


@dataclass
class Engine:
    """Runs the feeds of a configuration in the order of their dependencies (DependsOn)."""

    configuration: Configuration
    snapshots: Snapshots
    readers: dict[str, Reader] = field(default_factory=dict)

    def order(self) -> list[str]:
        feeds = {f"{c['Namespace']}.{c['Name']}": c.get("DependsOn", []) for c in self.configuration.of_kind("Feed") if not c.get("Abstract")}
        out: list[str] = []
        while len(out) < len(feeds):
            ready = [n for n, needs in feeds.items() if n not in out and all(x in out for x in needs)]
            if not ready:
                raise BindError(f"feeds depend on each other: {sorted(set(feeds) - set(out))}")
            out += sorted(ready)
        return out

    def run(self) -> list[str]:
        names = self.order()
        for name in names:
            Feed(name, self.configuration.get(name, "Feed"), self.readers, self.snapshots).run()
        return names
