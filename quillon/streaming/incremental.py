"""Incremental refresh: a keyed cache brought up to date from what changed since a watermark, in batches or from a stream."""

from __future__ import annotations

import json
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillon.operators.merge import merge
from quillon.operators.transactions import Snapshots
from quillon.plans.columns import ref


def latest(df: DataFrame, keys: list[str], time: str) -> DataFrame:
    """The last version of each key; of equal times the greatest row by its other columns. A partial aggregate, no window."""
    rest = [c for c in df.columns if c not in keys and c != time]
    best = F.max(F.struct(ref(time), *[ref(c) for c in rest])).alias("?b")
    got = df.groupBy(*[ref(k) for k in keys]).agg(best)
    return got.select(*[ref(c) if c in keys else F.col(f"`?b`.`{c}`").alias(c) for c in df.columns])


def no_older(time: str) -> Column:
    """For merge: a matched row gives way to one that isn't older than it, so that a late row never replaces a newer one."""
    return ref(time).isNull() | (ref(f"?s.{time}") >= ref(time))


class Cache:
    """A cached table with its watermark, in versioned snapshots.

    load(since) gives rows written after since, or all for None. A refresh reads the chunks, at most `workers` at once, retries failing
    ones, upserts and promotes the watermark; when a chunk fails for good, what succeeded is kept but the watermark stays, so that
    it is read again. Watermarks are compared in the type of the time column. Rows older than the cached one of their key are
    left out. late: an interval, such as "2 days", by which since lies before the watermark, for rows that arrive late;
    maximum_days: rows that are older than the newest by more are dropped.
    """

    def __init__(
        self, spark: SparkSession, root: str, name: str, keys: list[str], time: str, retries: int = 3, full_every: int | None = None, workers: int = 16, late: str | None = None, maximum_days: int | None = None
    ):
        self.spark, self.name, self.keys, self.time, self.retries, self.full_every = spark, name, keys, time, retries, full_every
        self.workers, self.late, self.maximum_days = workers, late, maximum_days
        self.snapshots = Snapshots(spark, root)
        self.frame: DataFrame | None = None

    def state(self) -> dict:
        try:
            row = self.snapshots.read(f"{self.name}_state").first()
            return json.loads(row["state"]) if row else {}
        except KeyError:
            return {}

    @property
    def initialized(self) -> bool:
        return "watermark" in self.state()

    def refresh(self, loaders: list[Callable[[str | None], DataFrame]]) -> list[Exception]:
        """Loads that failed for good; empty if all went well."""
        state = self.state()
        n = state.get("refreshes", 0)
        full = "watermark" not in state or bool(self.full_every) and n % self.full_every == 0
        since = None if full else self._since(state["watermark"])

        def loaded(load) -> DataFrame | Exception:
            for attempt in range(self.retries):
                try:
                    df = load(since)
                    df.agg(F.max(ref(self.time))).first()
                    return df
                except Exception as x:  # what a source may raise isn't known here; it is given back
                    error = x
            return error

        with ThreadPoolExecutor(max(1, min(self.workers, len(loaders)))) as pool:
            results = list(pool.map(loaded, loaders))
        got, failed = [x for x in results if isinstance(x, DataFrame)], [x for x in results if not isinstance(x, DataFrame)]
        if got:
            new = got[0]
            for df in got[1:]:
                new = new.unionByName(df, allowMissingColumns=True)
            new = latest(new, self.keys, self.time)
            kind = new.schema[self.time].dataType
            top = new.agg(F.greatest(F.max(ref(self.time)), F.lit(state.get("watermark")).cast(kind)).cast("string").alias("m")).first()["m"]
            table = new if full and not failed or self.name not in self.snapshots.current()[1] else merge(self.snapshots.read(self.name), new, self.keys, condition=no_older(self.time))
            state["refreshes"] = n + 1
            if top is not None and not failed:
                state["watermark"] = top
            if self.maximum_days is not None and top is not None:
                table = table.where(ref(self.time) >= F.lit(top).cast(kind) - F.make_dt_interval(F.lit(self.maximum_days)))
            self.snapshots.commit({self.name: table, f"{self.name}_state": self.spark.createDataFrame([(json.dumps(state),)], "state string")})
            self.frame = None
        return failed

    def _since(self, watermark: str) -> str:
        if not self.late:
            return watermark
        return self.spark.range(1).select((F.lit(watermark).cast("timestamp_ntz") - F.expr(f"interval {self.late}")).cast("string")).first()[0]

    def rows(self) -> DataFrame:
        if self.frame is None:
            self.frame = self.snapshots.read(self.name).cache()
        return self.frame

    def get(self, *key) -> DataFrame:
        cond = F.lit(True)
        for k, v in zip(self.keys, key, strict=True):
            cond = cond & (ref(k) == F.lit(v))
        return self.rows().where(cond)

    def search(self, predicate: Callable[[DataFrame], DataFrame]) -> DataFrame:
        return predicate(self.rows())


def refresh_stream(stream: DataFrame, snapshots: Snapshots, table: str, keys: list[str], time: str, checkpoint: str) -> StreamingQuery:
    """Upserts a stream's micro-batches into a snapshot table. The batch's number is kept with the table, so that a batch that is
    given again after a failure isn't merged twice."""
    spark = stream.sparkSession

    def upsert(df: DataFrame, epoch: int) -> None:
        versions = snapshots.current()[1]
        done = f"{table}_epoch"
        if done in versions and snapshots.read(done).first()["epoch"] >= epoch:
            return
        new = latest(df, keys, time)
        out = merge(snapshots.read(table), new, keys, condition=no_older(time)) if table in versions else new
        snapshots.commit({table: out, done: spark.createDataFrame([(epoch,)], "epoch long")})

    return stream.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def newest_per_key(df: DataFrame, keys: list[str], time: str, n: int) -> DataFrame:
    """The n newest rows of each key, by a window that Spark limits before it sorts whole groups."""
    w = Window.partitionBy(*[ref(k) for k in keys]).orderBy(ref(time).desc())
    return df.withColumn("?n", F.row_number().over(w)).where(ref("?n") <= n).drop("?n")
