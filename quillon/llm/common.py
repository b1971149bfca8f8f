"""Shared plumbing of the corpus operators: tables, shared storage, code shipping, grouped Arrow streams, components."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from bisect import bisect_right
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PACKAGE = __name__.split(".")[0]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder under spark.checkpoint.dir. Only where that is unset and all of Spark is one process (tests) is a temporary one
    set; on a cluster a folder of one machine would lose data, so that is an error."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or getattr(sc, "_quillon_dir", None)
    if not base:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = sc._quillon_dir = "file://" + tempfile.mkdtemp(prefix=f"{PACKAGE}-")
    return f"{base.rstrip('/')}/{PACKAGE}-{uuid.uuid4().hex}"


def stored(df: DataFrame, path: str, **options: str) -> DataFrame:
    """Write df as Parquet in shared storage and read it back: cuts lineage in a way that survives lost executors."""
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, path: str) -> None:
    """Delete a folder of shared storage through Hadoop's file system."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def ship(spark: SparkSession) -> None:
    """Give executors this package as a zip, so that functions pickled by reference resolve on any cluster."""
    sc = spark.sparkContext
    if getattr(sc, "_quillon_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    out = os.path.join(tempfile.mkdtemp(prefix=f"{PACKAGE}-zip-"), f"{PACKAGE}.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for top, dirs, names in os.walk(os.path.join(root, PACKAGE)):
            dirs[:] = [d for d in dirs if d != "__pycache__"]
            for n in names:
                if n.endswith(".py"):
                    z.write(os.path.join(top, n), os.path.relpath(os.path.join(top, n), root))
    sc.addPyFile(out)
    sc._quillon_shipped = True


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


@contextmanager
def batch_rows(spark: SparkSession, n: int) -> Iterator[None]:
    """Within, Arrow batches to and from Python have n rows at most: for rows that are large, or workers that keep much."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(n, int(before)) if int(before) > 0 else n))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def lean() -> None:
    """In a Python worker: Arrow memory goes back to the system when it is free."""
    pa.set_memory_pool(pa.system_memory_pool())


def per_document(df: DataFrame, make: Callable[[], Callable], schema: str, columns: list[str]) -> DataFrame:
    """mapInArrow with a worker that make() builds once per task; the worker takes a RecordBatch and yields or returns batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for b in batches:
            if b.num_rows:
                yield from work(b)

    return df.select(*columns).mapInArrow(run, schema)


def rows_where(df: DataFrame, make: Callable[[], Callable], columns: list[str]) -> DataFrame:
    """df's rows, all columns as they are, where the predicate that make() builds once per task holds of `columns`' values."""
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holds = make()
        at = [names.index(c) for c in columns]
        for b in batches:
            mask = pa.array([bool(holds(*row)) for row in zip(*(b.column(k).to_pylist() for k in at), strict=True)], pa.bool_())
            yield b.filter(mask)

    return df.mapInArrow(run, df.schema)


def apart(spans: list[tuple[str, int, int]], base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Of spans (kind, start, end) those that overlap none of base's: base is sorted and united once, and each span looked up in it."""
    starts, ends = [], []
    for _, a, e in sorted(base, key=lambda s: s[1]):
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(a)
            ends.append(e)
    at = lambda a: bisect_right(ends, a)  # noqa: E731  the first that ends after a
    return [s for s in spans if (k := at(s[1])) == len(ends) or starts[k] >= s[2]]


def grouped_stream(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Groups of consecutive rows with equal keys, out of batches sorted by them; a group may span batches."""
    open_parts: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(b.schema.get_field_index(k)).to_pylist() for k in keys]
        start = 0
        for i, key in enumerate(zip(*cols, strict=True)):
            if last is not None and key != last:
                if i > start:
                    open_parts.append(b.slice(start, i - start))
                yield pa.Table.from_batches(open_parts)
                open_parts, start = [], i
            last = key
        open_parts.append(b.slice(start))
    if open_parts:
        yield pa.Table.from_batches(open_parts)


#: Edges up to which their vertices' least neighbours are broadcast; beyond it only those of the vertices with most edges are, which are
#: HOT at most.
BROADCAST_EDGES, HOT = 2_000_000, 200_000


def with_least(edges: DataFrame, n: int, path: str) -> DataFrame:
    """Edges (a, b), n of them at most, with m, the least b of each a. No task gets all edges of a vertex that has many."""
    if n <= BROADCAST_EDGES:
        return edges.join(F.broadcast(edges.groupBy("a").agg(F.min("b").alias("m"))), "a")
    edges = stored(edges, f"{path}-edges")
    least = stored(edges.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("edges")), f"{path}-least")
    hot = F.broadcast(least.where(F.col("edges") * HOT >= n).select("a", "m"))
    rest = edges.join(hot, "a", "left_anti").join(least.select("a", "m").hint("merge"), "a")
    return edges.join(hot, "a").unionByName(rest)


def connected(edges: DataFrame, path: str) -> DataFrame:
    """Connected components of edges (a, b): returns (id, root) for every id that is not the least of its component.

    Alternating large-star and small-star steps (Kiveris et al., 2014) on tables in shared storage; the number of steps
    grows with the logarithm of the longest path. Nothing but one checksum a step reaches the driver.
    """
    sums = lambda df: df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
    star = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{path}/cc0")
    before, step = sums(star), 0
    while before["n"]:
        step += 1
        both = with_least(star.union(star.select("b", "a")), 2 * before["n"], f"{path}/large{step}")
        large = both.where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).where("a <> b").distinct()
        small = with_least(large, 2 * before["n"], f"{path}/small{step}").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        star = stored(small.where("a <> b").distinct(), f"{path}/cc{step}")
        after = sums(star)
        for name in (f"cc{step - 1}", *(f"{half}{step}-{kind}" for half in ("large", "small") for kind in ("edges", "least") if before["n"] * 2 > BROADCAST_EDGES)):
            dropped(star.sparkSession, f"{path}/{name}")
        if after == before:
            break
        before = after
    return star.select(F.col("a").alias("id"), F.col("b").alias("root"))
