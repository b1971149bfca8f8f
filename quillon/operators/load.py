"""Bulk loads into published tables: append, and load-and-merge by way of a staging folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame

from quillon.model import EntityModel, EntityType
from quillon.operators.ddl import prepared, staging, table_spec
from quillon.operators.merge import insert, merge
from quillon.operators.transactions import Snapshots, Transaction
from quillon.plans.columns import BindError, ref


def bulk_load(snapshots: Snapshots, model: EntityModel, t: EntityType, rows: DataFrame) -> int:
    """Appends rows to the type's table, which is made if it is missing; defaults, computed columns and identities are filled in.

    Rows aren't held against the key: that is load_and_merge's work. Returns the commit's number.
    """
    spec = table_spec(model, t)
    fresh = prepared(rows, spec)
    if spec.name in snapshots.current()[1]:
        now = snapshots.read(spec.name)
    else:
        now = snapshots.spark.createDataFrame([], spec.schema)
    return snapshots.commit({spec.name: insert(now, fresh, spec.identity)}, {spec.name: list(spec.partition_by)})


@contextmanager
def staged(snapshots: Snapshots, rows: DataFrame, name: str) -> Iterator[DataFrame]:
    """rows, written once to a staging folder beside the tables and read from there; the folder goes at the end."""
    path = f"{snapshots.root}/{name}/{uuid.uuid4().hex}"
    rows.write.parquet(path)
    try:
        yield snapshots.spark.read.schema(rows.schema).parquet(path)
    finally:
        at = snapshots.path(path)
        snapshots.fs.delete(at, True)


def load_and_merge(snapshots: Snapshots, model: EntityModel, t: EntityType, rows: DataFrame, **options) -> int:
    """Upserts rows by the type's key. They are staged first, in the staging table's form (no identity, no keys, version columns as
    nullable binary), so that a source is read once however often the merge looks at it. options: those of merge."""
    spec, key = table_spec(model, t), model.key(t)
    if not key:
        raise BindError(f"{t.name} has no key to merge on")
    form = staging(spec)
    names = [f.name for f in form.schema.fields if f.name in rows.columns]
    kinds = {f.name: f.dataType for f in form.schema.fields}
    with staged(snapshots, rows.select(*[ref(c).cast(kinds[c]).alias(c) for c in names]), form.name) as source:
        if spec.name in snapshots.current()[1]:
            now = snapshots.read(spec.name)
        else:
            now = snapshots.spark.createDataFrame([], spec.schema)
        return snapshots.commit({spec.name: merge(now, source, key, **options)}, {spec.name: list(spec.partition_by)})


def load_all(snapshots: Snapshots, steps: list[Callable[[dict[str, DataFrame]], dict[str, DataFrame]]]) -> int:
    """Several loads and other operations, in order, published together or not at all."""
    transaction = Transaction(snapshots)
    for step in steps:
        transaction.add(step)
    return transaction.save_changes()


def upsert_step(model: EntityModel, t: EntityType, rows: DataFrame, **options) -> Callable[[dict[str, DataFrame]], dict[str, DataFrame]]:
    """A step of load_all that upserts rows by the type's key."""
    table, key = table_spec(model, t).name, model.key(t)
    return lambda tables: {table: merge(tables[table], rows, key, **options)}
