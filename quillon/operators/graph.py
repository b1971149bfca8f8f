"""Deep writes: nested JSON-like bodies split into one frame for each table, in the order in which they must be written."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.model import EntityModel, EntityType
from quillon.operators.merge import insert, merge
from quillon.plans.columns import BindError, ref


def shredded(model: EntityModel, t: EntityType, df: DataFrame) -> list[tuple[str, list[str], DataFrame]]:
    """(table, key columns, rows) of nested rows: referenced entities first, then the entity itself by its lineage, then what refers to it.

    Foreign keys come from the nested targets, or go to nested children. Bridge rows of many-to-many navigations come last.
    """
    navs = model.navigations(t)
    before, after = [], []
    for f in df.schema.fields:
        nav = navs.get(f.name)
        if nav is None:
            continue
        target = model.type(nav.target)
        if not nav.many and nav.foreign == "own":
            rows = df.where(ref(f.name).isNotNull()).select(F.col(f"`{f.name}`.*"))
            before += shredded(model, target, rows)
            for a, b in nav.pairs:
                nested = F.col(f"`{f.name}`.`{b}`")
                df = df.withColumn(a, F.coalesce(nested, ref(a)) if a in df.columns else nested)
        else:
            one = F.explode(ref(f.name)) if nav.many else ref(f.name)
            keys = [a for a, _ in nav.pairs]
            rows = df.where(ref(f.name).isNotNull()).select(*[ref(a).alias(f"?{a}") for a in keys], one.alias("?x"))
            flat = rows.select(F.col("`?x`.*"), *[ref(f"?{a}") for a in keys])
            if nav.bridge:
                links = flat.select(*[ref(f"?{a}").alias(c) for a, c in nav.pairs], *[ref(d).alias(c) for c, d in nav.bridge_pairs]).distinct()
                after += shredded(model, target, flat.drop(*[f"?{a}" for a in keys]))
                after.append((nav.bridge, links.columns, links))
            else:
                for a, b in nav.pairs:
                    flat = flat.withColumn(b, ref(f"?{a}"))
                after += shredded(model, target, flat.drop(*[f"?{a}" for a in keys]))
    own, key = [], model.key(t)
    if not key or any(k not in df.columns for k in key):
        raise BindError(f"{t.name} is written by its key {key}")
    for x in model.lineage(t):
        if x.table is None:
            continue
        names = list(dict.fromkeys([*key, *[p for p in (x.properties if x.base or x is not t or t.base else model.properties(t)) if p in df.columns]]))
        own.append((x.table, key, df.select(*names).distinct()))
    return [*before, *own, *after]


def deep_write(model: EntityModel, t: EntityType, df: DataFrame, **options) -> Callable[[dict[str, DataFrame]], dict[str, DataFrame]]:
    """An operation for a transaction that upserts nested rows; properties that a body lacks are left as they are."""

    def run(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
        new: dict[str, DataFrame] = {}
        for table, key, rows in shredded(model, t, df):
            now = new.get(table)
            now = tables[table] if now is None else now
            if table in model.bridges:
                fresh = rows.join(now.select(*rows.columns).distinct(), rows.columns, "left_anti")
                new[table] = insert(now, fresh)
            else:
                known = {p.concurrency: k for k, p in model.properties(t).items() if p.concurrency}
                new[table] = merge(now, rows, key, concurrency=known.get(True) if known.get(True) in rows.columns else None, **options)
        return new

    return run


def body(spark: SparkSession, rows: list[dict] | dict, schema) -> DataFrame:
    """A JSON body, or several, as a frame of a schema."""
    return spark.createDataFrame([rows] if isinstance(rows, dict) else rows, schema)
