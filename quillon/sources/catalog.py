"""Where tables come from: Parquet folders, views over them, registered frames, procedures and shards."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillon.model import EntityModel, EntityType
from quillon.plans.columns import TYPE_NAME, BindError, ref


class Catalog:
    """Tables by name. A table is a DataFrame, a function of this catalog, or a Parquet file or folder under root.

    schemas: those of tables under root that are known, so that planning a query reads no file."""

    def __init__(
        self, spark: SparkSession, root: str | None = None, tables: dict[str, DataFrame | Callable[[Catalog], DataFrame]] | None = None, shard_column: str | None = None, schemas: dict[str, StructType] | None = None
    ):
        self.spark, self.root, self.shard_column, self.schemas = spark, root, shard_column, schemas or {}
        self.tables: dict[str, DataFrame | Callable] = dict(tables or {})
        self.procedures: dict[str, Callable[..., DataFrame | list[DataFrame]]] = {}

    def table(self, name: str, shards: list[int] | None = None) -> DataFrame:
        got = self.tables.get(name)
        if got is None:
            if self.root is None:
                raise BindError(f"no table {name!r}")
            reader = self.spark.read.schema(self.schemas[name]) if name in self.schemas else self.spark.read
            got = reader.parquet(f"{self.root}/{name}.parquet")
        df = got(self) if callable(got) else got
        if shards is not None and self.shard_column and self.shard_column in df.columns:
            df = df.where(ref(self.shard_column).isin(*shards))  # a partition column: other shards aren't listed
        return df

    def procedure(self, name: str, f: Callable[..., DataFrame | list[DataFrame]]) -> None:
        """f(spark, **parameters) gives a DataFrame, or several."""
        self.procedures[name.lower()] = f

    def call(self, name: str, **parameters) -> DataFrame | list[DataFrame]:
        if name.lower() not in self.procedures:
            raise BindError(f"no procedure {name!r}")
        return self.procedures[name.lower()](self.spark, **parameters)


class Stores:
    """Named catalogs, as `store=` picks them; the first is the default."""

    def __init__(self, **catalogs: Catalog):
        self.catalogs = catalogs

    def pick(self, name: str | None) -> Catalog:
        if name is None:
            return next(iter(self.catalogs.values()))
        if name not in self.catalogs:
            raise BindError(f"no store {name!r}")
        return self.catalogs[name]


def scan(model: EntityModel, catalog: Catalog, t: EntityType, only: set[str] | None = None, shards: list[int] | None = None) -> DataFrame:
    """Rows of an entity type, columns by property name.

    A derived type's table is joined to its bases' on the key. A type with subtypes is the union of its concrete ones,
    columns aligned and padded with nulls, with the type's name in $TypeName; `only` names the branches to read.
    """
    if not model.is_polymorphic(t):
        return _one_type(model, catalog, t, shards)
    branches = [x for x in model.subtypes(t) if only is None or x.name in only]
    if not branches:
        return scan(model, catalog, t, None, shards).where(F.lit(False))
    frames = [_one_type(model, catalog, x, shards).withColumn(TYPE_NAME, F.lit(x.name)) for x in branches]
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return out.select(*sorted(out.columns, key=lambda c: (c == TYPE_NAME, c)))


def _one_type(model: EntityModel, catalog: Catalog, t: EntityType, shards: list[int] | None) -> DataFrame:
    key, out = model.key(t), None
    for x in model.lineage(t):
        if x.table is None:
            continue
        df = catalog.table(x.table, shards)
        own = {p.column: p.name for p in x.properties.values()}
        names = [c for c in df.columns if c in own or out is None or c not in out.columns and c not in key]
        df = df.select(*[ref(c).alias(own.get(c, c)) for c in dict.fromkeys([*names, *[c for c in df.columns if own.get(c, c) in key]])])
        out = df if out is None else out.join(df, key, "inner")
    if out is None:
        raise BindError(f"{t.name} has no table")
    ignored = [p.name for x in model.lineage(t) for p in x.properties.values() if p.ignored]
    return out.drop(*ignored)
