"""Tables from the model: schemas, creation where missing, columns where missing, and the metadata of keys and indexes."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.model import EntityModel, EntityType
from quillon.plans.columns import ref


@dataclass(frozen=True)
class Index:
    """kind: primary, unique or common. Kept as metadata, which Spark doesn't enforce."""

    name: str
    kind: str
    columns: tuple[str, ...]
    include: tuple[str, ...] = ()


@dataclass
class TableSpec:
    name: str
    schema: T.StructType
    indexes: list[Index] = field(default_factory=list)
    foreign_keys: list[tuple[tuple[str, ...], str, tuple[str, ...]]] = field(default_factory=list)
    partition_by: tuple[str, ...] = ()
    defaults: dict[str, object] = field(default_factory=dict)
    computed: dict[str, str] = field(default_factory=dict)
    identity: str | None = None
    checks: dict[str, str] = field(default_factory=dict)


def stored_type(t: T.DataType) -> T.DataType:
    """Collections of plain values are stored as one string."""
    return T.StringType() if isinstance(t, T.ArrayType) and not isinstance(t.elementType, T.StructType) else t


def flattened(name: str, t: T.DataType) -> list[tuple[str, T.DataType]]:
    """A complex type's fields as columns of its owner: name_field."""
    if isinstance(t, T.StructType):
        return [x for f in t.fields for x in flattened(f"{name}_{f.name}", f.dataType)]
    return [(name, stored_type(t))]


def table_spec(model: EntityModel, t: EntityType) -> TableSpec:
    key = model.key(t)
    fields, defaults, computed, identity = [], {}, {}, None
    own = dict(t.properties) if t.base else model.properties(t)
    for k in key:
        own.setdefault(k, model.properties(t)[k])
    for p in own.values():
        if p.ignored:
            continue
        kind = T.IntegerType() if p.enum else p.type
        for name, x in flattened(p.column, kind):
            fields.append(T.StructField(name, x, not (p.key or p.required), {"max_length": p.max_length} if p.max_length else {}))
        if p.default is not None:
            defaults[p.column] = p.default
        if p.computed:
            computed[p.column] = p.computed
        if p.generated == "identity":
            identity = p.column
    foreign = []
    for n in model.navigations(t).values():
        if n.foreign == "own":
            foreign.append((tuple(a for a, _ in n.pairs), model.type(n.target).table or n.target, tuple(b for _, b in n.pairs)))
    indexes = [Index(f"PK_{t.table or t.name}", "primary", tuple(key))] if key else []
    return TableSpec(t.table or t.name, T.StructType(fields), indexes, foreign, t.partition_by, defaults, computed, identity)


def staging(spec: TableSpec, suffix: str = "_staging") -> TableSpec:
    """The table that rows wait in before a merge: no identity, no keys, and version columns as nullable binary values."""
    versions = {f.name for f in spec.schema.fields if f.metadata.get("rowversion")}
    fields = [T.StructField(f.name, T.BinaryType() if f.name in versions else f.dataType, True) for f in spec.schema.fields]
    return TableSpec(spec.name + suffix, T.StructType(fields))


def create_if_missing(spark: SparkSession, spec: TableSpec) -> None:
    """CREATE TABLE IF NOT EXISTS, with key and index metadata in the table's properties."""
    from pyspark.sql.types import StructType

    cols = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in StructType(spec.schema.fields).fields)
    part = f" PARTITIONED BY ({', '.join(f'`{c}`' for c in spec.partition_by)})" if spec.partition_by else ""
    props = {f"index.{i.name}": f"{i.kind}({','.join(i.columns)})" + (f" include({','.join(i.include)})" if i.include else "") for i in spec.indexes}
    props |= {f"foreign.{k}": f"({','.join(a)}) -> {t}({','.join(b)})" for k, (a, t, b) in enumerate(spec.foreign_keys)}
    tail = f" TBLPROPERTIES ({', '.join(f"'{k}'='{v}'" for k, v in props.items())})" if props else ""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {spec.name} ({cols}) USING parquet{part}{tail}")


def add_missing_columns(spark: SparkSession, spec: TableSpec) -> list[str]:
    have = {c.lower() for c in spark.table(spec.name).columns}
    new = [f for f in spec.schema.fields if f.name.lower() not in have]
    if new:
        spark.sql(f"ALTER TABLE {spec.name} ADD COLUMNS ({', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in new)})")
    return [f.name for f in new]


def prepared(df: DataFrame, spec: TableSpec) -> DataFrame:
    """Rows as the table takes them: defaults for nulls, computed columns, columns in order; a broken check fails when run."""
    for c, v in spec.defaults.items():
        df = df.withColumn(c, F.coalesce(ref(c), F.lit(v)) if c in df.columns else F.lit(v))
    for c, sql in spec.computed.items():
        df = df.withColumn(c, F.expr(sql))
    for name, sql in spec.checks.items():
        df = df.where(F.when(F.coalesce(F.expr(sql), F.lit(True)), F.lit(True)).otherwise(F.raise_error(F.lit(f"check {name} failed")).cast("boolean")))
    return df.select(*[ref(f.name).cast(f.dataType).alias(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in spec.schema.fields])
