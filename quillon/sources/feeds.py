"""Feeds: JSON payloads, key-value tables, blob paths by time, CSV out, and configuration with inheritance."""

from __future__ import annotations

import datetime as dt
import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.plans.columns import BindError, ref


def read_payload(spark: SparkSession, payload: str | DataFrame, schema: T.StructType, column: str = "payload") -> DataFrame:
    """Rows of JSON payloads: an array, {"value": [...]} or one object each. A payload of another shape gives no rows.

    payload: one text, or a frame with a payload in each row. Properties that schema lacks are passed over.
    """
    df = spark.createDataFrame([(payload,)], f"`{column}` string") if isinstance(payload, str) else payload
    text = F.trim(ref(column))
    whole = T.StructType([T.StructField("value", T.ArrayType(schema))])
    rows = (
        F.when(text.startswith("["), F.from_json(text, T.ArrayType(schema)))
        .when(F.get_json_object(text, "$.value").startswith("["), F.from_json(text, whole)["value"])
        .when(text.startswith("{"), F.array(F.from_json(text, schema)))
    )
    return df.select(F.explode(rows).alias("?r")).select(F.col("`?r`.*"))


def children(df: DataFrame, nav: str, keys: list[str]) -> DataFrame:
    """A nested navigation's rows, with their owner's keys."""
    many = isinstance(df.schema[nav].dataType, T.ArrayType)
    x = F.explode(ref(nav)) if many else ref(nav)
    return df.where(ref(nav).isNotNull()).select(*[ref(k) for k in keys], x.alias("?r")).select(*[ref(k) for k in keys], F.col("`?r`.*"))


class KeyValueTable:
    """Entities by partition (a type's name) and row key (its key values, comma-joined), as Parquet partitioned by PartitionKey."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    @staticmethod
    def row_key(keys: list[str]):
        return F.concat_ws(",", *[ref(k).cast("string") for k in keys])

    def write(self, df: DataFrame, type_name: str, keys: list[str]) -> None:
        own = df.withColumn("PartitionKey", F.lit(type_name)).withColumn("RowKey", self.row_key(keys))
        own.write.mode("append").partitionBy("PartitionKey").parquet(self.path)

    def scan(self, type_name: str) -> DataFrame:
        return self.spark.read.parquet(self.path).where(F.col("PartitionKey") == type_name).drop("PartitionKey", "RowKey")

    def get(self, type_name: str, *key: Any) -> DataFrame:
        df = self.spark.read.parquet(self.path)
        return df.where((F.col("PartitionKey") == type_name) & (F.col("RowKey") == ",".join(map(str, key)))).drop("PartitionKey", "RowKey")


def key_value_upsert(target: DataFrame, rows: DataFrame, keys: list[str], replace: bool, must_exist: bool = False, must_not_exist: bool = False) -> DataFrame:
    """PUT replaces all columns (those not given become null), PATCH merges the given ones. must_exist (If-Match) updates only,
    must_not_exist (If-None-Match: *) inserts only."""
    from quillon.operators.merge import merge

    if replace:
        for f in target.schema.fields:
            if f.name not in rows.columns:
                rows = rows.withColumn(f.name, F.lit(None).cast(f.dataType))
    return merge(target, rows, keys, insert=not must_exist, update=not must_not_exist)


def blob_path(template: str, at: dt.datetime, prefix: str = "", partition: str = "", every: str = "hour") -> str:
    """{YYYY}{MM}{DD}{HH}{Prefix}{PartitionId} filled in, for the time rounded up to the hour or day."""
    step = {"hour": dt.timedelta(hours=1), "day": dt.timedelta(days=1)}[every]
    floor = at.replace(minute=0, second=0, microsecond=0, **({"hour": 0} if every == "day" else {}))
    t = floor if floor == at else floor + step
    values = {"YYYY": f"{t:%Y}", "MM": f"{t:%m}", "DD": f"{t:%d}", "HH": f"{t:%H}", "Prefix": prefix, "PartitionId": partition}
    for k, v in values.items():
        template = template.replace("{" + k + "}", v)
    return template


def blob_paths(template: str, start: dt.datetime, end: dt.datetime, partitions: list[str], prefix: str = "", every: str = "hour") -> list[str]:
    """Paths of every period from start to before end and every partition."""
    step, out, t = dt.timedelta(hours=1) if every == "hour" else dt.timedelta(days=1), [], start
    while t < end:
        out += [blob_path(template, t, prefix, p, every) for p in partitions]
        t += step
    return list(dict.fromkeys(out))


class Configuration:
    """Named JSON resources, `Namespace.Name`. A resource with a Base takes from it what it doesn't say itself."""

    def __init__(self, resources: list[dict | str]):
        self.by_name: dict[str, dict] = {}
        for r in resources:
            r = json.loads(r) if isinstance(r, str) else r
            self.by_name[f"{r['Namespace']}.{r['Name']}"] = r

    def get(self, name: str, kind: str | None = None, seen: tuple[str, ...] = ()) -> dict:
        if name not in self.by_name:
            raise KeyError(name)
        if name in seen:
            raise ValueError(f"{name} is its own base")
        own = self.by_name[name]
        out = _filled(own, self.get(own["Base"], None, (*seen, name))) if own.get("Base") else dict(own)
        if kind and out.get("Kind") != kind:
            raise ValueError(f"{name} is no {kind}")
        return out

    def of_kind(self, kind: str) -> list[dict]:
        return [r for r in (self.get(n) for n in sorted(self.by_name)) if r.get("Kind") == kind]


def _filled(own: dict, base: dict) -> dict:
    out = dict(base)
    for k, v in own.items():
        out[k] = _filled(v, base[k]) if isinstance(v, dict) and isinstance(base.get(k), dict) else v
    return out


def to_csv(df: DataFrame, path: str, header: bool = True, sep: str = ",", enums: dict[str, dict[str, int]] | None = None) -> None:
    """CSV with quotes where needed, times in UTC, enum texts as their numbers."""
    for c, members in (enums or {}).items():
        pairs = [F.lit(x) for kv in members.items() for x in kv]
        df = df.withColumn(c, F.element_at(F.create_map(*pairs), ref(c)))
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            df = df.withColumn(f.name, F.date_format(ref(f.name), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
        elif isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType)):
            raise BindError(f"{f.name} can't stand in a CSV file")
    df.write.mode("overwrite").option("escape", '"').csv(path, header=header, sep=sep)
