"""The model of the star-schema tables, as the registered queries and the tests use it."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.api import Session
from quillon.model import EntityModel
from quillon.sources.catalog import Catalog

L, I, D, S, N = T.LongType(), T.IntegerType(), T.DoubleType(), T.StringType(), T.TimestampNTZType()  # noqa: E741
SCHEMAS = {
    "region": {"r_regionkey": I, "r_name": S},
    "nation": {"n_nationkey": I, "n_name": S, "n_regionkey": I},
    "customer": {"c_custkey": L, "c_name": S, "c_nationkey": I, "c_acctbal": D, "c_mktsegment": S},
    "supplier": {"s_suppkey": L, "s_name": S, "s_nationkey": I, "s_acctbal": D},
    "part": {"p_partkey": L, "p_name": S, "p_brand": S, "p_type": S, "p_size": I, "p_retailprice": D},
    "orders": {"o_orderkey": L, "o_custkey": L, "o_orderstatus": S, "o_totalprice": D, "o_orderdate": N, "o_orderpriority": S},
    "lineitem": {"l_orderkey": L, "l_partkey": L, "l_suppkey": L, "l_linenumber": I, "l_quantity": D, "l_extendedprice": D, "l_discount": D, "l_tax": D, "l_returnflag": S, "l_linestatus": S, "l_shipdate": N},
    "events": {"event_id": L, "ts": N, "user_id": L, "event_type": S, "value": D, "props": S},
    "documents": {"doc_id": L, "text": S, "lang": S, "source": S, "n_chars": L},
    "labels": {"doc_id": L, "quality": I, "toxic": I},
}


def schema(name: str) -> T.StructType:
    return T.StructType([T.StructField(k, t) for k, t in SCHEMAS[name].items()])


def star_model() -> EntityModel:
    m = EntityModel()
    for name, table, key, entity_set in (
        ("Region", "region", "r_regionkey", "Regions"), ("Nation", "nation", "n_nationkey", "Nations"), ("Customer", "customer", "c_custkey", "Customers"),
        ("Supplier", "supplier", "s_suppkey", "Suppliers"), ("Part", "part", "p_partkey", "Parts"), ("Order", "orders", "o_orderkey", "Orders"),
        ("Document", "documents", "doc_id", "Documents"), ("Label", "labels", "doc_id", "Labels"),
    ):
        m.entity(name, table, schema(table), (key,), entity_set)
    m.entity("LineItem", "lineitem", schema("lineitem"), (), "LineItems")
    m.one("Nation", "Region", "Region", [("n_regionkey", "r_regionkey")], "Nations")
    m.one("Customer", "Nation", "Nation", [("c_nationkey", "n_nationkey")], "Customers")
    m.one("Supplier", "Nation", "Nation", [("s_nationkey", "n_nationkey")], "Suppliers")
    m.one("Order", "Customer", "Customer", [("o_custkey", "c_custkey")], "Orders")
    m.one("LineItem", "Order", "Order", [("l_orderkey", "o_orderkey")], "LineItems")
    m.one("LineItem", "Part", "Part", [("l_partkey", "p_partkey")], "LineItems")
    m.one("LineItem", "Supplier", "Supplier", [("l_suppkey", "s_suppkey")], "LineItems")
    m.one("Label", "Document", "Document", [("doc_id", "doc_id")], "Label", inverse_many=False)
    m.many_to_many("Part", "Suppliers", "Supplier", "lineitem", ("p_partkey", "l_partkey"), ("l_suppkey", "s_suppkey"), "Parts")
    # events by type, as a base type with concrete subtypes; table-per-type: shared columns in one view, own ones in another
    m.entity("Event", None, T.StructType([]), (), "Events", abstract=True)
    base = T.StructType([f for f in schema("events").fields if f.name not in ("value", "props")])
    m.types["Event"].properties = {f.name: _prop(f, f.name == "event_id") for f in base.fields}
    m.types["Event"].table = "event_base"
    for kind in ("click", "view", "purchase"):
        own = [T.StructField("event_id", L)] + ([T.StructField("value", D)] if kind != "view" else [T.StructField("props", S)])
        m.entity(f"{kind.title()}Event", f"event_{kind}", T.StructType(own), ("event_id",), f"{kind.title()}Events", base="Event")
    m.enum("Status", {"O": 0, "F": 1, "P": 2})
    m.enum("Size", {"Small": 1, "Medium": 2, "Large": 4, "Odd": 8}, flags=True)
    return m


def _prop(f: T.StructField, key: bool):
    from quillon.model import Property

    return Property(f.name, f.dataType, key=key)


def star_catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    kind = lambda k, *cols: lambda c: c.table("events").where(F.col("event_type") == k).select(*cols)
    return Catalog(
        spark,
        sf_dir,
        {
            "event_base": lambda c: c.table("events").select("event_id", "ts", "user_id", "event_type"),
            "event_click": kind("click", "event_id", "value"),
            "event_view": kind("view", "event_id", "props"),
            "event_purchase": kind("purchase", "event_id", "value"),
        },
        schemas={name: schema(name) for name in SCHEMAS},
    )


def star_session(spark: SparkSession, sf_dir: str) -> Session:
    return Session(spark, star_model(), star_catalog(spark, sf_dir))
