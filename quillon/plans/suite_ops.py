"""Registered queries of what acts on stores: services, deep writes, loads, key-value tables, schemas, shards, caches, digests."""

from __future__ import annotations

import datetime as dt
import tempfile
import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.api import Session, union
from quillon.functions.memory import compiled
from quillon.functions.scalar import Udfs
from quillon.lang.parser import parse_url
from quillon.lang.unparse import from_xml, to_xml
from quillon.lang.unparse import url as written
from quillon.model import EntityModel
from quillon.operators import ddl, etl, graph, joins, load, merge, shards
from quillon.operators.pipeline import Engine
from quillon.operators.transactions import ChangeSet, Snapshots, Transaction, run_batch
from quillon.plans.star import star_catalog, star_model, star_session
from quillon.plans.suite import made, url
from quillon.service import Service
from quillon.sources.catalog import Catalog, Stores
from quillon.sources.feeds import Configuration, KeyValueTable, blob_paths, key_value_upsert, to_csv
from quillon.streaming.incremental import Cache


def scratch(spark: SparkSession) -> str:
    """A fresh folder in shared storage, spark.checkpoint.dir; a temporary one only where all of Spark is one process."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder")
        base = "file://" + tempfile.mkdtemp(prefix="quillon-")
    return f"{base.rstrip('/')}/suite-{uuid.uuid4().hex}"


def stored_star(spark: SparkSession, sf_dir: str, *names: str) -> tuple[Snapshots, Session]:
    """Snapshots of some tables of the star model, and a session over them."""
    snaps = Snapshots(spark, scratch(spark))
    snaps.commit({n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names})
    return snaps, Session(spark, star_model(), Catalog(spark, sf_dir, {n: (lambda c, n=n: snaps.read(n)) for n in names}))


_SUPPLIER = T.StructType([T.StructField("s_name", T.StringType()), T.StructField("s_acctbal", T.DoubleType())])


# -- services, batches, transactions ----------------------------------------------------------------------------------------
@made(
    "service_verbs",
    "select s_suppkey, case when s_suppkey = 2 then 'Two' else s_name end as s_name, case when s_suppkey = 2 then 5.0 else s_acctbal end as s_acctbal from supplier where s_suppkey <> 3 union all select 900001, 'New', 1.5",
)
def service_verbs(spark, sf_dir):
    snaps, session = stored_star(spark, sf_dir, "supplier")
    svc = Service(session, snaps)
    svc.upsert("/Suppliers(2)", {"s_name": "Two", "s_acctbal": 5.0}, _SUPPLIER, verb="PATCH")
    svc.upsert("/Suppliers(900001)", {"s_name": "New", "s_acctbal": 1.5}, _SUPPLIER)
    svc.delete("/Suppliers(3)")
    return svc.get("/Suppliers?$select=s_suppkey,s_name,s_acctbal")


@made("service_allowed", "select r_name as said from region where r_regionkey < 0 union all select 'where may not use [''r_name'']'")
def service_allowed(spark, sf_dir):
    """A `where` over a property that isn't allowed is refused; the observer is told why."""
    told: list[dict] = []
    svc = Service(star_session(spark, sf_dir), Snapshots(spark, scratch(spark)), {"Regions": {"r_regionkey"}}, [told.append])
    svc.get("/Regions?where=r_regionkey eq 1")
    try:
        svc.get("/Regions?where=r_name eq 'ASIA'")
    except ValueError as x:
        return spark.createDataFrame([(str(x),)] if told[-1]["error"] and not told[0]["error"] else [], "said string")
    raise AssertionError


@made("batch_changeset", "select r_regionkey, case when r_regionkey = 1 then 'ONE' else r_name end as r_name from region where r_regionkey <> 4 union all select 77, 'NEW'")
def batch_changeset(spark, sf_dir):
    snaps, session = stored_star(spark, sf_dir, "region")
    rows = lambda *r: spark.createDataFrame(list(r), "r_regionkey int, r_name string")
    steps = [lambda t: {"region": merge.merge(t["region"], rows((1, "ONE"), (77, "NEW")), ["r_regionkey"])}, lambda t: {"region": merge.delete(t["region"], rows((4, "")), ["r_regionkey"])}]
    return run_batch(session, snaps, ["/Regions", ChangeSet(steps), "/Regions"])[-1]


@made("transaction_buffer", "select * from region where r_regionkey < 3")
def transaction_buffer(spark, sf_dir):
    """A change that is rolled back isn't there, one that is saved is."""
    snaps, _ = stored_star(spark, sf_dir, "region")
    t = Transaction(snaps)
    t.add(lambda tables: {"region": tables["region"].limit(0)})
    t.rollback()
    t.add(lambda tables: {"region": tables["region"].where("r_regionkey < 3")})
    t.save_changes()
    return snaps.read("region")


# -- deep writes ------------------------------------------------------------------------------------------------------------
@made("deep_write_bridge", "select distinct l_partkey, l_suppkey from lineitem union select p_partkey, 1 from part where p_partkey <= 20 union select p_partkey, 2 from part where p_partkey <= 20")
def deep_write_bridge(spark, sf_dir):
    """Parts with their suppliers nested: rows of the bridge between them, those that are new."""
    m, read = star_model(), lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    tables = {"part": read("part"), "supplier": read("supplier"), "lineitem": read("lineitem").select("l_partkey", "l_suppkey").distinct()}
    one = lambda k: F.struct(F.lit(k).cast("long").alias("s_suppkey"))
    rows = tables["part"].where("p_partkey <= 20").select("p_partkey", F.array(one(1), one(2)).alias("Suppliers"))
    return graph.deep_write(m, m.type("Part"), rows)(tables)["lineitem"]


@made("deep_write_lineage", "select event_id, user_id, value from events where event_type = 'click' union all select event_id + 10000000, user_id, value + 1 from events where event_type = 'click' and event_id < 200")
def deep_write_lineage(spark, sf_dir):
    """Rows of a derived type go to its base's table and its own."""
    m, c = star_model(), star_catalog(spark, sf_dir)
    tables = {n: c.table(n) for n in ("event_base", "event_click")}
    new = c.table("events").where("event_type = 'click' and event_id < 200").select((F.col("event_id") + 10_000_000).alias("event_id"), "ts", "user_id", "event_type", (F.col("value") + 1).alias("value"))
    tables |= graph.deep_write(m, m.type("ClickEvent"), new)(tables)
    return Session(spark, m, Catalog(spark, sf_dir, tables)).query("/ClickEvents?$select=event_id,user_id,value")


# -- loads ------------------------------------------------------------------------------------------------------------------
@made("bulk_load", "select * from nation union all select n_nationkey + 100, n_name, n_regionkey from nation where n_regionkey = 2")
def bulk_load(spark, sf_dir):
    """A table that isn't there yet is made, and then appended to."""
    m, snaps = star_model(), Snapshots(spark, scratch(spark))
    n = star_catalog(spark, sf_dir).table("nation")
    load.bulk_load(snaps, m, m.type("Nation"), n)
    load.bulk_load(snaps, m, m.type("Nation"), n.where("n_regionkey = 2").withColumn("n_nationkey", F.col("n_nationkey") + 100))
    return snaps.read("nation")


@made("load_and_merge", "select c_custkey, case when c_custkey % 3 = 0 then c_acctbal + 10 else c_acctbal end as c_acctbal, c_mktsegment from customer union all select c_custkey + 1000000, 0, null from customer where c_custkey < 5")
def load_and_merge(spark, sf_dir):
    snaps, _ = stored_star(spark, sf_dir, "customer")
    m, c = star_model(), star_catalog(spark, sf_dir).table("customer")
    rows = c.where("c_custkey % 3 = 0").select("c_custkey", (F.col("c_acctbal") + 10).alias("c_acctbal"))
    new = c.where("c_custkey < 5").select((F.col("c_custkey") + 1_000_000).alias("c_custkey"), F.lit(0.0).alias("c_acctbal"))
    load.load_and_merge(snaps, m, m.type("Customer"), rows.union(new))
    return snaps.read("customer").select("c_custkey", "c_acctbal", "c_mktsegment")


@made("load_transaction", "select 'region' as t, r_regionkey as k, case when r_regionkey = 0 then 'ZERO' else r_name end as name from region union all select 'nation', n_nationkey, n_name from nation where n_nationkey <> 0")
def load_transaction(spark, sf_dir):
    """Two tables changed together; a list that fails changes neither."""
    snaps, _ = stored_star(spark, sf_dir, "region", "nation")
    m = star_model()
    region = load.upsert_step(m, m.type("Region"), spark.createDataFrame([(0, "ZERO")], "r_regionkey int, r_name string"))
    load.load_all(snaps, [region, lambda t: {"nation": t["nation"].where("n_nationkey <> 0")}])
    try:
        load.load_all(snaps, [lambda t: {"region": t["region"].limit(0)}, lambda t: {"nation": t["no such table"]}])
    except KeyError:
        pass
    r, n = snaps.read("region"), snaps.read("nation")
    return r.select(F.lit("region").alias("t"), F.col("r_regionkey").alias("k"), F.col("r_name").alias("name")).union(n.select(F.lit("nation"), "n_nationkey", "n_name"))


# -- key-value tables, CSV, configuration -----------------------------------------------------------------------------------
@made("kv_scan", "select n_nationkey, n_name from nation")
def kv_scan(spark, sf_dir):
    kv = KeyValueTable(spark, scratch(spark))
    kv.write(star_catalog(spark, sf_dir).table("nation").select("n_nationkey", "n_name"), "Nation", ["n_nationkey"])
    kv.write(star_catalog(spark, sf_dir).table("region"), "Region", ["r_regionkey"])
    return kv.scan("Nation").select("n_nationkey", "n_name")


@made("kv_get", "select r_regionkey, r_name from region where r_regionkey = 3")
def kv_get(spark, sf_dir):
    kv = KeyValueTable(spark, scratch(spark))
    kv.write(star_catalog(spark, sf_dir).table("region"), "Region", ["r_regionkey"])
    return kv.get("Region", 3).select("r_regionkey", "r_name")


@made("kv_put", "select n_nationkey, case when n_nationkey < 5 then 'PUT' else n_name end as n_name, case when n_nationkey < 5 then null else n_regionkey end as n_regionkey from nation")
def kv_put(spark, sf_dir):
    """PUT with If-Match: properties that aren't given become null, and nothing is inserted."""
    n = star_catalog(spark, sf_dir).table("nation")
    rows = n.where("n_nationkey < 5").select("n_nationkey", F.lit("PUT").alias("n_name")).union(spark.createDataFrame([(999, "none")], "k int, n string"))
    return key_value_upsert(n, rows, ["n_nationkey"], replace=True, must_exist=True)


@made("kv_patch", "select n_nationkey, case when n_nationkey < 5 then 'PATCH' else n_name end as n_name, n_regionkey from nation union all select 999, 'PATCH', null")
def kv_patch(spark, sf_dir):
    n = star_catalog(spark, sf_dir).table("nation")
    rows = n.where("n_nationkey < 5").select("n_nationkey").union(spark.createDataFrame([(999,)], "k int")).withColumn("n_name", F.lit("PATCH"))
    return key_value_upsert(n, rows, ["n_nationkey"], replace=False)


@made("csv_out", "select o_orderkey, case o_orderstatus when 'O' then 0 when 'F' then 1 else 2 end as status, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%fZ') as day, 'a \"quoted\", ' || o_orderpriority as note from orders where o_orderkey < 2000")
def csv_out(spark, sf_dir):
    """Written as CSV and read back as text."""
    path = scratch(spark)
    o = star_catalog(spark, sf_dir).table("orders").where("o_orderkey < 2000")
    note = F.concat(F.lit('a "quoted", '), "o_orderpriority").alias("note")
    to_csv(o.select("o_orderkey", F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("day"), note), path, enums={"status": {"O": 0, "F": 1, "P": 2}})
    return spark.read.schema("o_orderkey long, status int, day string, note string").csv(path, header=True, escape='"')


@made("blob_paths", "select 'in/2024/12/31/' || h || '/x-' || p as path from (values ('22'), ('23')) a(h), (values ('0'), ('1')) b(p) union all select 'in/2025/01/01/00/x-' || p from (values ('0'), ('1')) b(p)")
def blob_paths_(spark, sf_dir):
    got = blob_paths("in/{YYYY}/{MM}/{DD}/{HH}/{Prefix}-{PartitionId}", dt.datetime(2024, 12, 31, 22), dt.datetime(2025, 1, 1, 1), ["0", "1"], "x")
    return spark.createDataFrame([(p,) for p in got], "path string")


@made("configuration", "select 'N.Base' as name, 1 as every, 'sum' as how union all select 'N.Own', 5, 'sum'")
def configuration(spark, sf_dir):
    c = Configuration([{"Namespace": "N", "Name": "Base", "Kind": "Feed", "Load": {"every": 1, "how": "sum"}}, {"Namespace": "N", "Name": "Own", "Base": "N.Base", "Load": {"every": 5}}])
    return spark.createDataFrame([(n, (got := c.get(n, "Feed"))["Load"]["every"], got["Load"]["how"]) for n in ("N.Base", "N.Own")], "name string, every int, how string")


# -- schemas ----------------------------------------------------------------------------------------------------------------
def _ddl_model() -> EntityModel:
    m = EntityModel()
    price = T.StructType([T.StructField("low", T.DoubleType()), T.StructField("high", T.DoubleType())])
    fields = [T.StructField("id", T.LongType(), False), T.StructField("price", price), T.StructField("tags", T.ArrayType(T.StringType())), T.StructField("region", T.IntegerType())]
    m.entity("Thing", "thing", T.StructType(fields), ("id",), "Things", status={"type": T.StringType(), "enum": "Status"}, grade={"type": T.IntegerType(), "default": 7}, twice={"type": T.LongType(), "computed": "id * 2"})
    m.entity("Region", "region", T.StructType([T.StructField("r_regionkey", T.IntegerType(), False), T.StructField("r_name", T.StringType())]), ("r_regionkey",), "Regions")
    m.one("Thing", "Region", "Region", [("region", "r_regionkey")], "Things")
    m.enum("Status", {"O": 0, "F": 1})
    return m


@made(
    "ddl_schema",
    "select * from (values ('id', 'bigint'), ('price_low', 'double'), ('price_high', 'double'), ('tags', 'string'), ('region', 'int'), ('status', 'int'), ('grade', 'int'), ('twice', 'bigint'), "
    "('PK_thing', 'primary(id)'), ('foreign', 'region -> region.r_regionkey')) x(name, kind)",
)
def ddl_schema(spark, sf_dir):
    """The table of a type: complex properties flattened, lists as text, enums as numbers; its key and foreign keys."""
    m = _ddl_model()
    spec = ddl.table_spec(m, m.type("Thing"))
    rows = [(f.name, f.dataType.simpleString()) for f in spec.schema.fields] + [(i.name, f"{i.kind}({','.join(i.columns)})") for i in spec.indexes]
    rows += [("foreign", f"{','.join(a)} -> {t}.{','.join(b)}") for a, t, b in spec.foreign_keys]
    return spark.createDataFrame(rows, "name string, kind string")


@made("ddl_create", "select * from (values ('id', 'bigint'), ('region', 'int'), ('later', 'date'), ('index.PK_thing', 'primary(id)'), ('index.IX_region', 'common(region) include(status)')) x(name, kind)")
def ddl_create(spark, sf_dir):
    """A catalog table made if it is missing, twice; a column added later; key and index in its properties."""
    m = _ddl_model()
    spec = ddl.table_spec(m, m.type("Thing"))
    spec.name = f"quillon_{uuid.uuid4().hex}"
    spec.indexes.append(ddl.Index("IX_region", "common", ("region",), ("status",)))
    ddl.create_if_missing(spark, spec)
    try:
        ddl.create_if_missing(spark, spec)
        spec.schema = spec.schema.add("later", T.DateType())
        assert ddl.add_missing_columns(spark, spec) == ["later"] and ddl.add_missing_columns(spark, spec) == []
        have = {f.name: f.dataType.simpleString() for f in spark.table(spec.name).schema.fields}
        props = {r["key"]: r["value"] for r in spark.sql(f"SHOW TBLPROPERTIES {spec.name}").collect()}
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {spec.name}")
    rows = [(n, have[n]) for n in ("id", "region", "later")] + [(k, props[k]) for k in ("index.PK_thing", "index.IX_region")]
    return spark.createDataFrame(rows, "name string, kind string")


@made("ddl_prepared", "select c_custkey as id, c_nationkey as region, case when c_custkey % 2 = 0 then 3 else 7 end as grade, c_custkey * 2 as twice from customer")
def ddl_prepared(spark, sf_dir):
    """Defaults, a computed column and a check."""
    m = _ddl_model()
    spec = ddl.table_spec(m, m.type("Thing"))
    spec.checks["known"] = "region < 25"
    c = star_catalog(spark, sf_dir).table("customer")
    rows = c.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("region"), F.when(F.col("c_custkey") % 2 == 0, 3).alias("grade"))
    return ddl.prepared(rows, spec).select("id", "region", "grade", "twice")


@made("ddl_staging", "select * from (values ('id', 'bigint', true), ('ver', 'binary', true)) x(name, kind, nullable)")
def ddl_staging(spark, sf_dir):
    spec = ddl.TableSpec("t", T.StructType([T.StructField("id", T.LongType(), False), T.StructField("ver", T.LongType(), False, {"rowversion": True})]), [ddl.Index("PK", "primary", ("id",))], identity="id")
    out = ddl.staging(spec)
    assert not out.indexes and out.identity is None
    return spark.createDataFrame([(f.name, f.dataType.simpleString(), f.nullable) for f in out.schema.fields], "name string, kind string, nullable boolean")


# -- maps, shards, stores ---------------------------------------------------------------------------------------------------
@made("dimension_map", "select c_custkey as id, upper(n_name) as nation, case r_name when 'ASIA' then 'A' else r_name end as area from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey")
def dimension_map(spark, sf_dir):
    """A dimension with a map of its own, nested in the row."""
    df = star_session(spark, sf_dir).query("/Customers?$select=c_custkey&$expand=Nation($expand=Region)")
    region = etl.ColumnMap("Area", "Region", nested=(etl.ColumnMap("name", "r_name", {"ASIA": "A"}),))
    out = etl.mapped(df, [etl.ColumnMap("id", "c_custkey"), etl.ColumnMap("Place", "Nation", nested=(etl.ColumnMap("label", "n_name"), region))])
    return out.select("id", F.upper("Place.label").alias("nation"), F.col("Place.Area.name").alias("area"))


@made("shard_placement", "select n_nationkey, case when n_nationkey in (7, 8) then 'd' when n_nationkey = 4 then 'a' else chr(cast(97 + n_nationkey % 3 as int)) end as shard_name from nation where n_nationkey <> 5")
def shard_placement(spark, sf_dir):
    """Shardlets placed on the least populated shard; a shard added for two of them, one moved, one removed."""
    m = shards.ShardMap({"a": set(), "b": set(), "c": set()})
    for k in range(25):
        m.add(k)
    m.add_shard("d")
    for k in (7, 8):
        m.remove(k)
        m.add(k, shards.specified("d"))
    m.move(4, "a")
    m.remove(5)
    held = [k for k in range(25) if k != 5]
    return m.query(star_catalog(spark, sf_dir).table("nation").select("n_nationkey"), "n_nationkey", held)


@made("store_pick", "select n_nationkey from nation where n_regionkey = 1")
def store_pick(spark, sf_dir):
    """The store that a query names."""
    other = Catalog(spark, tables={"nation": star_catalog(spark, sf_dir).table("nation").where("n_regionkey = 1")})
    return Session(spark, star_model(), Stores(main=star_catalog(spark, sf_dir), other=other)).query("/Nations?store=other&$select=n_nationkey")


@made("procedure_operation", "select n_nationkey, n_name from nation where n_regionkey = 2")
def procedure_operation(spark, sf_dir):
    """A function of the service, called by a URL with its parameter."""
    s = star_session(spark, sf_dir)
    s.operation("NationsOf", lambda session, region: session.query(f"/Nations?$filter=n_regionkey eq {region}&$select=n_nationkey,n_name"))
    return s.query("/NationsOf(region=2)")


@made("url_round_trip", "select o_orderkey, o_totalprice from orders join customer on o_custkey = c_custkey where o_totalprice > 200000 and c_mktsegment = 'BUILDING' order by o_totalprice desc, o_orderkey limit 15")
def url_round_trip(spark, sf_dir):
    """A query written as a URL and as XML again, and run from there."""
    text = "/Orders?$filter=o_totalprice gt 200000 and Customer/c_mktsegment eq 'BUILDING'&$select=o_orderkey,o_totalprice&$orderby=o_totalprice desc,o_orderkey&$top=15"
    return star_session(spark, sf_dir).query(written(from_xml(to_xml(parse_url(written(parse_url(text)))))))


@made("memory_predicate", "select * from region where r_regionkey > 1 and (r_name <> 'ASIA' or r_regionkey = 4)")
def memory_predicate(spark, sf_dir):
    """The same language over plain rows."""
    test = compiled("r_regionkey gt 1 and (r_name ne 'ASIA' or r_regionkey eq 4)")
    rows = [r.asDict() for r in star_catalog(spark, sf_dir).table("region").collect()]
    return spark.createDataFrame([r for r in rows if test(r)], "r_regionkey int, r_name string")


@made("builder_chain", "select o_orderkey, o_totalprice from orders where o_orderstatus = 'F' order by o_totalprice desc, o_orderkey limit 12")
def builder_chain(spark, sf_dir):
    b = star_session(spark, sf_dir).builder("Orders").where("o_orderstatus eq 'F'").order_by("o_totalprice", descending=True).then_by("o_orderkey")
    return b.take(30).take(12).select("o_orderkey", "o_totalprice").dataframe()


@made("page_size", "select c_custkey from customer order by c_custkey limit 25")
def page_size(spark, sf_dir):
    return Session(spark, star_model(), star_catalog(spark, sf_dir), page_sizes={"Customers": 25}).query("/Customers?$select=c_custkey")


url("orderby_unselected", "/Orders?$select=o_orderstatus,o_orderkey&$orderby=o_totalprice desc,o_orderkey&$top=9", "select o_orderstatus, o_orderkey from orders order by o_totalprice desc, o_orderkey limit 9")
url("fn_now", "/Orders?$filter=o_orderdate lt now() and o_orderkey lt 500&$select=o_orderkey", "select o_orderkey from orders where o_orderdate < now()::timestamp and o_orderkey < 500")


# -- quantifiers that look outside, groups in the shape of their paths ------------------------------------------------------
url(
    "any_outer_in_or",
    "/Customers?$filter=Orders/any(o: o/o_totalprice gt c_acctbal mul 45) or c_acctbal lt 0&$select=c_custkey",
    "select c_custkey from customer where exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > c_acctbal * 45) or c_acctbal < 0",
)
url(
    "all_outer_in_or",
    "/Customers?$filter=c_mktsegment eq 'BUILDING' or Orders/all(o: o/o_totalprice gt c_acctbal)&$select=c_custkey",
    "select c_custkey from customer where c_mktsegment = 'BUILDING' or not exists (select 1 from orders where o_custkey = c_custkey and not o_totalprice > c_acctbal)",
)


@made("nested_groups", "select r_name as region, n_name as nation, c_mktsegment, count(*) as n from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by all")
def nested_groups(spark, sf_dir):
    got = star_session(spark, sf_dir).nested("/Customers?groupby=(Nation/Region/r_name,Nation/n_name,c_mktsegment)&aggregate=* with count as n")
    return got.select(F.col("Nation.Region.r_name").alias("region"), F.col("Nation.n_name").alias("nation"), "c_mktsegment", "n")


# -- joins of frames --------------------------------------------------------------------------------------------------------
@made("join_right", "select s_suppkey, n_nationkey, n_name from supplier right join nation on s_nationkey = n_nationkey and s_acctbal > 5000")
def join_right(spark, sf_dir):
    s, n = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("supplier", "nation"))
    got = joins.join(s, n, [("s_nationkey", "n_nationkey")], "right", unless=~(F.col("s_acctbal") > 5000))
    return got.select("s_suppkey", F.col("`right.n_nationkey`").alias("n_nationkey"), F.col("`right.n_name`").alias("n_name"))


@made("join_merge", "select o_orderkey, c_name from orders join customer on o_custkey = c_custkey where o_orderkey < 1000")
def join_merge(spark, sf_dir):
    """An inner join by sorting both sides, whatever their sizes."""
    o, c = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "customer"))
    got = joins.join(o.where("o_orderkey < 1000"), c, [("o_custkey", "c_custkey")], "merge")
    assert "SortMergeJoin" in got._jdf.queryExecution().executedPlan().toString()
    return got.select("o_orderkey", F.col("`right.c_name`").alias("c_name"))


@made("join_composite", "select count(*) as n, cast(sum(a.l_quantity) as bigint) as q from lineitem a join (select l_orderkey, l_linenumber, max(l_quantity) as m from lineitem group by 1, 2) b on a.l_orderkey = b.l_orderkey and a.l_linenumber = b.l_linenumber and a.l_quantity = b.m")
def join_composite(spark, sf_dir):
    li = star_catalog(spark, sf_dir).table("lineitem")
    top = li.groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("m"))
    got = joins.join(li, top, [("l_orderkey", "l_orderkey"), ("l_linenumber", "l_linenumber"), ("l_quantity", "m")])
    return got.agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").cast("long").alias("q"))


@made("join_unless", "select c_custkey, o_orderkey from customer left join orders on o_custkey = c_custkey and not o_orderstatus = 'O' where c_custkey < 200")
def join_unless(spark, sf_dir):
    c, o = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("customer", "orders"))
    got = joins.join(c.where("c_custkey < 200"), o, [("c_custkey", "o_custkey")], "left", unless=F.col("`right.o_orderstatus`") == "O")
    return got.select("c_custkey", F.col("`right.o_orderkey`").alias("o_orderkey"))


@made("skip_anti", "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 10 offset 30")
def skip_anti(spark, sf_dir):
    o = star_catalog(spark, sf_dir).table("orders").select("o_orderkey", "o_totalprice")
    return joins.skipped(o, [F.col("o_totalprice").desc(), F.col("o_orderkey")], ["o_orderkey"], 30, 10)


# -- feeds ------------------------------------------------------------------------------------------------------------------
_LATEST = "select user_id as who, max(ts) as seen, arg_max(value, (ts, value)) as value from events where event_type = '{}' group by 1"


@made(
    "feed_engine",
    f"with c as ({_LATEST.format('click')}), v as ({_LATEST.format('view')}), r as (select * from c where seen >= (select max(seen) from c) - interval 1 day) "
    "select 'click' as feed, date_trunc('day', seen) as period, count(*) as n, max(value) as top from r group by 2 union all select 'view', date_trunc('day', seen), count(*), max(value) from v group by 2",
)
def feed_engine(spark, sf_dir):
    """Two configured feeds with a common base, run twice: the newest row of each user, one of them purged, and daily aggregates."""
    base = {"Namespace": "F", "Name": "Base", "Kind": "Feed", "Abstract": True, "Keys": ["who"], "Watermark": "seen", "Columns": {"who": "user_id", "seen": "ts", "value": "value", "one": "one"}}
    daily = {"Period": "Daily", "Grain": [], "Measures": {"n": ["sum", "one"], "top": ["max", "value"]}}
    feed = lambda kind, **more: {"Namespace": "F", "Name": kind, "Base": "F.Base", "Abstract": False, "Table": kind, "Source": {"Kind": "events", "Type": kind}, "Aggregates": {f"{kind}_daily": daily}} | more
    read = lambda spark, source: star_catalog(spark, sf_dir).table("events").where(F.col("event_type") == source["Type"]).withColumn("one", F.lit(1))
    engine = Engine(Configuration([base, feed("click", MaximumDays=1, LateDays=1, DependsOn=["F.view"]), feed("view")]), Snapshots(spark, scratch(spark)), {"events": read})
    assert engine.run() == engine.run() == ["F.view", "F.click"]
    return union(*[engine.snapshots.read(f"{k}_daily").withColumn("feed", F.lit(k)) for k in ("click", "view")])


# -- caches -----------------------------------------------------------------------------------------------------------------
@made("cache_watermark", "with o as (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderkey desc) as r from orders) select o_custkey, o_orderkey, (select max(o_orderkey) from orders) as mark from o where r = 1")
def cache_watermark(spark, sf_dir):
    """Three loads by a numeric watermark, of two chunks each; the last brings old rows again, which replace nothing."""
    o = star_catalog(spark, sf_dir).table("orders").select("o_custkey", "o_orderkey")
    c = Cache(spark, scratch(spark), "last", ["o_custkey"], "o_orderkey")
    chunk = lambda k, below: lambda since: o.where(F.col("o_custkey") % 2 == k).where(F.col("o_orderkey") < below).where(F.lit(True) if since is None else F.col("o_orderkey") > int(since))
    for below in (90, 1000, 1 << 40):
        assert c.refresh([chunk(0, below), chunk(1, below)]) == []
    assert c.refresh([lambda since: o.where("o_orderkey < 500")]) == []
    return c.rows().withColumn("mark", F.lit(int(c.state()["watermark"])).cast("long"))


@made("cache_lookup", "select user_id, max(ts) as ts from events where user_id = 7 group by 1")
def cache_lookup(spark, sf_dir):
    e = star_catalog(spark, sf_dir).table("events").select("user_id", "ts")
    c = Cache(spark, scratch(spark), "seen", ["user_id"], "ts")
    c.refresh([lambda since: e])
    return c.get(7)


@made("cache_retention", "with e as (select user_id, max(ts) as ts from events group by 1) select * from e where ts >= (select max(ts) from events) - interval 2 day")
def cache_retention(spark, sf_dir):
    e = star_catalog(spark, sf_dir).table("events").select("user_id", "ts")
    c = Cache(spark, scratch(spark), "recent", ["user_id"], "ts", late="1 day", maximum_days=2)
    c.refresh([lambda since: e])
    c.refresh([lambda since: e.where(F.col("ts") > F.lit(since).cast("timestamp_ntz"))])
    return c.rows()


# -- histograms and digests -------------------------------------------------------------------------------------------------
url(
    "agg_histogram",
    "/Orders?groupby=(o_orderpriority)&aggregate=eh.tostring(o_orderstatus) with merge as statuses",
    "select o_orderpriority, string_agg(s || '=' || n, ',' order by s) as statuses from (select o_orderpriority, o_orderstatus as s, count(*) as n from orders group by 1, 2) group by 1",
)
url("agg_histogram_numbers", "/LineItems?aggregate=eh.tostring(l_linenumber) with merge as numbers", "select string_agg(k || '=' || n, ',' order by k) as numbers from (select l_linenumber as k, count(*) as n from lineitem group by 1)")
@made("agg_moments", "select p_brand, round(var_pop(p_size), 6) as v, round(avg(p_size), 6) as a from part group by 1")
def agg_moments(spark, sf_dir):
    got = star_session(spark, sf_dir).query("/Parts?groupby=(p_brand)&aggregate=p.variance(p_size) with merge as v,p.average(p_size) with merge as a")
    return got.select("p_brand", F.round("v", 6).alias("v"), F.round("a", 6).alias("a"))


@made(
    "digest_merge",
    "select c_nationkey, count(*) as n, min(o_totalprice) as lo, max(o_totalprice) as hi, true as near, true as near_mean from orders join customer on o_custkey = c_custkey group by 1",
)
def digest_merge(spark, sf_dir):
    """Digests stored for each customer, merged for each nation: count and ends are exact, the median's rank is within 3 percent, and the
    mean of the merged digest within 5 percent of that of the rows."""
    o = star_catalog(spark, sf_dir).table("orders").join(star_catalog(spark, sf_dir).table("customer"), F.col("o_custkey") == F.col("c_custkey"))
    m = EntityModel()
    m.entity("Digest", "digest", T.StructType([T.StructField("o_custkey", T.LongType()), T.StructField("c_nationkey", T.IntegerType()), T.StructField("d", T.BinaryType())]), ("o_custkey",), "Digests")
    stored = o.groupBy("o_custkey", "c_nationkey").agg(F.kll_sketch_agg_double("o_totalprice").alias("d"))
    aggregates = "p.cardinality(d) with merge as n,p.minimum(d) with merge as lo,p.maximum(d) with merge as hi,p.getquantile(d,0.5) with merge as mid,p.average(d) with merge as mean"
    got = Session(spark, m, Catalog(spark, tables={"digest": stored})).query(f"/Digests?groupby=(c_nationkey)&aggregate={aggregates}")
    true = o.groupBy("c_nationkey").agg(F.expr("percentile(o_totalprice, array(0.47, 0.53))").alias("q"), F.avg("o_totalprice").alias("avg"))
    near, mean = (F.col("mid") >= F.col("q")[0]) & (F.col("mid") <= F.col("q")[1]), F.abs(F.col("mean") - F.col("avg")) <= 0.05 * F.abs(F.col("avg"))
    return got.join(true, "c_nationkey").select("c_nationkey", "n", "lo", "hi", near.alias("near"), mean.alias("near_mean"))



@made("digest_configured", "select c_nationkey, count(*) as n from orders join customer on o_custkey = c_custkey group by 1")
def digest_configured(spark, sf_dir):
    """A stored type whose functions a configuration names: aggregated for each customer, merged for each nation, and read."""
    udfs = Udfs()
    udfs.configure({"Name": "Sketch", "AggregateFunction": "kll_sketch_agg_double", "Merge": "kll_merge_agg_double", "FromBinary": "kll_sketch_get_n_double"})
    first = Session(spark, star_model(), star_catalog(spark, sf_dir), udfs).query("/Orders?groupby=(o_custkey,Customer/c_nationkey)&aggregate=Sketch.aggregate(o_totalprice) with merge as d")
    stored = first.withColumnRenamed("Customer_c_nationkey", "c_nationkey")
    m = EntityModel()
    m.entity("Digest", "digest", stored.schema, ("o_custkey",), "Digests")
    got = Session(spark, m, Catalog(spark, tables={"digest": stored}), udfs).query("/Digests?groupby=(c_nationkey)&aggregate=Sketch.aggregate(d) with merge as d")
    return got.select("c_nationkey", udfs.get("Sketch.frombinary")(F.col("d")).alias("n"))


# -- levels and counts inside $expand ---------------------------------------------------------------------------------------
@made(
    "expand_levels",
    "with n as (select p_partkey as id, p_partkey // 4 as parent from part) select a.id, count(distinct b.id) as kids, count(c.id) as grandkids from n a left join n b on b.parent = a.id left join n c on c.parent = b.id where a.id <= 6 group by 1",
)
def expand_levels(spark, sf_dir):
    """A tree's nodes with two levels of what is below them."""
    m = EntityModel()
    m.entity("Node", "node", T.StructType([T.StructField("id", T.LongType()), T.StructField("parent", T.LongType())]), ("id",), "Nodes")
    m.one("Node", "Parent", "Node", [("parent", "id")], "Children")
    node = star_catalog(spark, sf_dir).table("part").select(F.col("p_partkey").alias("id"), F.expr("p_partkey div 4").alias("parent"))
    df = Session(spark, m, Catalog(spark, tables={"node": node})).query("/Nodes?$filter=id le 6&$expand=Children($levels=2)")
    below = F.aggregate(F.transform("Children", lambda c: F.size(c["Children"])), F.lit(0), lambda a, x: a + x)
    return df.select("id", F.size("Children").cast("long").alias("kids"), below.cast("long").alias("grandkids"))


@made("expand_count", "select c_custkey, count(o_orderkey) as orders, least(count(o_orderkey), 2) as shown from customer left join orders on o_custkey = c_custkey and o_orderstatus = 'F' where c_custkey <= 50 group by 1")
def expand_count(spark, sf_dir):
    """How many targets there are beside the few that are given."""
    df = star_session(spark, sf_dir).query("/Customers?$filter=c_custkey le 50&$select=c_custkey&$expand=Orders($filter=o_orderstatus eq 'F';$count=true;$top=2)")
    return df.select("c_custkey", F.col("Orders@count").alias("orders"), F.size("Orders").cast("long").alias("shown"))
