"""Planner semantics on small frames: nulls, missing keys, inheritance, writes, errors; and registered queries against SQL."""

import datetime as dt
import math

import duckdb
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.api import Session, union
from quillon.functions.memory import compiled
from quillon.lang.parser import parse_filter
from quillon.model import EntityModel
from quillon.operators import ddl, etl, graph, merge, shards
from quillon.operators.transactions import ChangeSet, Snapshots, Transaction, run_batch
from quillon.plans import suite
from quillon.plans.columns import BindError
from quillon.plans.star import star_session
from quillon.service import Service, value_of
from quillon.sources.catalog import Catalog
from quillon.sources.feeds import Configuration, KeyValueTable, blob_path, key_value_upsert, read_payload, to_csv
from quillon.streaming.incremental import Cache, refresh_stream

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canon(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v.replace(tzinfo=None).isoformat() if isinstance(v, dt.datetime) else v


def same(rows):
    return sorted((tuple(canon(v) for v in r) for r in rows), key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.parametrize("name", sorted(suite.queries()))
def test_against_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    df = suite.queries()[name](spark, sf)
    cols = sorted(df.columns)
    got = con.execute(suite.oracle_sql()[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == cols
    want = [tuple(r[names.index(c)] for c in cols) for r in got.fetchall()]
    assert same([tuple(r[c] for c in cols) for r in df.collect()]) == same(want)


@pytest.fixture(scope="module")
def small(spark):
    m = EntityModel()
    s = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("a", T.IntegerType()), T.StructField("s", T.StringType()), T.StructField("parent", T.IntegerType()), T.StructField("status", T.IntegerType())])
    m.entity("Row", "rows", s, ("id",), "Rows", status={"enum": "Status"})
    m.enum("Status", {"Open": 1, "Closed": 2}, flags=True)
    m.one("Row", "Parent", "Row", [("parent", "id")], "Children")
    rows = [(1, 5, "x%y", None, 1), (2, None, "it's", 1, 2), (3, -7, None, 1, 3), (4, 0, "é_", 9, None), (5, 5, "", 3, 0)]
    return Session(spark, m, Catalog(spark, None, {"rows": spark.createDataFrame(rows, s)}))


@pytest.mark.parametrize(
    "text,ids",
    [
        ("a eq null", [2]), ("null ne a", [1, 3, 4, 5]), ("a ne 5", [3, 4]), ("not (a eq 5)", [3, 4]), ("a in (5,0)", [1, 4, 5]), ("not (a in (5))", [3, 4]),
        ("contains(s,'%')", [1]), ("contains(s,'_')", [4]), ("startswith(s,'it''s')", [2]), ("endswith(s,'')", [1, 2, 4, 5]), ("contains(s,'x') ne true", [2, 4, 5]),
        ("status has Status'Closed'", [2, 3]), ("status eq 'Open'", [1]), ("status eq Ns.Status'Open,Closed'", [3]), ("a div 2 eq -3", [3]), ("a mod 2 eq -1", [3]), ("a divby 2 eq -3.5", [3]),
        ("Parent/a eq 5", [2, 3]), ("Parent/a eq 5 or id eq 1", [2, 3]), ("Children/any()", [1, 3]), ("not Children/any(c: c/a eq null)", [2, 3, 4, 5]), ("Children/all(c: c/a lt 0)", [1, 2, 4, 5]),
        ("id eq 5 or Children/any(c: c/a lt 0)", [1, 5]), ("Children/any(c: c/Children/any(d: d/a eq 5))", [1]), ("Children/all(c: c/a gt -9) and id lt 3", [1, 2]),
        ("@p eq a", [1, 5]), ("length(s) eq 0", [5]), ("isof('Row')", [1, 2, 3, 4, 5]),
    ],
)
def test_filters(small, text, ids):
    q = f"/Rows?$filter={text.replace('%', '%25')}&$select=id&@p=5"
    assert sorted(r["id"] for r in small.query(q).collect()) == ids


def test_nulls_order_first_and_descending_last(small):
    assert [r["id"] for r in small.query("/Rows?$orderby=a,id&$select=id").collect()] == [2, 3, 4, 1, 5]
    assert [r["id"] for r in small.query("/Rows?$orderby=a desc,id&$select=id").collect()] == [1, 5, 4, 3, 2]


def test_expand_keeps_parents_and_pages_per_parent(small):
    rows = {r["id"]: r for r in small.query("/Rows?$expand=Children($orderby=id desc;$top=1;$select=id;$count=true),Parent($select=a)").collect()}
    assert [c["id"] for c in rows[1]["Children"]] == [3] and rows[1]["Children@count"] == 2
    assert rows[2]["Children"] == [] and rows[2]["Parent"]["a"] == 5 and rows[4]["Parent"] is None
    deep = small.query("/Rows(1)?$expand=Children($levels=2;$select=id)").first()
    assert {c["id"]: [d["id"] for d in c["Children"]] for c in deep["Children"]} == {2: [], 3: [5]}


def test_builder_and_count(small):
    b = small.builder("Rows").where("a eq 5").order_by("id", True).take(3).take(1)
    assert [r["id"] for r in b.select("id").dataframe().collect()] == [5]
    assert small.count("/Rows?$filter=a eq 5&$top=1") == 2
    with pytest.raises(AttributeError):
        b.group_join


@pytest.mark.parametrize("url", ["/Nothing", "/Rows?$select=zz", "/Rows?$filter=zz eq 1", "/Rows?$filter=a eq @zz", "/Rows?$expand=zz", "/Rows?$filter=geo.length(a) eq 1", "/Rows?groupby=(a)&aggregate=id as x", "/Rows/Nope/More", "/Rows?$search=x", "/Rows?$filter=nofn(a)"])
def test_bind_errors(small, url):
    with pytest.raises(ValueError):
        small.query(url)


def test_page_needs_a_key(spark, sf):
    with pytest.raises(BindError):
        star_session(spark, sf).query("/LineItems?$top=3")


def test_foreign_key_path_reads_one_table(spark, sf):
    plan = star_session(spark, sf).query("/Customers(7)/Orders")._jdf.queryExecution().optimizedPlan().toString()
    assert "c_custkey" not in plan and "Join" not in plan


def test_pushdown_reaches_the_scan(spark, sf):
    plan = star_session(spark, sf).query("/Orders?$filter=o_totalprice gt 400000&$select=o_orderkey")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(o_totalprice" in plan and "o_orderpriority" not in plan


def test_memory_predicates():
    f = compiled("a gt 1 and (b eq 'x' or b eq null)")
    assert f({"a": 2, "b": None}) and f({"a": 2, "b": "x"}) and not f({"a": None, "b": "x"}) and not f({"a": 2, "b": "y"})
    assert not compiled("not (a eq 1)")({"a": None})


@pytest.fixture
def people(spark):
    t = spark.createDataFrame([(1, "a", 1, None, None), (2, "b", 1, None, None), (3, None, 1, None, None)], "k int, v string, ver long, updated timestamp, by string")
    s = spark.createDataFrame([(2, "B", 1), (3, None, 1), (4, "d", 1)], "k int, v string, ver long")
    return t, s


def test_merge(people):
    t, s = people
    now = dt.datetime(2024, 1, 1)
    got = {r["k"]: r for r in merge.merge(t, s, ["k"], only_changed=True, concurrency="ver", updated_time="updated", changed_by="by", now=now, user="me").collect()}
    assert got[1]["updated"] is None and got[2]["v"] == "B" and got[2]["ver"] == 2 and got[2]["by"] == "me" and got[3]["updated"] is None and got[4]["v"] == "d" and got[4]["updated"] == now
    once = merge.merge(t, s, ["k"])
    assert sorted(map(str, merge.merge(once, s, ["k"], only_changed=True).collect())) == sorted(map(str, once.collect()))
    with pytest.raises(merge.ConcurrencyError):
        merge.merge(t, s.withColumn("ver", F.lit(9).cast("long")), ["k"], concurrency="ver")
    with pytest.raises(Exception, match="twice"):
        merge.merge(t, s.union(s), ["k"]).collect()
    acts = {r["k"]: r["action"] for r in merge.merge(t, s, ["k"], delete_unmatched=True, action=True).collect()}
    assert acts == {1: "DELETE", 2: "UPDATE", 3: "UPDATE", 4: "INSERT"}


def test_insert_numbers_identities(people):
    t, s = people
    got = merge.insert(t, s.drop("k"), identity="k")
    assert sorted(r["k"] for r in got.collect()) == [1, 2, 3, 4, 5, 6]


def test_changes_are_null_safe(people):
    t, s = people
    rows = [tuple(r) for r in merge.changes(t.select("k", "v"), s.select("k", "v"), ["k"]).collect()]
    assert sorted(rows) == [(2, "v", "b", "B", 1), (4, "v", None, "d", 0)]


def test_snapshots_commit_together(spark, tmp_path, people):
    t, s = people
    snaps = Snapshots(spark, f"file://{tmp_path}")
    snaps.commit({"p": t})
    tx = Transaction(snaps)
    tx.add(lambda tables: {"p": merge.merge(tables["p"], s, ["k"])})
    tx.add(lambda tables: {"p": merge.delete(tables["p"], s.where("k = 4"), ["k"])})
    tx.save_changes()
    assert sorted(r["k"] for r in snaps.read("p").collect()) == [1, 2, 3]
    tx.add(lambda tables: {"p": tables["p"].where("k = 1")})
    tx.rollback()
    assert tx.save_changes() == 2
    with pytest.raises(ZeroDivisionError):
        run_batch(None, snaps, [ChangeSet([lambda tables: {"p": t.limit(0)}, lambda tables: 1 / 0])])
    assert snaps.read("p").count() == 3
    tx.add(lambda t: {}, "one")
    with pytest.raises(ValueError):
        tx.add(lambda t: {}, "two")


def school(spark, root):
    m = EntityModel()
    i, s = T.IntegerType(), T.StringType()
    m.entity("Student", "student", T.StructType([T.StructField("sid", i), T.StructField("name", s), T.StructField("home", i)]), ("sid",), "Students")
    m.entity("Course", "course", T.StructType([T.StructField("cid", i), T.StructField("title", s)]), ("cid",), "Courses")
    m.entity("Room", "room", T.StructType([T.StructField("rid", i), T.StructField("rname", s)]), ("rid",), "Rooms")
    m.one("Student", "Home", "Room", [("home", "rid")], "Students")
    m.many_to_many("Student", "Courses", "Course", "enrollment", ("sid", "sid"), ("cid", "cid"), "Students")
    snaps = Snapshots(spark, root)
    snaps.commit({"student": spark.createDataFrame([(1, "Ann", None)], "sid int, name string, home int"), "course": spark.createDataFrame([(1, "Art")], "cid int, title string"), "room": spark.createDataFrame([], "rid int, rname string"), "enrollment": spark.createDataFrame([(1, 1)], "sid int, cid int")})
    tables = {n: (lambda c, n=n: snaps.read(n)) for n in ("student", "course", "room", "enrollment")}
    return m, snaps, Session(spark, m, Catalog(spark, None, tables))


def test_service_round(spark, tmp_path):
    m, snaps, session = school(spark, f"file://{tmp_path}")
    events = []
    svc = Service(session, snaps, {"Students": {"name"}}, [events.append])
    room = T.StructType([T.StructField("rid", T.IntegerType()), T.StructField("rname", T.StringType())])
    course = T.StructType([T.StructField("cid", T.IntegerType()), T.StructField("title", T.StringType())])
    schema = T.StructType([T.StructField("name", T.StringType()), T.StructField("Home", room), T.StructField("Courses", T.ArrayType(course))])
    svc.upsert("/Students(2)", {"name": "Bob", "Home": {"rid": 7, "rname": "Hall"}, "Courses": [{"cid": 1, "title": "Art"}, {"cid": 2, "title": "Biology"}]}, schema, verb="PUT")
    got = svc.get("/Students(2)?$expand=Home,Courses($orderby=cid)").first()
    assert got["Home"]["rname"] == "Hall" and [c["title"] for c in got["Courses"]] == ["Art", "Biology"]
    svc.link("/Students(1)/Courses/$ref", 2)
    assert sorted(r["cid"] for r in svc.get("/Students(1)/Courses").collect()) == [1, 2]
    svc.link("/Students(1)/Courses/$ref", 1, remove=True)
    svc.link("/Students(1)/Home/$ref", 7)
    assert value_of(svc.get("/Students(1)/Home/rname/$value")) == "Hall"
    svc.delete("/Students(2)")
    assert [r["name"] for r in svc.get("/Students").collect()] == ["Ann"]
    with pytest.raises(BindError):
        svc.get("/Students?where=sid eq 1")
    assert events[-1]["error"] and events[0]["verb"] == "PUT"


def test_inheritance_write_and_scan(spark):
    m = EntityModel()
    i, s = T.IntegerType(), T.StringType()
    m.entity("Animal", "animal", T.StructType([T.StructField("id", i), T.StructField("name", s)]), ("id",), "Animals", abstract=True)
    m.entity("Dog", "dog", T.StructType([T.StructField("breed", s)]), (), "Dogs", base="Animal")
    m.entity("Cat", "cat", T.StructType([T.StructField("lives", i)]), (), "Cats", base="Animal")
    tables = {"animal": spark.createDataFrame([(1, "Rex"), (2, "Tom")], "id int, name string"), "dog": spark.createDataFrame([(1, "lab")], "id int, breed string"), "cat": spark.createDataFrame([(2, 9)], "id int, lives int")}
    ses = Session(spark, m, Catalog(spark, None, dict(tables)))
    assert {(r["id"], r["$TypeName"], r["lives"]) for r in ses.query("/Animals").collect()} == {(1, "Dog", None), (2, "Cat", 9)}
    assert "lives" not in ses.query("/Animals?$filter=isof('Dog')&$select=id,name")._jdf.queryExecution().optimizedPlan().toString()
    new = graph.deep_write(m, m.type("Dog"), spark.createDataFrame([(3, "Pal", "pug")], "id int, name string, breed string"))(dict(tables))
    assert new["animal"].count() == 3 and new["dog"].where("breed = 'pug'").count() == 1
    gone = merge.delete_entity(m, m.type("Dog"), tables, spark.createDataFrame([(1,)], "id int"))
    assert list(gone) == ["dog", "animal"] and gone["animal"].count() == 1


def test_shards():
    m = shards.ShardMap({"a": set(), "b": set()})
    assert [m.add(k, shards.even_odd) for k in (0, 1, 2)] == ["a", "b", "a"]
    assert m.add(3) == "b" and m.add(4, shards.specified("b")) == "b"
    m.move(4, "a")
    assert m.shard_of(4) == "a" and m.route("all") == [0, 1, 2, 3, 4] and m.route(None) == [0]
    with pytest.raises(shards.ShardError):
        m.add(4)


def test_feeds(spark, tmp_path):
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("n", T.StringType())])
    for text, n in (('[{"id":1},{"id":2}]', 2), ('{"value":[{"id":1}]}', 1), ('{"id":1,"n":"x"}', 1), ("nonsense", 0)):
        assert read_payload(spark, text, schema).count() == n
    kv = KeyValueTable(spark, f"{tmp_path}/kv")
    df = spark.createDataFrame([(1, 2, "x")], "a int, b int, v string")
    kv.write(df, "T", ["a", "b"])
    assert kv.get("T", 1, 2).first()["v"] == "x" and kv.scan("T").count() == 1
    t = spark.createDataFrame([(1, "x", "y")], "k int, a string, b string")
    put = key_value_upsert(t, spark.createDataFrame([(1, "X"), (2, "N")], "k int, a string"), ["k"], replace=True, must_exist=True).collect()
    assert [(r["k"], r["a"], r["b"]) for r in put] == [(1, "X", None)]
    assert blob_path("{YYYY}/{MM}/{DD}/{HH}/{Prefix}-{PartitionId}", dt.datetime(2024, 12, 31, 23, 5), "p", "7") == "2025/01/01/00/p-7"
    c = Configuration([{"Namespace": "N", "Name": "A", "Kind": "Feed", "X": {"a": 1, "b": 2}}, {"Namespace": "N", "Name": "B", "Base": "N.A", "X": {"b": 3}}])
    assert c.get("N.B")["X"] == {"a": 1, "b": 3} and c.get("N.B", "Feed") and len(c.of_kind("Feed")) == 2
    to_csv(spark.createDataFrame([("a,b", 'q"q')], "x string, y string"), f"{tmp_path}/csv")
    assert spark.read.csv(f"{tmp_path}/csv", header=True, escape='"').first() == ("a,b", 'q"q')


def test_etl_nulls(spark):
    df = spark.createDataFrame([(1, None), (2, "A"), (3, "Z")], "id int, v string")
    got = [r["v"] for r in etl.mapped(df, [etl.ColumnMap("v", "v", {"A": "1"})]).collect()]
    assert got == [None, "1", "Z"]
    assert [r["b"] for r in etl.banded(df, "id", [(None, 2, "low")], "b", "rest").collect()] == ["low", "rest", "rest"]


def test_union_pads(spark):
    got = union(spark.createDataFrame([(1,)], "b int"), spark.createDataFrame([("x",)], "a string"))
    assert got.columns == ["a", "b"] and {tuple(r) for r in got.collect()} == {(None, 1), ("x", None)}


def test_ddl(spark):
    m = EntityModel()
    m.entity("T", "ddl_t", T.StructType([T.StructField("id", T.IntegerType(), False), T.StructField("c", T.StructType([T.StructField("x", T.IntegerType())])), T.StructField("tags", T.ArrayType(T.StringType()))]), ("id",), "Ts", e={"type": T.StringType(), "enum": "E"}, d={"type": T.IntegerType(), "default": 7})
    spec = ddl.table_spec(m, m.type("T"))
    assert [(f.name, f.dataType.simpleString()) for f in spec.schema.fields] == [("id", "int"), ("c_x", "int"), ("tags", "string"), ("e", "int"), ("d", "int")]
    spark.sql("DROP TABLE IF EXISTS ddl_t")
    ddl.create_if_missing(spark, spec)
    ddl.create_if_missing(spark, spec)
    spec.schema = spec.schema.add("more", T.LongType())
    assert ddl.add_missing_columns(spark, spec) == ["more"]
    rows = ddl.prepared(spark.createDataFrame([(1,)], "id int"), spec)
    assert rows.first()["d"] == 7
    spec.checks["positive"] = "id > 5"
    with pytest.raises(Exception, match="positive"):
        ddl.prepared(spark.createDataFrame([(1,)], "id int"), spec).collect()
    spark.sql("DROP TABLE ddl_t")


def test_cache_keeps_the_watermark_when_a_chunk_fails(spark, tmp_path):
    make = lambda *rows: lambda since: spark.createDataFrame(list(rows), "k int, updated string, v int").where(F.lit(True) if since is None else F.col("updated") > since)

    def broken(since):
        raise OSError("down")

    c = Cache(spark, f"file://{tmp_path}", "c", ["k"], "updated", retries=2)
    assert not c.initialized
    assert c.refresh([make((1, "2024-01-01", 1), (2, "2024-01-02", 2))]) == []
    assert c.state()["watermark"] == "2024-01-02"
    assert len(c.refresh([make((1, "2024-01-05", 9)), broken])) == 1
    assert c.state()["watermark"] == "2024-01-02" and c.get(1).first()["v"] == 9
    assert c.refresh([make((1, "2024-01-05", 9), (3, "2024-01-06", 3))]) == []
    assert c.state()["watermark"] == "2024-01-06" and c.rows().count() == 3


def test_refresh_stream(spark, tmp_path):
    src = f"{tmp_path}/in"
    spark.createDataFrame([(1, "a", 1), (1, "b", 2)], "k int, updated string, v int").write.parquet(src)
    snaps = Snapshots(spark, f"file://{tmp_path}/out")
    for _ in range(2):
        q = refresh_stream(spark.readStream.schema("k int, updated string, v int").parquet(src), snaps, "t", ["k"], "updated", f"{tmp_path}/cp")
        q.awaitTermination()
        spark.createDataFrame([(2, "c", 3)], "k int, updated string, v int").write.mode("append").parquet(src)
    assert {(r["k"], r["v"]) for r in snaps.read("t").collect()} == {(1, 2), (2, 3)}


def test_parameters_now(small):
    assert small.query("/Rows?$filter=@Now gt mindatetime() and @Today sub 7 lt now()&$select=id").count() == 5
    assert parse_filter("@Now sub 7").op == "sub"
