"""Commits at once, loads, JDBC, watermarks, digests, paged expands and null keys."""

import threading

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.api import Session
from quillon.functions import scalar
from quillon.model import EntityModel
from quillon.operators import load, merge
from quillon.operators.transactions import CommitConflict, Snapshots
from quillon.plans.star import star_session
from quillon.sources.catalog import Catalog
from quillon.sources.jdbc import JdbcStore
from quillon.streaming.incremental import Cache, refresh_stream


def test_of_two_commits_at_once_one_is_there_whole(spark, tmp_path):
    root = f"file://{tmp_path}"
    Snapshots(spark, root).commit({"t": spark.range(3)})
    gate, done, lost = threading.Barrier(4), [], []

    def run(k):
        own = Snapshots(spark, root)
        frame = spark.range(100 * k, 100 * k + 5).withColumn("k", F.lit(k))
        number, current = own.current(), own.current
        own.current = lambda: number  # all start from the same manifest
        gate.wait()
        try:
            own.commit({"t": frame})
            done.append(k)
        except CommitConflict:
            lost.append(k)
        own.current = current

    threads = [threading.Thread(target=run, args=(k,)) for k in range(1, 5)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(done) == 1 and len(lost) == 3
    rows = Snapshots(spark, root).read("t").collect()
    assert {r["k"] for r in rows} == set(done) and len(rows) == 5
    assert len([p for p in (tmp_path / "t").iterdir() if p.is_dir()]) == 2  # losers' folders are gone
    assert not list((tmp_path / "_manifest").glob("*.tmp"))


def test_a_late_committer_leaves_the_first_one_s_rows(spark, tmp_path):
    a, b = Snapshots(spark, f"file://{tmp_path}"), Snapshots(spark, f"file://{tmp_path}")
    old = b.current()
    a.commit({"t": spark.range(10, 13)})
    b.current = lambda: old
    with pytest.raises(CommitConflict):
        b.commit({"t": spark.range(100, 103)})
    assert sorted(r["id"] for r in a.read("t").collect()) == [10, 11, 12]


def thing_model():
    m = EntityModel()
    m.entity("Thing", "thing", T.StructType([T.StructField("id", T.LongType(), False), T.StructField("v", T.StringType())]), ("id",), "Things", n={"type": T.IntegerType(), "default": 4})
    return m


def test_loads(spark, tmp_path):
    m, snaps = thing_model(), Snapshots(spark, f"file://{tmp_path}")
    t = m.type("Thing")
    load.bulk_load(snaps, m, t, spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string"))
    load.load_and_merge(snaps, m, t, spark.createDataFrame([(2, "B"), (3, "c")], "id long, v string"))
    assert {tuple(r) for r in snaps.read("thing").collect()} == {(1, "a", 4), (2, "B", 4), (3, "c", None)}
    assert not list(tmp_path.glob("thing_staging/*"))
    with pytest.raises(Exception, match="twice"):
        load.load_and_merge(snaps, m, t, spark.createDataFrame([(2, "x"), (2, "y")], "id long, v string"))
    assert snaps.read("thing").count() == 3 and not list(tmp_path.glob("thing_staging/*"))


def test_jdbc_store(spark):
    """An embedded database that comes with Spark, in memory."""
    store = JdbcStore(spark, "jdbc:derby:memory:quillon;create=true", "org.apache.derby.iapi.jdbc.AutoloadedDriver", retries=0)
    rows = spark.createDataFrame([(k, f"n{k}", k % 3) for k in range(50)], "ID int, NAME string, PART int")
    store.append(rows, "THING")
    store.append(rows.where("ID < 2").withColumn("ID", F.col("ID") + 100), "THING")
    store.ranges["THING"] = ("ID", 0, 120, 4)
    df = store.table("THING")
    assert df.count() == 52 and df.rdd.getNumPartitions() == 4
    plan = df.where("PART = 1").select("ID")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(PART,1)" in plan and "NAME" not in plan.split("ReadSchema")[-1]
    assert store.query("select count(*) as N from THING where PART = 1").first()["N"] == 18
    m = EntityModel()
    m.entity("Thing", "THING", df.schema, ("ID",), "Things")
    got = Session(spark, m, store.catalog(["THING"])).query("/Things?$filter=PART eq 2 and ID gt 40&$select=ID").collect()
    assert sorted(r["ID"] for r in got) == [41, 44, 47]
    store.replace(rows.where("ID = 1"), "THING")
    assert store.table("THING").count() == 1
    calls = []

    def fails():
        calls.append(1)
        raise OSError("down")

    with pytest.raises(OSError):
        JdbcStore(spark, "jdbc:none", retries=2, wait=0).retried(fails)
    assert len(calls) == 3


def test_watermarks_are_compared_by_type_and_late_rows_replace_nothing(spark, tmp_path):
    c = Cache(spark, f"file://{tmp_path}", "c", ["k"], "ver")
    make = lambda *rows: lambda since: spark.createDataFrame(list(rows), "k int, ver long, v string")
    c.refresh([make((1, 9, "nine"), (2, 8, "eight"))])
    c.refresh([make((1, 10, "ten"))])
    assert c.state()["watermark"] == "10"
    c.refresh([make((1, 9, "late"), (3, 1, "new"))])
    assert c.state()["watermark"] == "10" and {r["k"]: r["v"] for r in c.rows().collect()} == {1: "ten", 2: "eight", 3: "new"}


def test_streams_keep_the_newer_row(spark, tmp_path):
    src, snaps = f"{tmp_path}/in", Snapshots(spark, f"file://{tmp_path}/out")
    for rows in ([(1, 10, "new")], [(1, 9, "late"), (2, 1, "x")]):
        spark.createDataFrame(rows, "k int, ver long, v string").write.mode("append").parquet(src)
        refresh_stream(spark.readStream.schema("k int, ver long, v string").parquet(src), snaps, "t", ["k"], "ver", f"{tmp_path}/cp").awaitTermination()
    assert {(r["k"], r["v"]) for r in snaps.read("t").collect()} == {(1, "new"), (2, "x")}


def test_chunks_are_loaded_together(spark, tmp_path):
    gate = threading.Barrier(3, timeout=60)

    def chunk(k):
        def load(since):
            gate.wait()  # fails unless all three are under way at once
            return spark.createDataFrame([(k, 1)], "k int, ver long")

        return load

    c = Cache(spark, f"file://{tmp_path}", "c", ["k"], "ver", retries=1)
    assert c.refresh([chunk(k) for k in range(3)]) == [] and c.rows().count() == 3


def test_histograms_and_digests(spark, monkeypatch):
    df = spark.createDataFrame([("a", 2), ("a", 10), ("a", 2), ("b", None), ("a", None)], "g string, v int")
    got = {r["g"]: r["h"] for r in df.groupBy("g").agg(scalar.histogram_text(F.col("v")).alias("h")).collect()}
    assert got == {"a": "2=2,10=1", "b": ""}
    monkeypatch.setattr(scalar, "VALUES", 20)
    with pytest.raises(Exception, match="more than 20 values"):
        spark.range(21).agg(scalar.histogram_text(F.col("id")).alias("h")).collect()
    assert spark.range(20).agg(scalar.histogram_text(F.col("id") % 20).alias("h")).first()["h"].startswith("0=1,1=1")
    u = scalar.Udfs()
    parts = spark.range(1000).groupBy(F.col("id") % 7).agg(u.get("digest.merge")(F.col("id").cast("int")).alias("d"))
    whole = parts.agg(u.get("digest.merge", True)(F.col("d")).alias("d"))
    row = whole.agg(u.get("p.cardinality", True)(F.col("d")).alias("n"), u.get("p.getquantile", True)(F.col("d"), F.lit(0.5)).alias("q"), u.get("p.variance", True)(F.col("d")).alias("v")).first()
    assert row["n"] == 1000 and abs(row["q"] - 500) < 30 and abs(row["v"] - 83_333) < 8_000


def test_targets_of_a_page_are_cut_down_before_they_are_shuffled(spark, sf):
    s = star_session(spark, sf)
    plan = s.query("/Customers?$top=5&$expand=Orders($orderby=o_totalprice desc;$top=2)")._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan
    window, semi = plan.index("Window"), plan.index("LeftSemi")
    assert window < semi  # the semi join stands below the window
    deep = s.query("/Regions?$top=2&$orderby=r_name&$expand=Nations($expand=Customers($top=1))").collect()
    assert len(deep) == 2 and all(len(n["Customers"]) <= 1 for r in deep for n in r["Nations"])
    assert "LeftSemi" not in s.query("/Customers?$expand=Orders($top=2)")._jdf.queryExecution().optimizedPlan().toString()


def test_whole_collections_are_sorted_once(spark):
    """By their order and key, nulls first, with no window; also where rows hold maps, which have no order."""
    m = EntityModel()
    i = T.IntegerType()
    m.entity("P", "p", T.StructType([T.StructField("id", i)]), ("id",), "Ps")
    m.entity("C", "c", T.StructType([T.StructField("cid", i), T.StructField("pid", i), T.StructField("x", i), T.StructField("m", T.MapType(T.StringType(), i))]), ("cid",), "Cs")
    m.one("C", "P", "P", [("pid", "id")], "Cs")
    c = spark.createDataFrame([(5, 1, 2, {"a": 1}), (4, 1, None, {"b": 2}), (3, 1, 2, None), (9, 1, 1, {})], "cid int, pid int, x int, m map<string,int>").repartition(4)
    s = Session(spark, m, Catalog(spark, None, {"p": spark.createDataFrame([(1,), (2,)], "id int"), "c": c}))
    for query, want in (("$orderby=x", [4, 9, 3, 5]), ("$orderby=x desc", [3, 5, 9, 4]), ("$select=cid;$orderby=x", [4, 9, 3, 5]), ("$select=cid", [3, 4, 5, 9])):
        df = s.query(f"/Ps?$expand=Cs({query})")
        assert [r["cid"] for r in df.where("id = 1").first()["Cs"]] == want and df.where("id = 2").first()["Cs"] == []
        assert ("Window" in df._jdf.queryExecution().optimizedPlan().toString()) == ("desc" in query)


def test_ties_at_the_page_s_end_keep_their_targets(spark):
    m = EntityModel()
    i = T.IntegerType()
    m.entity("P", "p", T.StructType([T.StructField("id", i), T.StructField("x", i)]), ("id",), "Ps")
    m.entity("C", "c", T.StructType([T.StructField("cid", i), T.StructField("pid", i)]), ("cid",), "Cs")
    m.one("C", "P", "P", [("pid", "id")], "Cs")
    p = spark.createDataFrame([(k, 1) for k in range(40)], "id int, x int").repartition(5)
    c = spark.createDataFrame([(k, k % 40) for k in range(80)], "cid int, pid int")
    rows = Session(spark, m, Catalog(spark, None, {"p": p, "c": c})).query("/Ps?$orderby=x&$top=7&$expand=Cs").collect()
    assert [r["id"] for r in rows] == list(range(7)) and all(len(r["Cs"]) == 2 for r in rows)


def test_null_keys_are_spread(spark):
    t = spark.createDataFrame([(1, "a"), (None, "t")], "k int, v string")
    s = spark.createDataFrame([(1, "b")] + [(None, f"s{n}") for n in range(200)], "k int, v string")
    out = merge.merge(t, s, ["k"])
    assert out.count() == 202 and out.where("k = 1").first()["v"] == "b"
    salts = merge.salted(s, ["k"])
    assert salts.where("k is null").select("?salt").distinct().count() > 100 and salts.where("k = 1").first()["?salt"] == 0


def test_merges_take_any_names_and_types(spark):
    schema = "`a key` int, `odd.name` string, `x``y` double, s struct<`in side`: int, b: string>, l array<int>, m map<string, int>, d date, n decimal(10,2)"
    t = spark.createDataFrame([(1, "t", 1.0, (1, "x"), [1], {"a": 1}, None, None), (2, "t", 2.0, None, None, None, None, None)], schema)
    s = spark.createDataFrame([(2, "s", 5.0, (7, "z"), [2], {"b": 2}, None, None), (3, "s", None, None, [], None, None, None)], schema)
    got = {r["a key"]: r for r in merge.merge(t, s, ["a key"]).collect()}
    assert got[1]["s"]["in side"] == 1 and got[2]["s"]["in side"] == 7 and got[2]["x`y"] == 5.0 and got[2]["m"] == {"b": 2} and got[3]["odd.name"] == "s" and len(got) == 3
    assert merge.merge(t, s, ["a key"]).schema.fieldNames() == t.schema.fieldNames()


def test_running_sums_need_no_window_over_rows(spark):
    from quillon.operators.apply import ranked

    rows = [(k, v) for k, v in enumerate([5, 5, 5, 5, 3, 2, 1, 1])]
    df = spark.createDataFrame(rows, "id int, v int").repartition(4)
    take = lambda name, n: sorted(r["id"] for r in ranked(df, name, F.lit(n), F.col("v"), []).collect())
    assert take("topsum", 11) == [0, 1, 2] and take("topsum", 20) == [0, 1, 2, 3] and take("topsum", 21) == [0, 1, 2, 3, 4]
    assert take("bottomsum", 3) == [5, 6, 7] and take("topsum", 1000) == list(range(8)) and take("topsum", 0) == []
    assert take("toppercent", 50) == [0, 1, 2]
    plan = ranked(df, "topsum", F.lit(11), F.col("v"), [])._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan
    assert ranked(df.limit(0), "topsum", F.lit(3), F.col("v"), []).count() == 0
