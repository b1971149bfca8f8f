"""The registered entity queries, each with hand-written SQL that says the same."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.api import fan_out, union
from quillon.operators import etl, merge, shards
from quillon.plans.star import star_catalog, star_model, star_session
from quillon.sources.catalog import Catalog
from quillon.streaming.incremental import latest

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def url(name: str, text: str, sql: str) -> None:
    _queries[name] = lambda spark, sf_dir: star_session(spark, sf_dir).query(text)
    _sql[name] = sql


def made(name: str, sql: str) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        _queries[name], _sql[name] = f, sql
        return f

    return register


def queries() -> dict[str, Query]:
    from quillon.plans import suite_ops  # noqa: F401  registers its own

    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    from quillon.plans import suite_ops  # noqa: F401

    return dict(_sql)


# -- filters, projection, order ---------------------------------------------------------------------------------------------
url(
    "orderby_top",
    "/Orders?$filter=o_totalprice gt 100000 and Customer/c_mktsegment eq 'BUILDING'&$select=o_orderkey,o_totalprice&$orderby=o_totalprice desc,o_orderkey&$top=20",
    "select o_orderkey, o_totalprice from orders join customer on o_custkey = c_custkey where o_totalprice > 100000 and c_mktsegment = 'BUILDING' order by o_totalprice desc, o_orderkey limit 20",
)
url(
    "filter_cmp",
    "/Customers?$filter=c_acctbal ge 1000 and c_acctbal lt 5000 and c_mktsegment ne 'BUILDING' or c_custkey le 10 and c_name ne null",
    "select * from customer where c_acctbal >= 1000 and c_acctbal < 5000 and c_mktsegment <> 'BUILDING' or c_custkey <= 10 and c_name is not null",
)
url("filter_in", "/Parts?$filter=p_size in (1,5,9) and not (p_brand in ('Brand#1','Brand#2'))", "select * from part where p_size in (1, 5, 9) and p_brand not in ('Brand#1', 'Brand#2')")
url("filter_arith", "/Parts?$filter=p_size add 2 mul 3 gt 40 and p_partkey mod 7 eq 3 and p_partkey div 2 le 500", "select * from part where p_size + 2 * 3 > 40 and p_partkey % 7 = 3 and p_partkey // 2 <= 500")
url("filter_divby", "/Parts?compute=p_size divby 4 as quarter,p_size div 4 as whole&$select=p_partkey,quarter,whole", "select p_partkey, p_size / 4 as quarter, cast(p_size // 4 as bigint) as whole from part")
url("filter_columns", "/LineItems?$filter=l_quantity gt l_linenumber mul 10&$select=l_orderkey,l_partkey,l_quantity", "select l_orderkey, l_partkey, l_quantity from lineitem where l_quantity > l_linenumber * 10")
url("filter_where", "/Orders?$filter=o_orderstatus eq 'F'&where=o_totalprice lt 50000&$select=o_orderkey", "select o_orderkey from orders where o_orderstatus = 'F' and o_totalprice < 50000")
url("filter_date", "/Orders?$filter=o_orderdate ge 1997-01-01 and o_orderdate lt 1997-07-01T00:00:00&$select=o_orderkey,o_orderdate", "select o_orderkey, o_orderdate from orders where o_orderdate >= timestamp '1997-01-01' and o_orderdate < timestamp '1997-07-01'")
url("filter_params", "/Orders?$filter=o_orderpriority eq @p and o_totalprice gt @least&@p='2-HIGH'&@least=200000&$select=o_orderkey", "select o_orderkey from orders where o_orderpriority = '2-HIGH' and o_totalprice > 200000")
url("filter_param_list", "/Orders?$filter=o_orderstatus ne @gone&@gone=('F','O')&$select=o_orderkey", "select o_orderkey from orders where o_orderstatus not in ('F', 'O')")
url("filter_has", "/Parts?$filter=p_size has Size'Large,Odd'&$select=p_partkey,p_size", "select p_partkey, p_size from part where p_size & 12 <> 0")
url("filter_duration", "/Orders?$filter=o_orderdate add duration'P30D' gt 1999-12-01 and o_orderdate sub 5 lt 2000-06-01&$select=o_orderkey", "select o_orderkey from orders where o_orderdate + interval 30 day > timestamp '1999-12-01' and o_orderdate - interval 5 day < timestamp '2000-06-01'")
url("skip_top", "/Customers?$skip=20&$top=15", "select * from customer order by c_custkey limit 15 offset 20")
url("orderby_function", "/Parts?$orderby=length(p_name) desc,p_partkey&$top=25&$select=p_partkey,p_name", "select p_partkey, p_name from part order by length(p_name) desc, p_partkey limit 25")
url("orderby_nav", "/Customers?$orderby=Nation/n_name desc,c_acctbal,c_custkey&$top=30&$select=c_custkey,c_acctbal", "select c_custkey, c_acctbal from customer join nation on c_nationkey = n_nationkey order by n_name desc, c_acctbal, c_custkey limit 30")
url("top_ties", "/Parts?$orderby=p_size desc&$top=5&withties=true&$select=p_partkey,p_size", "select p_partkey, p_size from (select *, rank() over (order by p_size desc) as r from part) where r <= 5")
url("select_nav", "/Customers?$select=c_custkey,Nation/n_name,Nation/Region/r_name", 'select c_custkey, n_name as "Nation_n_name", r_name as "Nation_Region_r_name" from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey')

# -- functions --------------------------------------------------------------------------------------------------------------
url(
    "fn_string",
    "/Parts?compute=toupper(p_name) as up,tolower(p_type) as low,substring(p_name,3) as tail,substring(p_name,2,4) as mid,trim(concat(' ',p_brand,' ')) as trimmed,length(p_name) as n,indexof(p_name,'e') as at&$select=p_partkey,up,low,tail,mid,trimmed,n,at",
    "select p_partkey, upper(p_name) as up, lower(p_type) as low, substring(p_name, 3) as tail, substring(p_name, 2, 4) as mid, trim(' ' || p_brand || ' ') as trimmed, cast(length(p_name) as int) as n, cast(instr(p_name, 'e') as int) as at from part",
)
url("fn_match", "/Parts?$filter=(contains(p_name,'red') or startswith(p_name,'blue') or endswith(p_name,'bolt')) and not contains(p_name,'ring')&$select=p_partkey,p_name", "select p_partkey, p_name from part where (contains(p_name, 'red') or starts_with(p_name, 'blue') or ends_with(p_name, 'bolt')) and not contains(p_name, 'ring')")
url("fn_contains_list", "/Orders?$filter=contains(o_orderpriority,('1-URGENT','5-LOW'))&$select=o_orderkey", "select o_orderkey from orders where o_orderpriority in ('1-URGENT', '5-LOW')")
url(
    "fn_date",
    "/Events?compute=year(ts) as y,month(ts) as mo,day(ts) as d,hour(ts) as h,minute(ts) as mi,second(ts) as s,fractionalseconds(ts) as f,totaloffsetminutes(ts) as o,date(ts) as dd,time(ts) as tt&$select=event_id,y,mo,d,h,mi,s,f,o,dd,tt",
    "select event_id, cast(year(ts) as int) as y, cast(month(ts) as int) as mo, cast(day(ts) as int) as d, cast(hour(ts) as int) as h, cast(minute(ts) as int) as mi, cast(second(ts) as int) as s, cast(millisecond(ts) % 1000 as int) as f, 0 as o, cast(ts as date) as dd, strftime(ts, '%H:%M:%S.%f') as tt from events where event_type in ('click', 'view', 'purchase')",
)
url("fn_math", "/Customers?compute=round(c_acctbal) as r,floor(c_acctbal) as fl,ceiling(c_acctbal) as ce&$select=c_custkey,r,fl,ce", "select c_custkey, round(c_acctbal) as r, cast(floor(c_acctbal) as bigint) as fl, cast(ceil(c_acctbal) as bigint) as ce from customer")
url("fn_cast", "/Parts?compute=cast(p_size,'Edm.String') as s,cast(p_retailprice,'Edm.Int64') as i,cast(p_size,Edm.Double) as f&$select=p_partkey,s,i,f", "select p_partkey, cast(p_size as varchar) as s, cast(trunc(p_retailprice) as bigint) as i, cast(p_size as double) as f from part")
url("fn_seconds", "/Orders?$filter=totalseconds(duration'PT1H30M') eq 5400 and o_orderdate gt mindatetime() and o_orderdate lt maxdatetime()&$select=o_orderkey", "select o_orderkey from orders")
url("compute_filter", "/LineItems?compute=l_extendedprice mul (1 sub l_discount) as net&$filter=net gt 90000&$select=l_orderkey,l_linenumber,net", "select l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) as net from lineitem where l_extendedprice * (1 - l_discount) > 90000")

# -- navigations ------------------------------------------------------------------------------------------------------------
url("nav_filter", "/LineItems?$filter=Order/Customer/Nation/Region/r_name eq 'ASIA' and Supplier/Nation/n_name eq 'CHINA' or Order/o_totalprice gt 490000&$select=l_orderkey,l_suppkey,l_quantity", "select l_orderkey, l_suppkey, l_quantity from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation cn on c_nationkey = cn.n_nationkey join region on cn.n_regionkey = r_regionkey join supplier on l_suppkey = s_suppkey join nation sn on s_nationkey = sn.n_nationkey where r_name = 'ASIA' and sn.n_name = 'CHINA' or o_totalprice > 490000")
url("path_key_nav", "/Customers(7)/Orders?$select=o_orderkey,o_totalprice", "select o_orderkey, o_totalprice from orders where o_custkey = 7")
url("path_nav_chain", "/Regions(2)/Nations/Customers?$filter=c_acctbal lt 0&$select=c_custkey", "select c_custkey from customer join nation on c_nationkey = n_nationkey where n_regionkey = 2 and c_acctbal < 0")
url("path_key_named", "/Orders(o_orderkey=5)/Customer", "select c.* from customer c join orders on o_custkey = c_custkey where o_orderkey = 5")
url("path_property", "/Customers(3)/c_name", "select c_name from customer where c_custkey = 3")
url("path_ref", "/Customers(3)/Orders/$ref", "select 'Orders(' || o_orderkey || ')' as uri from orders where o_custkey = 3")
url("m2n_filter", "/Parts?$filter=Suppliers/any(s: s/s_acctbal gt 9900)&$select=p_partkey", "select p_partkey from part where exists (select 1 from lineitem join supplier on l_suppkey = s_suppkey where l_partkey = p_partkey and s_acctbal > 9900)")
url("m2n_path", "/Suppliers(5)/Parts?$select=p_partkey,p_name", "select p_partkey, p_name from part where p_partkey in (select l_partkey from lineitem where l_suppkey = 5)")

# -- any and all ------------------------------------------------------------------------------------------------------------
url("any_filter", "/Customers?$filter=Orders/any(o: o/o_totalprice gt 450000)&$select=c_custkey", "select c_custkey from customer where exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 450000)")
url("any_empty", "/Orders?$filter=LineItems/any()&$select=o_orderkey", "select o_orderkey from orders where exists (select 1 from lineitem where l_orderkey = o_orderkey)")
url("not_any", "/Orders?$filter=not LineItems/any(l: l/l_quantity gt 10)&$select=o_orderkey", "select o_orderkey from orders where not exists (select 1 from lineitem where l_orderkey = o_orderkey and l_quantity > 10)")
url("any_eq_false", "/Orders?$filter=LineItems/any(l: l/l_tax gt 0.05) eq false&$select=o_orderkey", "select o_orderkey from orders where not exists (select 1 from lineitem where l_orderkey = o_orderkey and l_tax > 0.05)")
url("all_filter", "/Orders?$filter=LineItems/all(l: l/l_quantity ge 20 and l/l_returnflag ne 'R')&$select=o_orderkey", "select o_orderkey from orders where not exists (select 1 from lineitem where l_orderkey = o_orderkey and not (l_quantity >= 20 and l_returnflag <> 'R'))")
url("any_in_or", "/Customers?$filter=c_acctbal lt -900 or Orders/any(o: o/o_orderpriority eq '1-URGENT' and o/o_totalprice gt 400000)&$select=c_custkey", "select c_custkey from customer where c_acctbal < -900 or exists (select 1 from orders where o_custkey = c_custkey and o_orderpriority = '1-URGENT' and o_totalprice > 400000)")
url("any_nested", "/Customers?$filter=Orders/any(o: o/LineItems/any(l: l/Part/p_size eq 50) and o/o_orderstatus eq 'F')&$select=c_custkey", "select c_custkey from customer where exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'F' and exists (select 1 from lineitem join part on l_partkey = p_partkey where l_orderkey = o_orderkey and p_size = 50))")
url("any_path", "/Nations?$filter=Customers/Orders/any(o: o/o_totalprice gt 498000)&$select=n_nationkey", "select n_nationkey from nation where exists (select 1 from customer join orders on o_custkey = c_custkey where c_nationkey = n_nationkey and o_totalprice > 498000)")
url("any_outer", "/Customers?$filter=Orders/any(o: o/o_totalprice gt c_acctbal mul 60)&$select=c_custkey", "select c_custkey from customer where exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > c_acctbal * 60)")

# -- aggregation ------------------------------------------------------------------------------------------------------------
url("agg_global", "/Orders?aggregate=o_totalprice with max as top,o_totalprice with min as least,* with count as n,o_custkey with countdistinct as customers", "select max(o_totalprice) as top, min(o_totalprice) as least, count(*) as n, count(distinct o_custkey) as customers from orders")
url("groupby_nav", "/Orders?groupby=(Customer/c_mktsegment,o_orderstatus)&aggregate=o_orderkey with count as n,o_custkey with max as last", 'select c_mktsegment as "Customer_c_mktsegment", o_orderstatus, count(o_orderkey) as n, max(o_custkey) as last from orders join customer on o_custkey = c_custkey group by 1, 2')
url("groupby_fn", "/Orders?groupby=(year(o_orderdate))&aggregate=year(o_orderdate) as y,count as n", "select cast(year(o_orderdate) as int) as y, count(*) as n from orders group by 1")
url("rollup_mixed", "/LineItems?groupby=(l_linestatus,rollup(l_returnflag,l_linenumber))&aggregate=* with count as n,l_quantity with max as q", "select l_linestatus, l_returnflag, l_linenumber, count(*) as n, max(l_quantity) as q from lineitem group by l_linestatus, rollup(l_returnflag, l_linenumber)")
url("agg_ratio", "/Parts?groupby=(p_brand)&aggregate=(p_size with sum) divby (p_partkey with count) as ratio", "select p_brand, cast(sum(p_size) as double) / count(p_partkey) as ratio from part group by 1")
url("agg_expr", "/Parts?groupby=(p_brand)&aggregate=(p_size mul 2 add 1) with sum as t,p_size with average as mean", "select p_brand, cast(sum(p_size * 2 + 1) as bigint) as t, avg(p_size) as mean from part group by 1")
url("agg_having", "/Orders?groupby=(o_custkey)&aggregate=* with count as n&having=n gt 14&$orderby=n desc,o_custkey&$top=10", "select o_custkey, count(*) as n from orders group by 1 having count(*) > 14 order by n desc, o_custkey limit 10")
url("agg_from", "/Orders?groupby=(o_orderstatus)&aggregate=o_orderkey with count as most from o_custkey with max", "select o_orderstatus, max(c) as most from (select o_orderstatus, o_custkey, count(o_orderkey) as c from orders group by 1, 2) group by 1")
url("agg_to_many", "/Customers?groupby=(c_mktsegment)&aggregate=Orders/LineItems/l_quantity with max as q,Orders/o_orderkey with countdistinct as n", "select c_mktsegment, max(l_quantity) as q, count(distinct o_orderkey) as n from customer join orders on o_custkey = c_custkey join lineitem on l_orderkey = o_orderkey group by 1")
url("group_distinct", "/Parts?groupby=(p_brand,p_type)", "select distinct p_brand, p_type from part")
url("group_polymorphic", "/Events?groupby=(event_type)&aggregate=* with count as n,value with max as top", "select event_type, count(*) as n, max(case when event_type <> 'view' then value end) as top from events where event_type in ('click', 'view', 'purchase') group by 1")
url("agg_digest", "/Parts?aggregate=p.cardinality(p_size) with merge as n,p.minimum(p_size) with merge as lo,p.maximum(p_size) with merge as hi,eh.cardinality(p_brand) with merge as eh", "select count(p_size) as n, min(p_size) as lo, max(p_size) as hi, cast(count(p_brand) as double) as eh from part")


@made("total_count", "select count(*) as total from orders where o_totalprice > 300000")
def total_count(spark, sf_dir):
    return star_session(spark, sf_dir).total("/Orders?$filter=o_totalprice gt 300000&$top=5&$count=true")


@made("total_groups", "select count(*) as total from (select distinct o_custkey, o_orderstatus from orders)")
def total_groups(spark, sf_dir):
    return star_session(spark, sf_dir).total("/Orders?groupby=(o_custkey,o_orderstatus)&$top=3")


@made("quantile", "select p_brand, cast(quantile_disc(p_size, 0.5) as int) as q from part group by 1")
def quantile(spark, sf_dir):
    return star_session(spark, sf_dir).query("/Parts?groupby=(p_brand)&aggregate=P.GetQuantile(p_size,0.5) with merge as q")


# -- $apply -----------------------------------------------------------------------------------------------------------------
url("apply_groupby", "/Orders?$apply=filter(o_totalprice gt 1000)/groupby((o_orderstatus,Customer/c_mktsegment),aggregate(o_totalprice with max as m,* with count as n))/filter(n gt 10)", 'select o_orderstatus, c_mktsegment as "Customer_c_mktsegment", max(o_totalprice) as m, count(*) as n from orders join customer on o_custkey = c_custkey where o_totalprice > 1000 group by 1, 2 having count(*) > 10')
url("apply_topcount", "/Parts?$apply=topcount(7,p_retailprice)/aggregate(p_size with max as m,* with count as n)", "select max(p_size) as m, count(*) as n from (select * from part order by p_retailprice desc, p_partkey limit 7)")
url("apply_bottomcount", "/Customers?$apply=bottomcount(9,c_acctbal)", "select c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment from customer order by c_acctbal, c_custkey limit 9")
url(
    "apply_toppercent",
    "/Suppliers?$apply=filter(s_acctbal gt 0)/toppercent(20,s_acctbal)",
    "select s_suppkey, s_name, s_nationkey, s_acctbal from (select *, coalesce(sum(s_acctbal) over (order by s_acctbal desc, s_suppkey rows between unbounded preceding and 1 preceding), 0) as b, sum(s_acctbal) over () as t from supplier where s_acctbal > 0) where b < t * 20 / 100",
)
url("apply_topsum", "/Suppliers?$apply=topsum(60000,s_acctbal)", "select s_suppkey, s_name, s_nationkey, s_acctbal from (select *, coalesce(sum(s_acctbal) over (order by s_acctbal desc, s_suppkey rows between unbounded preceding and 1 preceding), 0) as b from supplier) where b < 60000")
url("apply_concat", "/Nations?$apply=concat(filter(n_regionkey eq 1),groupby((n_regionkey),aggregate(* with count as n)))", "select n_nationkey, n_name, n_regionkey, null::bigint as n from nation where n_regionkey = 1 union all select null, null, n_regionkey, count(*) from nation group by n_regionkey")
url("apply_group_top", "/Customers?$apply=groupby((c_nationkey),topcount(2,c_acctbal))", "select c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment from (select *, row_number() over (partition by c_nationkey order by c_acctbal desc, c_custkey) as r from customer) where r <= 2")


# -- $expand, flattened for comparison --------------------------------------------------------------------------------------
@made("expand_to_one", "select doc_id, quality, toxic from documents left join labels using (doc_id)")
def expand_to_one(spark, sf_dir):
    df = star_session(spark, sf_dir).query("/Documents?$select=doc_id&$expand=Label($select=quality,toxic)")
    return df.select("doc_id", "Label.quality", "Label.toxic")


@made("expand_collection", "select c_custkey, o_orderkey, o_totalprice from customer left join (select * from orders where o_orderstatus = 'P') on o_custkey = c_custkey")
def expand_collection(spark, sf_dir):
    df = star_session(spark, sf_dir).query("/Customers?$select=c_custkey&$expand=Orders($filter=o_orderstatus eq 'P';$select=o_orderkey,o_totalprice;$orderby=o_totalprice desc)")
    return df.select("c_custkey", F.explode_outer("Orders").alias("o")).select("c_custkey", "o.o_orderkey", "o.o_totalprice")


@made(
    "expand_page",
    "select c_custkey, r - 1 as place, o_orderkey, o_totalprice from (select *, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) - 1 as r from orders) join (select * from customer order by c_custkey limit 40) on o_custkey = c_custkey where r between 1 and 3",
)
def expand_page(spark, sf_dir):
    df = star_session(spark, sf_dir).query("/Customers?$select=c_custkey&$top=40&$expand=Orders($orderby=o_totalprice desc;$skip=1;$top=3;$select=o_orderkey,o_totalprice)")
    return df.select("c_custkey", F.posexplode("Orders").alias("p", "o")).select("c_custkey", F.col("p").cast("long").alias("place"), "o.o_orderkey", "o.o_totalprice")


@made(
    "expand_nested",
    "select r_name, n_name, s_suppkey from region join nation on n_regionkey = r_regionkey join supplier on s_nationkey = n_nationkey where s_acctbal > 5000",
)
def expand_nested(spark, sf_dir):
    df = star_session(spark, sf_dir).query("/Regions?$expand=Nations($expand=Suppliers($filter=s_acctbal gt 5000))")
    df = df.select("r_name", F.explode("Nations").alias("n")).select("r_name", "n.n_name", F.explode("n.Suppliers").alias("s"))
    return df.select("r_name", "n_name", "s.s_suppkey")


@made("expand_m2n", "select s_suppkey, p_partkey from supplier join (select distinct l_suppkey, l_partkey from lineitem) on l_suppkey = s_suppkey join part on l_partkey = p_partkey where p_size < 3")
def expand_m2n(spark, sf_dir):
    df = star_session(spark, sf_dir).query("/Suppliers?$select=s_suppkey&$expand=Parts($filter=p_size lt 3;$select=p_partkey)")
    return df.select("s_suppkey", F.explode("Parts").alias("p")).select("s_suppkey", "p.p_partkey")


# -- inheritance and unions -------------------------------------------------------------------------------------------------
url(
    "polymorphic_scan",
    "/Events",
    "select event_id, ts, user_id, event_type, case when event_type <> 'view' then value end as value, case when event_type = 'view' then props end as props, case event_type when 'click' then 'ClickEvent' when 'view' then 'ViewEvent' else 'PurchaseEvent' end as \"$TypeName\" from events where event_type in ('click', 'view', 'purchase')",
)
url("isof", "/Events?$filter=isof('PurchaseEvent') and user_id lt 20&$select=event_id,value", "select event_id, value from events where event_type = 'purchase' and user_id < 20")
url("cast_path", "/Events/Model.ClickEvent?$filter=value gt 50&$select=event_id,value", "select event_id, value from events where event_type = 'click' and value > 50")
url("table_per_type", "/PurchaseEvents?$filter=value gt 10&$select=event_id,user_id,value", "select event_id, user_id, value from events where event_type = 'purchase' and value > 10")


@made("union_align", "select c_custkey as k, c_acctbal as a, null::varchar as n from customer union all select null, s_acctbal, s_name from supplier")
def union_align(spark, sf_dir):
    s = star_session(spark, sf_dir)
    return union(s.query("/Customers").selectExpr("c_custkey as k", "c_acctbal as a"), s.query("/Suppliers").selectExpr("s_acctbal as a", "s_name as n"))


@made("union_distinct", "select n_regionkey as k from nation union select r_regionkey from region")
def union_distinct(spark, sf_dir):
    s = star_session(spark, sf_dir)
    return union(s.query("/Nations").selectExpr("n_regionkey as k"), s.query("/Regions").selectExpr("r_regionkey as k"), distinct=True)


@made("fan_out_contexts", "select r_regionkey, r_name, c as context from region, (values (0), (1)) t(c) where r_regionkey < 3")
def fan_out_contexts(spark, sf_dir):
    return fan_out("/Regions?$filter=r_regionkey lt 3", [star_session(spark, sf_dir), star_session(spark, sf_dir)], "context")


@made("shard_subset", "select o_orderkey, cast(o_custkey % 8 as int) as shardlet, case when o_custkey % 8 in (1, 3) then 'b' else 'a' end as shard_name from orders where o_custkey % 8 in (1, 2, 3)")
def shard_subset(spark, sf_dir):
    m = shards.ShardMap({"a": set(), "b": set()})
    for k in range(8):
        m.add(k, shards.even_odd)
    c = star_catalog(spark, sf_dir)
    df = c.table("orders").withColumn("shardlet", (F.col("o_custkey") % 8).cast("int"))
    return m.query(df, "shardlet", m.route("1,2,3")).select("o_orderkey", "shardlet", "shard_name")


@made("shard_aggregate", "select o_orderstatus, count(*) as n from orders where o_custkey % 8 in (0, 5) group by 1")
def shard_aggregate(spark, sf_dir):
    from quillon.api import Session

    base = star_catalog(spark, sf_dir)
    tables = base.tables | {"orders": lambda c: star_catalog(spark, sf_dir).table("orders").withColumn("shardlet", (F.col("o_custkey") % 8).cast("int"))}
    return Session(spark, star_model(), Catalog(spark, sf_dir, tables, "shardlet")).query("/Orders?shard=0,5&groupby=(o_orderstatus)&aggregate=* with count as n")


# -- writes as snapshots ----------------------------------------------------------------------------------------------------
def _source(spark, sf_dir):
    """Changed and new customers: every third key changed, and as many new keys."""
    c = star_catalog(spark, sf_dir).table("customer")
    old = c.where("c_custkey % 3 = 0").select("c_custkey", (F.col("c_acctbal") + F.when(F.col("c_custkey") % 2 == 0, 100.0).otherwise(0.0)).alias("c_acctbal"))
    return c, old.union(c.where("c_custkey % 3 = 1").select((F.col("c_custkey") + 1_000_000).alias("c_custkey"), F.lit(1.5)))


_CHANGED = "select c_custkey as k, c_acctbal + case when c_custkey % 2 = 0 then 100.0 else 0.0 end as a from customer where c_custkey % 3 = 0 union all select c_custkey + 1000000, 1.5 from customer where c_custkey % 3 = 1"


@made("merge_upsert", f"with s as ({_CHANGED}) select coalesce(c_custkey, k) as c_custkey, c_name, c_nationkey, coalesce(a, c_acctbal) as c_acctbal, c_mktsegment from customer full join s on c_custkey = k")
def merge_upsert(spark, sf_dir):
    c, s = _source(spark, sf_dir)
    return merge.merge(c, s, ["c_custkey"])


@made(
    "merge_changed_only",
    f"with s as ({_CHANGED}) select coalesce(c_custkey, k) as c_custkey, coalesce(a, c_acctbal) as c_acctbal, case when c_custkey is null or a <> c_acctbal then timestamp '2024-01-02 03:04:05' end as updated from customer full join s on c_custkey = k",
)
def merge_changed_only(spark, sf_dir):
    c, s = _source(spark, sf_dir)
    t = c.select("c_custkey", "c_acctbal", F.lit(None).cast("timestamp_ntz").alias("updated"))
    return merge.merge(t, s, ["c_custkey"], only_changed=True, updated_time="updated", now=dt.datetime(2024, 1, 2, 3, 4, 5))


@made("merge_actions", f"with s as ({_CHANGED}) select action, count(*) as n from (select case when k is null then 'DELETE' when c_custkey is null then 'INSERT' else 'UPDATE' end as action from customer full join s on c_custkey = k) group by 1")
def merge_actions(spark, sf_dir):
    c, s = _source(spark, sf_dir)
    return merge.merge(c, s, ["c_custkey"], delete_unmatched=True, action=True).groupBy("action").agg(F.count("*").alias("n"))


@made("delete_key", "select * from nation where n_regionkey <> 2")
def delete_key(spark, sf_dir):
    n = star_catalog(spark, sf_dir).table("nation")
    return merge.delete(n, n.where("n_regionkey = 2").select("n_nationkey"), ["n_nationkey"])


@made("insert_rows", "select * from region union all select r_regionkey + 5, 'NEW ' || r_name from region")
def insert_rows(spark, sf_dir):
    r = star_catalog(spark, sf_dir).table("region")
    return merge.insert(r, r.select((F.col("r_regionkey") + 5).alias("r_regionkey"), F.concat(F.lit("NEW "), "r_name").alias("r_name")))


@made("insert_identity", "select n_name, n_nationkey + 1 as id from nation union all select r_name, 25 + row_number() over (order by r_regionkey) from region")
def insert_identity(spark, sf_dir):
    n = star_catalog(spark, sf_dir).table("nation").select("n_name", (F.col("n_nationkey") + 1).cast("long").alias("id"))
    r = star_catalog(spark, sf_dir).table("region").orderBy("r_regionkey").select(F.col("r_name").alias("n_name"))
    return merge.insert(n, r, identity="id")


@made(
    "merge_update_unmatched",
    f"with s as ({_CHANGED}) select coalesce(c_custkey, k) as c_custkey, case when k is null then 'GONE' else c_mktsegment end as c_mktsegment, coalesce(a, c_acctbal) as c_acctbal from customer full join s on c_custkey = k",
)
def merge_update_unmatched(spark, sf_dir):
    c, s = _source(spark, sf_dir)
    return merge.merge(c.select("c_custkey", "c_mktsegment", "c_acctbal"), s, ["c_custkey"], update_unmatched={"c_mktsegment": F.lit("GONE")})


@made(
    "merge_concurrency",
    "select s_suppkey, case when s_suppkey % 2 = 0 then s_acctbal + 1 else s_acctbal end as s_acctbal, case when s_suppkey % 2 = 0 then 2 else 1 end as ver from supplier",
)
def merge_concurrency(spark, sf_dir):
    t = star_catalog(spark, sf_dir).table("supplier").select("s_suppkey", "s_acctbal", F.lit(1).alias("ver"))
    return merge.merge(t, t.where("s_suppkey % 2 = 0").withColumn("s_acctbal", F.col("s_acctbal") + 1), ["s_suppkey"], concurrency="ver")


@made("deep_write", "select n_nationkey, n_name, n_regionkey from nation union all select 100 + r_regionkey, 'In ' || r_name, r_regionkey from region")
def deep_write(spark, sf_dir):
    """Regions with nested new nations: the parents' rows, then the children's with their foreign key."""
    from quillon.operators.graph import deep_write as write

    m = star_model()
    tables = {k: spark.read.parquet(f"{sf_dir}/{k}.parquet") for k in ("region", "nation")}
    child = F.array(F.struct((F.col("r_regionkey") + 100).alias("n_nationkey"), F.concat(F.lit("In "), "r_name").alias("n_name")))
    return write(m, m.type("Region"), tables["region"].withColumn("Nations", child))(tables)["nation"]


@made("link_bridge", "select distinct l_partkey, l_suppkey from lineitem union select p_partkey, 1 from part where p_partkey < 50")
def link_bridge(spark, sf_dir):
    m = star_model()
    bridge = star_catalog(spark, sf_dir).table("lineitem").select("l_partkey", "l_suppkey").distinct()
    pairs = star_catalog(spark, sf_dir).table("part").where("p_partkey < 50").select(F.col("p_partkey").alias("host_p_partkey"), F.lit(1).cast("long").alias("member_s_suppkey"))
    t = m.type("Part")
    return merge.link(m, t, t.navigations["Suppliers"], {"lineitem": bridge}, pairs)["lineitem"]


@made("unlink_fk", "select n_nationkey, n_name, case when n_regionkey = 1 then null else n_regionkey end as n_regionkey from nation")
def unlink_fk(spark, sf_dir):
    m = star_model()
    n = star_catalog(spark, sf_dir).table("nation")
    pairs = n.where("n_regionkey = 1").select(F.col("n_nationkey").alias("host_n_nationkey"), F.col("n_regionkey").alias("member_r_regionkey"))
    t = m.type("Nation")
    return merge.unlink(m, t, t.navigations["Region"], {"nation": n}, pairs)["nation"]


@made(
    "changelog_diff",
    "select s_suppkey, p as property, pre, post, 1 as op from (select s_suppkey, 's_nationkey' as p, s_nationkey::varchar as pre, ((s_nationkey + 1) % 25)::varchar as post from supplier where s_suppkey % 2 = 0) union all "
    "select s_suppkey + 500000, x.p, null, x.v, 0 from supplier, lateral (values ('s_name', s_name), ('s_nationkey', s_nationkey::varchar)) x(p, v) where s_suppkey < 5",
)
def changelog_diff(spark, sf_dir):
    s = star_catalog(spark, sf_dir).table("supplier").select("s_suppkey", "s_name", "s_nationkey")
    after = s.withColumn("s_nationkey", F.when(F.col("s_suppkey") % 2 == 0, (F.col("s_nationkey") + 1) % 25).otherwise(F.col("s_nationkey")))
    after = after.union(s.where("s_suppkey < 5").withColumn("s_suppkey", F.col("s_suppkey") + 500_000))
    return merge.changes(s, after, ["s_suppkey"])


@made("changelog_links", "select n_nationkey, r as n_regionkey, op from (select n_nationkey, n_regionkey as r, 3 as op from nation where n_nationkey < 4 union all select n_nationkey, (n_regionkey + 1) % 5, 2 from nation where n_nationkey < 4)")
def changelog_links(spark, sf_dir):
    n = star_catalog(spark, sf_dir).table("nation").select("n_nationkey", "n_regionkey")
    after = n.withColumn("n_regionkey", F.when(F.col("n_nationkey") < 4, (F.col("n_regionkey") + 1) % 5).otherwise(F.col("n_regionkey")))
    return merge.link_changes(n, after, ["n_nationkey", "n_regionkey"])


# -- mapping, incremental, time aggregates ----------------------------------------------------------------------------------
@made("mapped_reader", "select o_orderkey as id, case o_orderstatus when 'F' then '1' when 'O' then '2' else o_orderstatus end as status, o_orderpriority as priority from orders where o_totalprice > 400000")
def mapped_reader(spark, sf_dir):
    df = etl.filtered(star_catalog(spark, sf_dir).table("orders"), {"o_totalprice": lambda c: c > 400_000})
    return etl.mapped(df, [etl.ColumnMap("id", "o_orderkey"), etl.ColumnMap("status", "o_orderstatus", {"F": "1", "O": "2"}), etl.ColumnMap("priority", "o_orderpriority")])


@made("nav_key_collapse", 'select c_custkey as id, n_nationkey as nation from customer join nation on c_nationkey = n_nationkey')
def nav_key_collapse(spark, sf_dir):
    df = star_session(spark, sf_dir).query("/Customers?$select=c_custkey&$expand=Nation($select=n_nationkey)")
    return etl.mapped(df, [etl.ColumnMap("id", "c_custkey"), etl.ColumnMap("nation", "Nation", key="n_nationkey")])


@made("incremental_refresh", "select user_id, max(ts) as ts from events where event_type <> 'error' group by 1")
def incremental_refresh(spark, sf_dir):
    """Two loads of events, the second since the first's watermark, merged into one row for each user."""
    e = star_catalog(spark, sf_dir).table("events").where("event_type <> 'error'").select("user_id", "ts")
    mark = F.lit("2024-01-02 00:00:00").cast("timestamp_ntz")
    first, second = latest(e.where(F.col("ts") < mark), ["user_id"], "ts"), latest(e.where(F.col("ts") >= mark), ["user_id"], "ts")
    return merge.merge(first, second, ["user_id"])


@made("time_agg_latest", "select date_trunc('day', ts) as period, event_type, max(value) as top, min(value) as least, arg_max(value, (ts, value)) as last from events group by 1, 2")
def time_agg_latest(spark, sf_dir):
    e = star_catalog(spark, sf_dir).table("events")
    return etl.time_aggregate(e, "ts", "Daily", ["event_type"], {"top": ("max", "value"), "least": ("min", "value"), "last": ("latest", "value")})


@made("retention", "select event_id from events where ts >= (timestamp '2024-01-03 00:00:00' - interval 1 day)")
def retention(spark, sf_dir):
    e = star_catalog(spark, sf_dir).table("events")
    return etl.retained(e, "ts", 1, F.lit("2024-01-03 00:00:00").cast("timestamp_ntz")).select("event_id")


@made("banding", "select p_partkey, case when p_size < 10 then 'small' when p_size < 30 then 'medium' else 'large' end as band from part")
def banding(spark, sf_dir):
    p = star_catalog(spark, sf_dir).table("part")
    return etl.banded(p, "p_size", [(None, 10, "small"), (10, 30, "medium"), (30, None, "large")], "band").select("p_partkey", "band")


@made("json_payload", "select event_id, cast(json_extract_string(props, '$.k') as bigint) as k from events")
def json_payload(spark, sf_dir):
    from quillon.sources.feeds import read_payload

    e = star_catalog(spark, sf_dir).table("events")
    text = F.concat(F.lit('{"value":[{"event_id":'), F.col("event_id").cast("string"), F.lit(',"k":'), F.get_json_object("props", "$.k"), F.lit("}]}"))
    from pyspark.sql import types as T

    return read_payload(spark, e.select(text.alias("payload")), T.StructType([T.StructField("event_id", T.LongType()), T.StructField("k", T.LongType())]))


@made("procedure", "select * from nation where n_regionkey = 3")
def procedure(spark, sf_dir):
    c = star_catalog(spark, sf_dir)
    c.procedure("NationsOf", lambda spark, region: c.table("nation").where(F.col("n_regionkey") == region))
    return c.call("nationsof", region=3)

