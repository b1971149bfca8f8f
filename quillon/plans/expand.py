"""$expand: targets of navigations nested into their owners, level by level.

A collection is filtered, ordered and paged per owner, gathered into an array of structs and joined to the owner on its key;
a single target becomes a struct. Owners stay when they have no targets; a collection then is empty. Where the roots are
a page, targets are first cut down to those of the page's rows by a semi join, level by level, so that no other target is shuffled.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.lang import ast as A
from quillon.model import Navigation
from quillon.plans.columns import BindError, column, ref


#: Rows of a page whose keys are broadcast to its targets.
BROADCAST = 10_000


def expanded(planner, rows, df: DataFrame, q: A.Query, columns: list[Column], page: int | None = None) -> DataFrame:
    """df: rows' frame, filtered and paged; page: how many rows it has at most, if that is known. columns: what the query itself projects."""
    placed = bool(q.orderby or q.top is not None or q.skip)
    out = nested(planner, rows, df.withColumn("?order", F.monotonically_increasing_id()) if placed else df, q, columns, ["?order"] if placed else [], df if page is not None else None, page)
    if placed:
        out = out.orderBy(ref("?order"))
    return out.drop(*[c for c in out.columns if c.startswith("?")])


def nested(planner, rows, df: DataFrame, q: A.Query, columns: list[Column], carried: list[str], owners: DataFrame | None = None, page: int | None = None) -> DataFrame:
    """columns and carried of df, and a column for each navigation that q expands. Helpers' names are unique in the plan. owners: df's
    rows if they are few of all, page of them at most."""
    tagged, links = [], []
    for e in q.expand:
        nav = rows._navigations(rows.type).get(e.path[0])
        if nav is None:
            raise BindError(f"{rows.type.name} has no navigation {e.path[0]!r}")
        planner.quantifiers += 1
        own = [f"?own{planner.quantifiers}.{k}" for k in range(len(nav.pairs))]
        links += [ref(rows.name((a,))).alias(n) for (a, _), n in zip(nav.pairs, own, strict=True)]
        few = None
        if owners is not None:
            few = owners.select(*[ref(rows.name((a,))).alias(f"{n}!") for (a, _), n in zip(nav.pairs, own, strict=True)])
            few = F.broadcast(few) if page is not None and page <= BROADCAST else few
        tagged.append((e, nav, own, few))
    out = df.select(*columns, *[ref(c) for c in carried], *links)
    for e, nav, own, few in tagged:
        out = joined(planner, out, e, nav, own, few).drop(*own)
    return out


def joined(planner, out: DataFrame, e: A.Expand, nav: Navigation, own: list[str], few: DataFrame | None = None) -> DataFrame:
    from quillon.plans.reader import Rows

    planner.quantifiers += 1
    tag, q = f"?to{planner.quantifiers}.", e.query
    target = planner.model.type(nav.target)
    cast = next((p for p in e.path[1:] if "." in p), None)
    deeper = tuple(p for p in e.path[1:] if "." not in p)
    if deeper:
        q = replace(q, expand=[*q.expand, A.Expand(deeper)])
    if e.levels > 1:
        q = replace(q, expand=[*q.expand, A.Expand(e.path, e.query, e.levels - 1)])
    if cast:
        q = replace(q, filter=A.conjunction([x for x in (A.Func("isof", (A.Lit(cast, "string"),)), q.filter) if x is not None]))
    if e.ref:
        q = replace(q, select=[A.Path((p,)) for p in planner.model.key(target)])
    child, names = Rows(planner, target, planner.scan(target)), [f"{tag}{k}" for k in range(len(nav.pairs))]
    asked = lambda df: df if few is None else df.join(few, [ref(n) == ref(c) for n, c in zip(names, few.columns, strict=True)], "left_semi")
    if nav.bridge:
        far = [f"{tag}far{k}" for k in range(len(nav.bridge_pairs))]
        b = planner.bridge(nav).select(*[ref(c).alias(n) for (_, c), n in zip(nav.pairs, names, strict=True)], *[ref(c).alias(n) for (c, _), n in zip(nav.bridge_pairs, far, strict=True)])
        child.df = child.df.join(asked(b), [ref(n) == ref(d) for (_, d), n in zip(nav.bridge_pairs, far, strict=True)]).drop(*far)
    else:
        child.df = asked(child.df.select("*", *[ref(b).alias(n) for (_, b), n in zip(nav.pairs, names, strict=True)]))
    held, planner.aliases = planner.aliases, {n.alias: n.expr for n in q.compute}
    child.where(A.conjunction([x for x in (q.filter, q.where) if x is not None]), None, planner.aliases)
    child.need(*[n.expr for n in q.compute], *[o.expr for o in q.orderby])
    s = child.scope(None, planner.aliases)
    columns = planner.projection(child, q, s)
    keys = planner.model.key(target)
    order = [planner._order(column(o.expr, s), o.descending) for o in q.orderby] + [ref(p).asc() for p in keys]
    planner.aliases = held
    if nav.many and (q.top is not None or q.skip) and not order:
        raise BindError(f"{target.name} has no key to page by; give $orderby")
    place, row = f"{tag}place", f"{tag}row"
    paged = q.top is not None or bool(q.skip)
    rising = bool(order) and not paged and not any(o.descending for o in q.orderby)  # gathered values can be sorted as they are, with no window
    if not nav.many or not order:
        numbered = F.lit(0)
    elif rising:
        numbered = F.struct(*[x.alias(f"o{k}") for k, x in enumerate([*[column(o.expr, s) for o in q.orderby], *[ref(p) for p in keys]])])
    else:
        numbered = F.row_number().over(Window.partitionBy(*[ref(n) for n in names]).orderBy(*order))
    df, total = child.df.withColumn(place, numbered), None
    if q.count and nav.many:
        total = df.groupBy(*[ref(n) for n in names]).agg(F.count(F.lit(1)).alias(f"{tag}total"))
    if nav.many and paged:
        first = q.skip or 0
        df = df.where((ref(place) > first) & ((ref(place) <= first + q.top) if q.top is not None else F.lit(True)))
    df = nested(planner, child, df, q, columns, [*names, place], df if few is not None else None)
    df = df.select(*[ref(n) for n in names], ref(place), F.struct(*[ref(c) for c in df.columns if not c.startswith("?")]).alias(row))
    on = F.lit(True)
    for a, b in zip(own, names, strict=True):
        on = on & (ref(a) == ref(b))
    name = e.path[0]
    if not nav.many:
        return out.join(df.select(*[ref(n) for n in names], ref(row).alias(name)), on, "left").drop(*names)
    one = F.collect_list(F.struct(ref(place).alias("p"), ref(row).alias("r")))
    rising = rising and "map<" not in df.schema[row].dataType.simpleString()  # maps have no order
    listed = F.sort_array(one) if rising else F.array_sort(one, _by_place) if order else one
    gathered = df.groupBy(*[ref(n) for n in names]).agg(F.transform(listed, lambda x: x.r).alias(name))
    kind = gathered.schema[name].dataType
    out = out.join(gathered, on, "left").drop(*names).withColumn(name, F.coalesce(ref(name), F.array().cast(kind)))
    if total is not None:
        out = out.join(total, on, "left").drop(*names)
        out = out.withColumn(f"{name}@count", F.coalesce(ref(f"{tag}total"), F.lit(0).cast("long"))).drop(f"{tag}total")
    return out


def _by_place(a: Column, b: Column) -> Column:
    return F.when(a.p < b.p, -1).when(a.p > b.p, 1).otherwise(0)
