"""$apply: transformations in sequence, each from one frame to the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.lang import ast as A
from quillon.lang.apply import Step
from quillon.plans.columns import BindError, Scope, column, predicate, ref


def run_steps(planner, rows, steps: list[Step]) -> DataFrame:
    """The first steps may follow navigations from the entity's rows; after the first grouping only its columns are left."""
    from quillon.plans.reader import Rows

    df: DataFrame | None = None
    for k, step in enumerate(steps):
        if df is None:
            if step.name == "filter":
                rows.where(step.args[0])
                continue
            if step.name == "identity":
                continue
            if step.name in ("groupby", "aggregate"):
                df = _grouped(planner, rows, *(step.args if step.name == "groupby" else ([], [], [step])))
                continue
            if step.name == "expand":
                return _finish(planner, planner.read(rows, A.Query(expand=[step.args[0]])), rows, steps[k + 1 :])
            if step.name == "concat":
                parts = []
                for own in step.args[0]:
                    fresh = Rows(planner, rows.type, rows.df)
                    fresh.joined = dict(rows.joined)
                    parts.append(run_steps(planner, fresh, own))
                df = _concat(parts)
                continue
            df = rows.df.select(*planner.projection(rows, A.Query(), rows.scope()))
        df = transformed(planner, df, rows, step)
    return df if df is not None else rows.df.select(*planner.projection(rows, A.Query(), rows.scope()))


def _grouped(planner, rows, keys, rolled, below: list[Step]) -> DataFrame:
    if len(below) == 1 and below[0].name == "aggregate":
        return planner.aggregated(rows, A.Query(groupby=keys, rollup=rolled, aggregate=below[0].args[0]))
    if not below:
        return planner.aggregated(rows, A.Query(groupby=keys, rollup=rolled))
    if rolled or len(below) != 1:
        raise BindError("groupby takes aggregate or one ranking step")
    rows.need(*keys)
    names = {planner.key_name(e): column(e, rows.scope()) for e in keys}
    plain = rows.df.select(*planner.projection(rows, A.Query(), rows.scope()), *[c.alias(f"?{n}") for n, c in names.items()])
    return transformed(planner, plain, rows, below[0], [f"?{n}" for n in names]).drop(*[f"?{n}" for n in names])


def _concat(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def _finish(planner, df: DataFrame, rows, steps: list[Step]) -> DataFrame:
    for s in steps:
        df = transformed(planner, df, rows, s)
    return df


def transformed(planner, df: DataFrame, rows, step: Step, within: list[str] | None = None) -> DataFrame:
    """One step over a plain frame. within: columns inside whose groups a ranking step ranks."""

    def resolve(p):
        name = "_".join(p)
        if name not in df.columns:
            raise BindError(f"no column {'/'.join(p)!r} here")
        return ref(name), planner.model.properties(rows.type).get(name)

    s = Scope(planner.model, rows.type, resolve, planner.params, {}, planner.udfs)
    if step.name == "identity":
        return df
    if step.name == "filter":
        return df.where(predicate(step.args[0], s))
    if step.name == "compute":
        return df.select("*", *[column(n.expr, s).alias(n.alias) for n in step.args[0]])
    if step.name == "aggregate":
        return df.agg(*[column(n.expr, s).alias(n.alias) for n in step.args[0]])
    if step.name == "groupby":
        keys, rolled, below = step.args
        names = {planner.key_name(e): column(e, s) for e in (*keys, *rolled)}
        if rolled:
            raise BindError("rollup comes before other grouping")
        if below and below[0].name != "aggregate":
            marked = df.select("*", *[c.alias(f"?{n}") for n, c in names.items()])
            return transformed(planner, marked, rows, below[0], [f"?{n}" for n in names]).drop(*[f"?{n}" for n in names])
        aggs = [column(n.expr, s).alias(n.alias) for n in below[0].args[0]] if below else []
        grouped = df.groupBy(*[c.alias(n) for n, c in names.items()])
        return grouped.agg(*aggs) if aggs else df.select(*[c.alias(n) for n, c in names.items()]).distinct()
    if step.name == "concat":
        return _concat([_finish(planner, df, rows, own) for own in step.args[0]])
    if step.name in ("topcount", "bottomcount", "topsum", "bottomsum", "toppercent", "bottompercent"):
        return ranked(df, step.name, column(step.args[0], s), column(step.args[1], s), within or [])
    raise BindError(f"{step.name} isn't supported here")


def ranked(df: DataFrame, name: str, n, by, within: list[str]) -> DataFrame:
    """top/bottom count, sum or percent: the least many rows, from the largest (smallest) on, that are n rows, sum to n, or sum to n percent.

    Ties are broken by the other columns in order. Whole-table counts are a sorted limit, which doesn't move all rows.
    """
    down = name.startswith("top")
    kind = name.removeprefix("top").removeprefix("bottom")
    ties = [ref(c).asc_nulls_first() for c in df.columns if not c.startswith("?")]
    df = df.withColumn("?by", by).where(ref("?by").isNotNull())
    order = [ref("?by").desc() if down else ref("?by").asc(), *ties]
    if kind == "count" and not within:
        return df.orderBy(*order).limit(_number(df, n)).drop("?by")
    if not within:
        return _cumulated(df, kind, n, order, down).drop("?by")
    w = Window.partitionBy(*[ref(c) for c in within]).orderBy(*order)
    if kind == "count":
        return df.withColumn("?r", F.row_number().over(w)).where(ref("?r") <= n).drop("?r", "?by")
    before = F.coalesce(F.sum("?by").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    most = n if kind == "sum" else F.sum("?by").over(Window.partitionBy(*[ref(c) for c in within])) * n / 100
    return df.withColumn("?b", before).withColumn("?m", most).where(ref("?b") < ref("?m")).drop("?b", "?m", "?by")


def _number(df: DataFrame, n) -> int:
    return int(df.sparkSession.range(1).select(n.cast("int")).first()[0])


def _cumulated(df: DataFrame, kind: str, n, order, down: bool) -> DataFrame:
    """Rows from the largest (smallest) value on until their sum is reached.

    Rows of equal value are summed first; of the distinct values, groups of like size are summed, and each then starts from its
    offset, so that no task gets the whole table. The value at which the sum is reached, and how many of its rows it takes, is
    one row that is fetched while planning; rows beyond that value are a filter, those of it a sorted limit.
    """
    values = df.groupBy("?by").agg(F.count(F.lit(1)).alias("?n"))
    by = ref("?by").cast("double")
    values = values.withColumn("?group", F.signum(by) * F.floor(F.log2(F.abs(by) + 1) * 64))  # grows with the value
    sums = values.groupBy("?group").agg(F.sum(ref("?by") * ref("?n")).alias("?s"))
    w = Window.orderBy(ref("?group").desc() if down else ref("?group").asc())
    start = sums.select(ref("?group"), (F.sum("?s").over(w) - ref("?s")).alias("?start"))  # a row for each of some thousand groups
    w = Window.partitionBy("?group").orderBy(ref("?by").desc() if down else ref("?by").asc())
    own = values.join(F.broadcast(start), "?group").withColumn("?before", ref("?start") + F.sum(ref("?by") * ref("?n")).over(w) - ref("?by") * ref("?n"))
    most = n if kind == "sum" else df.agg((F.sum("?by") * n / 100).alias("m")).scalar()
    edge = own.where(ref("?before") < most).orderBy(ref("?by").asc() if down else ref("?by").desc()).limit(1)
    rows = F.when(ref("?by") > 0, F.least(ref("?n"), F.ceil((most - ref("?before")) / ref("?by")))).otherwise(ref("?n"))
    last = edge.select(ref("?by"), rows.cast("long").alias("rows")).first()
    if last is None:
        return df.limit(0)
    value = F.lit(last[0]).cast(df.schema["?by"].dataType)
    beyond = df.where(ref("?by") > value if down else ref("?by") < value)
    return beyond.unionByName(df.where(ref("?by") == value).orderBy(*order[1:]).limit(last["rows"]))
