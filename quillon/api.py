"""The session: URL queries in, DataFrames and write results out."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from quillon.functions.scalar import Udfs
from quillon.lang import ast as A
from quillon.lang.parser import parse_url
from quillon.model import EntityModel
from quillon.plans.columns import BindError
from quillon.plans.reader import Planner
from quillon.sources.catalog import Catalog, Stores


class Session:
    """Queries over one model. stores: a catalog, or named ones that `store=` picks from."""

    def __init__(self, spark: SparkSession, model: EntityModel, stores: Catalog | Stores, udfs: Udfs | None = None, page_sizes: dict[str, int] | None = None, post: list[Callable[[DataFrame], DataFrame]] | None = None):
        self.spark, self.model = spark, model
        self.stores = stores if isinstance(stores, Stores) else Stores(default=stores)
        self.udfs, self.page_sizes, self.post = udfs or Udfs(), page_sizes or {}, post or []
        self.operations: dict[str, Callable[..., Any]] = {}

    def planner(self, q: A.Query) -> Planner:
        return Planner(self.model, self.stores.pick(q.store), self.udfs, self.page_sizes, self.post)

    @staticmethod
    def _query(q: str | A.Query) -> A.Query:
        return parse_url(q) if isinstance(q, str) else q

    def query(self, q: str | A.Query) -> DataFrame:
        q = self._query(q)
        if len(q.path) == 1 and q.path[0].name.lower() in self.operations:
            return self.call(q.path[0].name, **{k: v.value for k, v in (q.path[0].keys or {}).items() if k})
        return self.planner(q).plan(q)

    def nested(self, q: str | A.Query) -> DataFrame:
        """A grouped query whose keys stand in the shape of their paths: Customer/Nation/n_name as Customer.Nation.n_name."""
        q = self._query(q)
        return regraphed(self.query(q), [e.parts for e in (*q.groupby, *q.rollup) if isinstance(e, A.Path) and len(e.parts) > 1])

    def total(self, q: str | A.Query) -> DataFrame:
        """One row with the number of rows without top and skip."""
        q = self._query(q)
        return self.planner(q).total(q)

    def count(self, q: str | A.Query) -> int:
        return int(self.total(q).first()["total"])

    def builder(self, entity_set: str) -> Builder:
        return Builder(self, A.Query(path=[A.Segment(entity_set)]))

    def operation(self, name: str, f: Callable[..., Any]) -> None:
        """A function or action: f(session, **parameters)."""
        self.operations[name.lower()] = f

    def call(self, name: str, **parameters) -> Any:
        if name.lower() not in self.operations:
            raise BindError(f"no operation {name!r}")
        return self.operations[name.lower()](self, **parameters)


class Builder:
    """Chained query building; what isn't offered here raises AttributeError rather than being passed over."""

    def __init__(self, session: Session, q: A.Query):
        self._session, self._q = session, q

    def _with(self, **changes) -> Builder:
        from dataclasses import replace

        return Builder(self._session, replace(self._q, **changes))

    def where(self, text: str) -> Builder:
        from quillon.lang.parser import parse_filter

        return self._with(filter=A.conjunction([x for x in (self._q.filter, parse_filter(text)) if x is not None]))

    def select(self, *paths: str) -> Builder:
        return self._with(select=[A.Path(tuple(p.split("/"))) for p in paths])

    def order_by(self, text: str, descending: bool = False) -> Builder:
        from quillon.lang.parser import parse_filter

        return self._with(orderby=[A.Order(parse_filter(text), descending)])

    def then_by(self, text: str, descending: bool = False) -> Builder:
        from quillon.lang.parser import parse_filter

        if not self._q.orderby:
            raise BindError("then_by needs an order_by before it")
        return self._with(orderby=[*self._q.orderby, A.Order(parse_filter(text), descending)])

    def take(self, n: int) -> Builder:
        return self._with(top=n if self._q.top is None else min(n, self._q.top))

    def skip(self, n: int) -> Builder:
        return self._with(skip=n)

    def of_type(self, name: str) -> Builder:
        return self._with(path=[*self._q.path, A.Segment(name if "." in name else f"T.{name}")])

    def expand(self, text: str) -> Builder:
        from quillon.lang.parser import parse_expand

        return self._with(expand=[*self._q.expand, *parse_expand(text)])

    def query(self) -> A.Query:
        return self._q

    def dataframe(self) -> DataFrame:
        return self._session.query(self._q)

    def long_count(self) -> int:
        return self._session.count(self._q)


def regraphed(df: DataFrame, paths: list[tuple[str, ...]]) -> DataFrame:
    """df with the columns of paths (a_b for a/b) gathered into structs, each where its first column stood; a struct of nulls only is null."""
    from pyspark.sql import functions as F

    from quillon.plans.columns import ref

    def struct(prefix: tuple[str, ...]):
        own = [p for p in paths if p[: len(prefix)] == prefix]
        fields = dict.fromkeys(p[len(prefix)] for p in own)
        leaves = {p[len(prefix)] for p in own if len(p) == len(prefix) + 1}
        made = F.struct(*[(ref("_".join((*prefix, f))) if f in leaves else struct((*prefix, f))).alias(f) for f in fields])
        some = [ref("_".join(p)).isNotNull() for p in own]
        there = some[0]
        for c in some[1:]:
            there = there | c
        return F.when(there, made)

    flat, out, seen = {"_".join(p): p for p in paths}, [], set()
    for c in df.columns:
        if c not in flat:
            out.append(ref(c))
        elif flat[c][0] not in seen:
            seen.add(flat[c][0])
            out.append(struct(flat[c][:1]).alias(flat[c][0]))
    return df.select(*out)


def union(*queries: DataFrame, distinct: bool = False, order: list | None = None) -> DataFrame:
    """Union with columns aligned by name and padded with nulls, in the order of their names; orders inside are not kept."""
    if not queries:
        raise BindError("nothing to unite")
    out = queries[0]
    for q in queries[1:]:
        out = out.unionByName(q, allowMissingColumns=True)
    out = out.select(*[out[c] for c in sorted(out.columns)])
    out = out.distinct() if distinct else out
    return out.orderBy(*order) if order else out


def fan_out(q: str | A.Query, sessions: list[Session], name: str | None = None) -> DataFrame:
    """The same query over several contexts; name: a column that says which context (by position) a row is from."""
    from pyspark.sql import functions as F

    frames = [s.query(q) for s in sessions]
    if name:
        frames = [f.withColumn(name, F.lit(k)) for k, f in enumerate(frames)]
    return union(*frames)
