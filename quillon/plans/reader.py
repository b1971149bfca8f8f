"""Queries to lazy DataFrames.

A navigation path is joined once, however often it is named; joined columns carry their path as a prefix, so that no name is
ambiguous. any() and all() that stand alone are semi and anti joins; elsewhere they are flags from a left join with the distinct
matching keys. Roots are paged before anything is expanded. Nothing here runs a job.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.scalar import Udfs
from quillon.lang import ast as A
from quillon.model import EntityModel, EntityType, Navigation, Property
from quillon.plans.columns import TYPE_NAME, BindError, Scope, column, predicate, ref
from quillon.sources.catalog import Catalog, scan

SEP = "/"


class Rows:
    """A frame of an entity type's rows with the navigations joined so far. prefix: of its own columns' names."""

    def __init__(self, planner: Planner, t: EntityType, df: DataFrame, prefix: str = ""):
        self.planner, self.model, self.type, self.df, self.prefix = planner, planner.model, t, df, prefix
        self.joined: dict[tuple[str, ...], EntityType] = {(): t}
        self.outer: Rows | None = None
        self.var: str | None = None
        self.cast: dict[tuple[str, ...], EntityType] = {}

    def name(self, parts: tuple[str, ...]) -> str:
        return self.prefix + SEP.join(parts)

    # -- names ------------------------------------------------------------------------------------------------------
    def split(self, parts: tuple[str, ...]) -> tuple[tuple[str, ...], str | None]:
        """A path's navigations and its property, type casts left out; property None if the path ends at a navigation."""
        t, navs = self.type, []
        for k, part in enumerate(parts):
            if "." in part and part not in self.model.properties(t):
                t = self.model.type(part)
                continue
            every = self._navigations(t)
            if part in every:
                navs.append(part)
                t = self.model.type(every[part].target)
            elif k == len(parts) - 1:
                return tuple(navs), part
            else:
                raise BindError(f"{t.name} has no navigation {part!r}")
        return tuple(navs), None

    def _navigations(self, t: EntityType) -> dict[str, Navigation]:
        out = dict(self.model.navigations(t))
        if self.model.is_polymorphic(t):
            for x in self.model.subtypes(t):
                out |= self.model.navigations(x)
        return out

    def target(self, navs: tuple[str, ...]) -> EntityType:
        t = self.type
        for n in navs:
            every = self._navigations(t)
            if n not in every:
                raise BindError(f"{t.name} has no navigation {n!r}")
            t = self.model.type(every[n].target)
        return t

    def property(self, t: EntityType, name: str) -> Property | None:
        for x in ([t, *self.model.subtypes(t)] if self.model.is_polymorphic(t) else [t]):
            if name in (props := self.model.properties(x)):
                return props[name]
        return None

    def resolve(self, parts: tuple[str, ...]) -> tuple[Column, Property | None]:
        if self.var and parts and parts[0] == self.var:
            parts = parts[1:]
        elif self.var and self.outer is not None:
            return self.outer.resolve(parts)
        navs, prop = self.split(parts)
        if prop is None:
            raise BindError(f"{'/'.join(parts) or '$it'} is an entity, not a value")
        t = self.target(navs)
        if navs not in self.joined:
            raise BindError(f"{'/'.join(navs)} isn't joined here")
        name = self.name((*navs, prop))
        if name not in self.df.columns:
            raise BindError(f"{t.name} has no property {prop!r}")
        return ref(name), self.property(t, prop)

    def scope(self, q: A.Query | None = None, aliases: dict[str, A.Expr] | None = None) -> Scope:
        params = q.params if q is not None else self.planner.params
        return Scope(self.model, self.type, self.resolve, params, aliases or {}, self.planner.udfs, self.planner.flags, lambda p: self.target(self.split(self._own(p))[0]))

    def _own(self, parts: tuple[str, ...]) -> tuple[str, ...]:
        return parts[1:] if self.var and parts and parts[0] == self.var else parts

    # -- joins ------------------------------------------------------------------------------------------------------
    def join(self, navs: tuple[str, ...], how: str = "inner", hint: str | None = None) -> None:
        """Join the targets of a navigation path, step by step, each once."""
        for k in range(1, len(navs) + 1):
            at, before = navs[:k], navs[: k - 1]
            if at in self.joined:
                continue
            owner = self.joined[before]
            nav = self._navigations(owner)[navs[k - 1]]
            target = self.model.type(nav.target)
            right = self.planner.scan(target)
            right = right.select(*[ref(c).alias(self.name((*at, c))) for c in right.columns])
            right = right.hint(hint) if hint else right
            own = lambda c, before=before: ref(self.name((*before, c)))
            if nav.bridge:
                b = self.planner.bridge(nav)
                mark = self.name((*at, "$bridge"))
                b = b.select(*[ref(c).alias(f"{mark}.{c}") for c in b.columns])
                left = [own(a) == ref(f"{mark}.{c}") for a, c in nav.pairs]
                far = [ref(f"{mark}.{c}") == ref(self.name((*at, d))) for c, d in nav.bridge_pairs]
                self.df = self.df.join(b, left, how).join(right, far, how).drop(*b.columns)
            else:
                self.df = self.df.join(right, [own(a) == ref(self.name((*at, b))) for a, b in nav.pairs], how)
            self.joined[at] = target

    def need(self, *exprs: A.Expr | None) -> None:
        """Join what the expressions' paths go through; insides of quantifiers are their own affair."""
        for e in exprs:
            stack = [e] if e is not None else []
            while stack:
                x = stack.pop()
                if isinstance(x, A.Quant):
                    continue
                if isinstance(x, A.Path) and x.parts:
                    parts = self._own(x.parts)
                    if self.var and parts == x.parts:
                        continue  # the outer row's
                    if parts and not (len(parts) == 1 and parts[0] in self.planner.aliases):
                        navs = self.split(parts)[0]
                        self.join(navs)
                stack += x.args[:-1] if isinstance(x, A.Func) and x.name in ("cast", "isof") else A.children(x)

    # -- filters ----------------------------------------------------------------------------------------------------
    def where(self, e: A.Expr | None, q: A.Query | None = None, aliases: dict[str, A.Expr] | None = None) -> None:
        for item in A.conjuncts(e):
            inner, negated = item, False
            while isinstance(inner, A.Not):
                inner, negated = inner.item, not negated
            if isinstance(inner, A.Quant):
                self.exists(inner, negated)
            else:
                self.flagged(item)
                self.need(item)
                self.df = self.df.where(predicate(item, self.scope(q, aliases)))

    def matching(self, e: A.Quant, negate: bool) -> tuple[Rows, list[tuple[str, str]], Column | None]:
        """Rows of a quantifier's collection that meet its predicate (or, for negate, meet its negation); (own, child) key columns;
        what of the predicate looks at both sides."""
        path = self._own(e.path)
        first = self._navigations(self.type).get(path[0])
        if first is None:
            raise BindError(f"{self.type.name} has no navigation {path[0]!r}")
        self.planner.quantifiers += 1
        prefix = f"?{self.planner.quantifiers}:"
        target = self.model.type(first.target)
        df = self.planner.scan(target)
        child = Rows(self.planner, target, df.select(*[ref(c).alias(f"{prefix}{c}") for c in df.columns]), prefix)
        keys = [(self.name((a,)), f"{prefix}{b}") for a, b in first.pairs]
        if first.bridge:
            b = self.planner.bridge(first)
            b = b.select(*[ref(c).alias(f"{prefix}$bridge.{c}") for c in b.columns])
            child.df = child.df.join(b, [ref(f"{prefix}$bridge.{c}") == ref(f"{prefix}{d}") for c, d in first.bridge_pairs])
            keys = [(self.name((a,)), f"{prefix}$bridge.{c}") for a, c in first.pairs]
        last = path[1:]
        if last:
            child.join(last)
        both = None
        if e.predicate is not None:
            inner = Rows(self.planner, child.target(last), child.df, child.name((*last, "")) if last else prefix)
            inner.var, inner.outer = e.var, self
            inner.joined = {(): inner.type}
            p = A.Not(e.predicate) if negate else e.predicate
            for item in A.conjuncts(p) if not negate else [p]:
                if self.crosses(item, e.var):
                    inner.need(item)
                    self.need(*[A.Path(x.parts) for x in A.walk(item) if isinstance(x, A.Path) and x.parts and x.parts[0] != e.var])
                    c = predicate(item, inner.scope())
                    both = c if both is None else both & c
                else:
                    inner.where(item)
            child.df = inner.df
        return child, keys, both

    def crosses(self, e: A.Expr, var: str | None) -> bool:
        return any(isinstance(x, A.Path) and x.parts and x.parts[0] != var for x in _outside(e))

    def looked_at(self, e: A.Quant) -> list[str]:
        """Columns of this row that a quantifier's predicate looks at."""
        out = []
        for x in _outside(e.predicate):
            if isinstance(x, A.Path) and x.parts and x.parts[0] != e.var:
                navs, prop = self.split(self._own(x.parts))
                out += [self.name((*navs, prop))] if prop is not None else [self.name((*navs, a)) for nav in [self._navigations(self.target(navs[:-1]))[navs[-1]]] for a, _ in nav.pairs]
        return out

    def exists(self, e: A.Quant, negated: bool) -> None:
        """any: semi join; all: anti join with what breaks it; not turns one into the other."""
        child, keys, both = self.matching(e, e.kind == "all")
        on = [ref(a) == ref(b) for a, b in keys] + ([both] if both is not None else [])
        self.df = self.df.join(child.df, on, "left_semi" if (e.kind == "any") != negated else "left_anti")

    def flagged(self, e: A.Expr) -> None:
        """Quantifiers inside a larger predicate: a flag column, from the distinct keys that match."""
        stack = [e]
        while stack:
            x = stack.pop()
            if isinstance(x, A.Quant):
                child, keys, both = self.matching(x, x.kind == "all")
                flag = f"?flag{self.planner.quantifiers}"
                if both is not None:  # by the values of the outer row that the predicate looks at, each set of them once
                    outer = list(dict.fromkeys([*[a for a, _ in keys], *self.looked_at(x)]))
                    found = self.df.select(*[ref(a) for a in outer]).distinct().join(child.df, [*[ref(a) == ref(b) for a, b in keys], both], "left_semi")
                    found = found.select(*[ref(a).alias(f"{flag}.{k}") for k, a in enumerate(outer)]).withColumn(flag, F.lit(True))
                    self.df = self.df.join(found, [ref(a).eqNullSafe(ref(f"{flag}.{k}")) for k, a in enumerate(outer)], "left").drop(*found.columns[:-1])
                else:
                    found = child.df.select(*[ref(b).alias(f"{flag}.{k}") for k, (_, b) in enumerate(keys)]).distinct().withColumn(flag, F.lit(True))
                    self.df = self.df.join(found, [ref(a) == ref(f"{flag}.{k}") for k, (a, _) in enumerate(keys)], "left").drop(*[f"{flag}.{k}" for k in range(len(keys))])
                here = F.coalesce(ref(flag), F.lit(False))
                self.planner.flags[id(x)] = here if x.kind == "any" else ~here
                continue
            stack += A.children(x)


def _outside(e: A.Expr):
    """Sub-expressions, not into quantifiers but for their path."""
    stack = [e]
    while stack:
        x = stack.pop()
        if isinstance(x, A.Quant):
            yield A.Path(x.path)
            continue
        yield x
        stack += A.children(x)


class Planner:
    def __init__(self, model: EntityModel, catalog: Catalog, udfs: Udfs | None = None, page_sizes: dict[str, int] | None = None, post: list | None = None):
        self.model, self.catalog, self.udfs = model, catalog, udfs or Udfs()
        self.page_sizes, self.post = page_sizes or {}, post or []
        self.params: dict[str, A.Expr] = {}
        self.aliases: dict[str, A.Expr] = {}
        self.flags: dict[int, Column] = {}
        self.quantifiers = 0
        self.shards: list[int] | None = None

    # -- sources ----------------------------------------------------------------------------------------------------
    def scan(self, t: EntityType, only: set[str] | None = None) -> DataFrame:
        return scan(self.model, self.catalog, t, only, self.shards)

    def bridge(self, nav: Navigation) -> DataFrame:
        cols = [c for _, c in nav.pairs] + [c for c, _ in nav.bridge_pairs]
        return self.catalog.table(nav.bridge, self.shards).select(*[ref(c) for c in dict.fromkeys(cols)]).distinct()

    def keyed(self, t: EntityType, keys: dict[str | None, A.Expr], q: A.Query) -> A.Expr | None:
        names = self.model.key(t)
        if None in keys and len(names) != 1:
            raise BindError(f"{t.name} has {len(names)} key properties; name them")
        if None not in keys and set(keys) - set(self.model.properties(t)):
            raise BindError(f"{t.name} has no {sorted(set(keys) - set(self.model.properties(t)))}")
        return A.conjunction([A.Cmp("eq", A.Path((names[0] if k is None else k,)), v) for k, v in keys.items()])

    def source(self, q: A.Query) -> tuple[Rows, str | None, bool]:
        """The rows that a path leads to, a property it ends in, and whether it ends in $ref."""
        if not q.path:
            raise BindError("a query needs an entity set")
        head, *rest = q.path
        t = self.model.set_type(head.name)
        only = self._branches(t, q)
        rows = Rows(self, t, self.scan(t, only))
        key = self.keyed(t, head.keys, q) if head.keys is not None else None
        prop, refs = None, False
        for k, seg in enumerate(rest):
            if seg.name == "$value":
                continue
            if seg.name == "$ref":
                refs = True
                continue
            if seg.name == "$count":
                q.count = True
                continue
            if "." in seg.name:
                rows.where(key, q)
                key, derived = None, self.model.type(seg.name)
                names = {x.name for x in self.model.subtypes(derived)}
                base = Rows(self, derived, rows.df if TYPE_NAME not in rows.df.columns else rows.df.where(ref(TYPE_NAME).isin(*names)))
                rows = base
                if seg.keys is not None:
                    key = self.keyed(derived, seg.keys, q)
                continue
            nav = rows._navigations(rows.type).get(seg.name)
            if nav is None:
                if k == len(rest) - 1 or rest[k + 1].name == "$value":
                    prop = seg.name
                    continue
                raise BindError(f"{rows.type.name} has no navigation {seg.name!r}")
            rows = self.follow(rows, nav, key, q)
            key = self.keyed(rows.type, seg.keys, q) if seg.keys is not None else None
        rows.where(key, q)
        return rows, prop, refs

    def follow(self, rows: Rows, nav: Navigation, key: A.Expr | None, q: A.Query) -> Rows:
        """Targets of a navigation from rows. If only the rows' key is asked and the targets hold it as a trusted foreign key,
        the rows themselves aren't read."""
        target = self.model.type(nav.target)
        asked = {x.left.parts[0]: x.right for x in A.conjuncts(key) if isinstance(x, A.Cmp) and isinstance(x.left, A.Path)} if key is not None else {}
        there = dict(nav.pairs)
        if not nav.bridge and nav.foreign == "target" and asked and rows.type.trusted and set(asked) <= set(there) and len(rows.joined) == 1:
            out = Rows(self, target, self.scan(target))
            out.where(A.conjunction([A.Cmp("eq", A.Path((there[k],)), v) for k, v in asked.items()]), q)
            return out
        rows.where(key, q)
        out = Rows(self, target, self.scan(target))
        own = rows.df.select(*[ref(a).alias(f"?from.{a}") for a, _ in nav.pairs])
        if nav.bridge:
            b = self.bridge(nav).join(own, [ref(c) == ref(f"?from.{a}") for a, c in nav.pairs], "left_semi")
            b = b.select(*[ref(c).alias(f"?from.{d}") for c, d in nav.bridge_pairs])
            out.df = out.df.join(b, [ref(d) == ref(f"?from.{d}") for _, d in nav.bridge_pairs], "left_semi")
        else:
            out.df = out.df.join(own, [ref(b) == ref(f"?from.{a}") for a, b in nav.pairs], "left_semi")
        return out

    def _branches(self, t: EntityType, q: A.Query) -> set[str] | None:
        """Subtypes that the filter's own isof conditions and the path's cast leave over."""
        if not self.model.is_polymorphic(t):
            return None
        left = {x.name for x in self.model.subtypes(t)}
        if len(q.path) > 1 and "." in q.path[1].name:
            left &= {x.name for x in self.model.subtypes(self.model.type(q.path[1].name))}
        for e in A.conjuncts(A.conjunction([x for x in (q.filter, q.where) if x is not None])):
            if isinstance(e, A.Func) and e.name == "isof" and (len(e.args) == 1 or e.args[0] == A.Path(())):
                name = e.args[-1].value if isinstance(e.args[-1], A.Lit) else ".".join(e.args[-1].parts)
                left &= {x.name for x in self.model.subtypes(self.model.type(name))}
        return left

    # -- whole queries ----------------------------------------------------------------------------------------------
    def plan(self, q: A.Query, paged: bool = True) -> DataFrame:
        """The query's rows; paged=False leaves out top and skip, as the total count does."""
        if q.compute and q.aggregated:
            raise BindError("compute doesn't go with aggregate or groupby")
        if q.search:
            raise BindError("$search isn't supported")
        self.params, self.flags = q.params, {}
        self.shards = None if not q.shard else q.shard
        rows, prop, refs = self.source(q)
        if prop is not None:
            q = replace(q, select=[A.Path((prop,))])
        out = self.read(rows, q, paged)
        if refs:
            keys = self.model.key(rows.type)
            uri = F.concat(F.lit(f"{next((s for s, t in self.model.sets.items() if t == rows.type.name), rows.type.name)}("), F.concat_ws(",", *[ref(k).cast("string") for k in keys]), F.lit(")"))
            out = out.select(uri.alias("uri"))
        for hook in self.post:
            out = out.transform(hook)
        return out

    def read(self, rows: Rows, q: A.Query, paged: bool = True) -> DataFrame:
        if q.apply:
            from quillon.operators.apply import run_steps

            return run_steps(self, rows, q.apply)
        self.aliases = {n.alias: n.expr for n in q.compute}
        rows.where(A.conjunction([e for e in (q.filter, q.where) if e is not None]), q, self.aliases)
        if q.aggregated:
            out = self.aggregated(rows, q)
            return self.ordered(out, q, [c for c in out.columns], paged, {n.alias for n in q.aggregate})
        rows.need(*[n.expr for n in q.compute], *[o.expr for o in q.orderby if not self._alias(o.expr)])
        s = rows.scope(q, self.aliases)
        columns = self.projection(rows, q, s)
        size = self.page_sizes.get(q.path[0].name if q.path else "", self.page_sizes.get("*"))
        top = q.top if q.top is not None else size
        order = [self._order(column(o.expr, s), o.descending) for o in q.orderby]
        page = paged and (top is not None or q.skip)
        if page and order and q.expand:  # the page is looked at from several places of the plan: no ties
            order += [ref(rows.name((k,))).asc() for k in self.model.key(rows.type)]
        if page and not order:
            keys = self.model.key(rows.type)
            if not keys:
                raise BindError(f"{rows.type.name} has no key to page by; give $orderby")
            order = [ref(rows.name((k,))).asc() for k in keys]
        df = rows.df
        if page and q.with_ties:
            df = self.ties(df, [(column(o.expr, s), o.descending) for o in q.orderby] or [(ref(rows.name((k,))), False) for k in self.model.key(rows.type)], top, q.skip)
        elif order:
            df = df.orderBy(*order)
        if page and not q.with_ties:
            df = df.offset(q.skip) if q.skip else df
            df = df.limit(top) if top is not None else df
        if q.expand:
            from quillon.plans.expand import expanded

            few = page and top is not None and not q.with_ties and self.model.key(rows.type)
            return expanded(self, rows, df, q, columns, top if few else None)
        return df.select(*columns)

    def ties(self, df: DataFrame, order: list[tuple[Column, bool]], top: int | None, skip: int | None) -> DataFrame:
        """The first rows and all that are equal in order to the last of them. Only the first rows are numbered."""
        if skip:
            raise BindError("ties don't go with skip")
        if top is None:
            return df.orderBy(*[self._order(*o) for o in order])
        mark = [f"?o{k}" for k in range(len(order))]
        keyed = df.select("*", *[c.alias(m) for m, (c, _) in zip(mark, order, strict=True)])
        by = [self._order(ref(m), down) for m, (_, down) in zip(mark, order, strict=True)]
        edge = keyed.orderBy(*by).limit(top)
        place = F.row_number().over(Window.orderBy(*by))  # over the first rows only
        last = edge.withColumn("?n", place).where(ref("?n") == top).select(*[ref(m).alias(f"{m}l") for m in mark])
        equal = F.lit(True)
        for m in mark:
            equal = equal & ref(m).eqNullSafe(ref(f"{m}l"))
        more = keyed.join(F.broadcast(last), equal, "left_semi")
        before = edge.join(F.broadcast(last), equal, "left_anti")
        return before.union(more).orderBy(*by).drop(*mark)

    def _alias(self, e: A.Expr) -> bool:
        return isinstance(e, A.Path) and len(e.parts) == 1 and e.parts[0] in self.aliases

    def _order(self, c: Column, descending: bool) -> Column:
        return c.desc_nulls_last() if descending else c.asc_nulls_first()

    def projection(self, rows: Rows, q: A.Query, s: Scope) -> list[Column]:
        if q.select:
            picked = [(p.parts[-1] if len(p.parts) == 1 else "_".join(p.parts), p) for p in q.select]
            plain = [(n, p) for n, p in picked if not self._is_navigation(rows, p.parts)]
            rows.need(*[p for _, p in plain])
            out = [column(p, s).alias(n) for n, p in plain]
            named = {n for n, _ in plain}
        else:
            props = [c for c in rows.df.columns if c.startswith(rows.prefix) and SEP not in c[len(rows.prefix) :] and not c.startswith("?")]
            visible = set(self.model.properties(rows.type)) | {TYPE_NAME} | {k for x in self.model.subtypes(rows.type) for k in self.model.properties(x)}
            props = [c for c in props if c[len(rows.prefix) :] in visible]
            out, named = [ref(c).alias(c[len(rows.prefix) :]) for c in props], set()
        return out + [column(n.expr, s).alias(n.alias) for n in q.compute if n.alias not in named]

    def _is_navigation(self, rows: Rows, parts: tuple[str, ...]) -> bool:
        if len(parts) == 1 and parts[0] in self.aliases:
            return False
        return rows.split(parts)[1] is None

    # -- aggregation ------------------------------------------------------------------------------------------------
    def aggregated(self, rows: Rows, q: A.Query) -> DataFrame:
        grouped = {n.alias: n.expr for n in q.aggregate if not _aggregates(n.expr, self.udfs) and n.expr in (*q.groupby, *q.rollup)}
        rows.need(*q.groupby, *q.rollup, *[n.expr for n in q.aggregate])
        s = rows.scope(q)
        keys: dict[str, Column] = {}
        for e in (*q.groupby, *q.rollup):
            keys[next((a for a, x in grouped.items() if x == e), None) or self.key_name(e)] = column(e, s)
            if isinstance(e, A.Path):  # a key reached through a polymorphic navigation says of which type
                navs = rows.split(e.parts)[0]
                if navs and self.model.is_polymorphic(rows.target(navs)):
                    keys[f"{'_'.join(navs)}_{TYPE_NAME}"] = ref(rows.name((*navs, TYPE_NAME)))
        aggs = []
        froms = [n for n in q.aggregate if isinstance(n.expr, A.With) and n.expr.froms]
        if froms:
            return self.regrouped(rows, q, keys, s)
        for n in q.aggregate:
            if n.alias not in grouped:
                if not _aggregates(n.expr, self.udfs):
                    raise BindError(f"{n.alias} is neither grouped by nor aggregated")
                aggs.append(column(n.expr, s).alias(n.alias))
        df = rows.df.select("*", *[c.alias(f"?key.{k}") for k, c in keys.items()])
        names = [f"?key.{k}" for k in keys]
        if not aggs and not keys:
            raise BindError("nothing to aggregate")
        if q.rollup:
            fixed = names[: len(names) - len(q.rollup)]
            rolled = names[len(fixed) :]
            sets = [[ref(c) for c in (*fixed, *rolled[:k])] for k in range(len(rolled), -1, -1)]
            g = df.groupingSets(sets, *[ref(c) for c in names])
        else:
            g = df.groupBy(*[ref(c) for c in names])
        if aggs:
            out = g.agg(*aggs)
        else:
            out = g.agg(F.count(F.lit(1)).alias("?n")).drop("?n")
        out = out.select(*[ref(f"?key.{k}").alias(k) for k in keys], *[ref(n.alias) for n in q.aggregate if n.alias not in grouped])
        if q.having is not None:
            have = Scope(self.model, rows.type, lambda p: (ref("_".join(p)), None), q.params, {}, self.udfs)
            out = out.where(predicate(q.having, have))
        return out

    def regrouped(self, rows: Rows, q: A.Query, keys: dict[str, Column], s: Scope) -> DataFrame:
        """X with sum as t from Y with max: sums of X for each Y, and the greatest of these."""
        if len(q.aggregate) != 1 or q.rollup or len(q.aggregate[0].expr.froms) != 1:
            raise BindError("from takes one aggregate and one level, without rollup")
        n = q.aggregate[0]
        (of, method) = n.expr.froms[0]
        rows.need(of)
        df = rows.df.select("*", *[c.alias(f"?key.{k}") for k, c in keys.items()], column(of, s).alias("?of"))
        names = [ref(f"?key.{k}") for k in keys]
        from quillon.plans.columns import aggregate as agg

        inner = df.groupBy(*names, ref("?of")).agg(agg(n.expr.expr, n.expr.method, s).alias("?inner"))
        outer = {"sum": F.sum, "min": F.min, "max": F.max, "average": F.avg, "count": F.count, "countdistinct": F.count_distinct}[method](ref("?inner"))
        return inner.groupBy(*names).agg(outer.alias(n.alias)).select(*[ref(f"?key.{k}").alias(k) for k in keys], ref(n.alias))

    def key_name(self, e: A.Expr) -> str:
        from quillon.lang.unparse import text

        return "_".join(e.parts) if isinstance(e, A.Path) else "".join(c if c.isalnum() else "_" for c in text(e)).strip("_")

    def ordered(self, df: DataFrame, q: A.Query, keys: list[str], paged: bool, aliases: set[str]) -> DataFrame:
        def named(p: tuple[str, ...]):
            name = "_".join(p)
            if name not in df.columns:
                raise BindError(f"{'/'.join(p)} isn't in the grouped result")
            return ref(name), None

        s = Scope(self.model, EntityType(""), named, q.params, {}, self.udfs)
        by = []
        for o in q.orderby:
            name = self.key_name(o.expr)
            by.append(self._order(ref(name) if name in df.columns else column(o.expr, s), o.descending))
        if paged and (q.top is not None or q.skip) and not by:
            by = [ref(k).asc_nulls_first() for k in keys if k not in aliases] or [ref(k).asc_nulls_first() for k in keys]
        df = df.orderBy(*by) if by else df
        if paged:
            df = df.offset(q.skip) if q.skip else df
            df = df.limit(q.top) if q.top is not None else df
        if q.select:
            df = df.select(*[ref("_".join(p.parts)) for p in q.select])
        return df

    def total(self, q: A.Query) -> DataFrame:
        """One row: how many rows the query has without top and skip; groups, if it is grouped."""
        return self.plan(replace(q, orderby=[], expand=[]), paged=False).agg(F.count(F.lit(1)).alias("total"))


def _aggregates(e: A.Expr, udfs: Udfs) -> bool:
    return any(isinstance(x, A.With) and x.method != "none" for x in A.walk(e))
