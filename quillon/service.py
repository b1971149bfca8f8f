"""The service facade without HTTP: verbs over URLs, as a host would call them."""

from __future__ import annotations

import time
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.api import Session
from quillon.lang import ast as A
from quillon.lang.parser import parse_url
from quillon.operators import graph, merge
from quillon.operators.transactions import Snapshots, Transaction
from quillon.plans.columns import BindError


class Service:
    """GET, POST, PUT, PATCH, DELETE and $ref links over a session and its snapshots.

    allowed: names of properties that an entity set's `where` may use, by set; others are refused. observers get an event for
    each call: verb, url, seconds, error.
    """

    def __init__(self, session: Session, snapshots: Snapshots, allowed: dict[str, set[str]] | None = None, observers: list[Callable[[dict], None]] | None = None):
        self.session, self.snapshots, self.allowed, self.observers = session, snapshots, allowed or {}, observers or []

    def _told(self, verb: str, url: str, run: Callable[[], Any]) -> Any:
        start, error = time.monotonic(), None
        try:
            return run()
        except Exception as x:
            error = repr(x)
            raise
        finally:
            for o in self.observers:
                o({"verb": verb, "url": url, "seconds": time.monotonic() - start, "error": error})

    def get(self, url: str) -> DataFrame:
        def run():
            q = parse_url(url)
            names = self.allowed.get(q.path[0].name)
            if names is not None and q.where is not None:
                used = {x.parts[0] for x in A.walk(q.where) if isinstance(x, A.Path) and x.parts}
                if used - names:
                    raise BindError(f"where may not use {sorted(used - names)}")
            return self.session.query(q)

        return self._told("GET", url, run)

    def _type(self, url: str):
        q = parse_url(url)
        return q, self.session.model.set_type(q.path[0].name)

    def upsert(self, url: str, body: dict | list[dict], schema, transaction: Transaction | None = None, verb: str = "POST") -> int | None:
        """POST, PUT and PATCH: an upsert that leaves properties alone that the body lacks. With a transaction it waits for its commit."""

        def run():
            q, t = self._type(url)
            rows = graph.body(self.session.spark, body, schema)
            for k, v in (q.path[0].keys or {}).items():
                name = k or self.session.model.key(t)[0]
                rows = rows.withColumn(name, F.lit(v.value).cast(self.session.model.properties(t)[name].type))
            own = transaction or Transaction(self.snapshots)
            own.add(graph.deep_write(self.session.model, t, rows, user=q.user), q.store)
            return own.save_changes() if transaction is None else None

        return self._told(verb, url, run)

    def delete(self, url: str, transaction: Transaction | None = None) -> int | None:
        def run():
            q, t = self._type(url)
            model = self.session.model
            if q.path[0].keys is None:
                raise BindError("DELETE needs a key")
            names = model.key(t)
            row = {(k or names[0]): v.value for k, v in q.path[0].keys.items()}
            kinds = ", ".join(f"`{n}` {model.properties(t)[n].type.simpleString()}" for n in names)
            keys = self.session.spark.createDataFrame([tuple(row[n] for n in names)], kinds)
            own = transaction or Transaction(self.snapshots)
            own.add(lambda tables: merge.delete_entity(model, t, tables, keys))
            return own.save_changes() if transaction is None else None

        return self._told("DELETE", url, run)

    def link(self, url: str, member: Any, remove: bool = False, transaction: Transaction | None = None) -> int | None:
        """/Set(key)/Nav/$ref with the member's key."""

        def run():
            q, t = self._type(url)
            model = self.session.model
            nav = model.navigations(t).get(q.path[1].name)
            if nav is None:
                raise BindError(f"{t.name} has no navigation {q.path[1].name!r}")
            target = model.type(nav.target)
            hk, mk = model.key(t), model.key(target)
            values = [v.value for v in q.path[0].keys.values()] + (list(member) if isinstance(member, (tuple, list)) else [member])
            kinds = ", ".join([f"`host_{k}` {model.properties(t)[k].type.simpleString()}" for k in hk] + [f"`member_{k}` {model.properties(target)[k].type.simpleString()}" for k in mk])
            pairs = self.session.spark.createDataFrame([tuple(values)], kinds)
            own = transaction or Transaction(self.snapshots)
            own.add(lambda tables: (merge.unlink if remove else merge.link)(model, t, nav, tables, pairs))
            return own.save_changes() if transaction is None else None

        return self._told("DELETE" if remove else "POST", url, run)


def value_of(df: DataFrame) -> Any:
    """The raw value of a one-property read, for $value."""
    row = df.first()
    return None if row is None else row[0]
