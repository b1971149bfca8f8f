"""Expressions to Columns, within a scope that says which column a path is."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.functions import scalar
from quillon.lang import ast as A
from quillon.model import EntityModel, EntityType, Property


class BindError(ValueError):
    """A name or operation that the query can't have."""


def ref(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


TYPE_NAME = "$TypeName"


@dataclass
class Scope:
    """resolve: path -> (Column, Property or None); flags: Columns that stand for quantifiers computed beforehand."""

    model: EntityModel
    type: EntityType
    resolve: Callable[[tuple[str, ...]], tuple[Column, Property | None]]
    params: dict[str, A.Expr] = field(default_factory=dict)
    aliases: dict[str, A.Expr] = field(default_factory=dict)
    udfs: scalar.Udfs = field(default_factory=scalar.Udfs)
    flags: dict[int, Column] = field(default_factory=dict)
    row_type: Callable[[tuple[str, ...]], EntityType] | None = None

    def property_of(self, e: A.Expr) -> Property | None:
        if isinstance(e, A.Path) and e.parts and not (len(e.parts) == 1 and e.parts[0] in self.aliases):
            return self.resolve(e.parts)[1]
        return None


def literal(e: A.Lit, s: Scope, against: Property | None = None) -> Column:
    if e.kind == "null":
        return F.lit(None)
    if e.kind == "enum":
        name, text = e.value
        for n in (name, name.rpartition(".")[2]):
            if n in s.model.enums:
                return F.lit(s.model.enums[n].value(text))
        raise BindError(f"no enum {name!r}")
    if against is not None and against.enum and e.kind == "string":
        return F.lit(s.model.enums[against.enum].value(e.value))
    if e.kind == "datetime" or e.kind == "datetimeoffset" and against is not None and isinstance(against.type, T.TimestampNTZType):
        value = e.value.astimezone(dt.UTC).replace(tzinfo=None) if e.value.tzinfo else e.value
        return F.lit(value.isoformat(" ")).cast("timestamp_ntz")
    if e.kind == "datetimeoffset":
        return F.lit(e.value.isoformat(" ")).cast("timestamp")
    if e.kind == "long":
        return F.lit(e.value).cast("long")
    if e.kind == "guid":
        return F.lit(e.value)
    return F.lit(e.value)


def param(e: A.Param, s: Scope) -> A.Expr | Column:
    name = e.name.lower()
    if name in ("now", "utcnow"):
        return F.current_timestamp()
    if name in ("today", "utctoday"):
        return F.date_trunc("day", F.current_timestamp())
    if e.name in s.params:
        return s.params[e.name]
    raise BindError(f"no value for @{e.name}")


def is_moment(e: A.Expr, s: Scope) -> bool:
    if isinstance(e, A.Param):
        return e.name.lower() in ("now", "utcnow", "today", "utctoday")
    if isinstance(e, A.Func) and e.name in ("now", "mindatetime", "maxdatetime", "date"):
        return True
    if isinstance(e, A.Lit):
        return e.kind in ("datetime", "datetimeoffset")
    p = s.property_of(e)
    return p is not None and isinstance(p.type, (T.TimestampType, T.TimestampNTZType, T.DateType))


def integral(e: A.Expr, s: Scope) -> bool:
    """Whether an operand of div is an integer, as far as the tree and the model say."""
    if isinstance(e, A.Lit):
        return e.kind in ("int", "long")
    if isinstance(e, A.Arith):
        return e.op != "divby" and integral(e.left, s) and integral(e.right, s)
    if isinstance(e, A.Func):
        return e.name in ("length", "indexof", "year", "month", "day", "hour", "minute", "second", "fractionalseconds", "totaloffsetminutes", "totalseconds") or e.name == "cast" and _cast_name(e).removeprefix("Edm.").lower() in ("int16", "int32", "int64", "byte", "sbyte")
    if isinstance(e, A.Path) and len(e.parts) == 1 and e.parts[0] in s.aliases:
        return integral(s.aliases[e.parts[0]], s)
    if isinstance(e, A.With):
        return e.method in ("count", "countdistinct") or e.method in ("sum", "min", "max") and integral(e.expr, s)
    p = s.property_of(e)
    return p is not None and isinstance(p.type, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))


def _cast_name(e: A.Func) -> str:
    t = e.args[-1]
    return t.value if isinstance(t, A.Lit) else ".".join(t.parts) if isinstance(t, A.Path) else ""


def column(e: A.Expr, s: Scope, against: Property | None = None) -> Column:
    if isinstance(e, A.Lit):
        return literal(e, s, against)
    if isinstance(e, A.Path):
        if len(e.parts) == 1 and e.parts[0] in s.aliases:
            return column(s.aliases[e.parts[0]], s)
        return s.resolve(e.parts)[0]
    if isinstance(e, A.Param):
        got = param(e, s)
        return got if isinstance(got, Column) else column(got, s, against)
    if isinstance(e, A.Arith):
        return arithmetic(e, s)
    if isinstance(e, (A.Cmp, A.In, A.And, A.Or, A.Not, A.Quant)):
        return predicate(e, s)
    if isinstance(e, A.Func):
        return function(e, s)
    if isinstance(e, A.With):
        return aggregate(e.expr, e.method, s)
    raise BindError(f"can't stand here: {e!r}")


def arithmetic(e: A.Arith, s: Scope) -> Column:
    if e.op in ("add", "sub") and is_moment(e.left, s) and not is_moment(e.right, s):
        a, b = column(e.left, s), column(e.right, s)
        if not (isinstance(e.right, A.Lit) and e.right.kind == "duration"):
            b = F.make_dt_interval(b.cast("int"))  # numbers are days
        return a + b if e.op == "add" else a - b
    a, b = column(e.left, s), column(e.right, s)
    if e.op == "add":
        return a + b
    if e.op == "sub":
        return a - b
    if e.op == "mul":
        return a * b
    if e.op == "mod":
        return a % b
    if e.op == "div" and integral(e.left, s) and integral(e.right, s):
        return F.call_function("div", a, b)
    return a.cast("double") / b


def function(e: A.Func, s: Scope) -> Column:
    if e.name == "cast":
        if len(e.args) != 2:
            raise BindError("cast takes a value and a type")
        return scalar.cast(column(e.args[0], s), _cast_name(e))
    if e.name == "isof":
        return isof(e, s)
    if e.name == "contains" and len(e.args) == 2 and isinstance(e.args[1], A.Items):
        return column(e.args[0], s).isin(*[column(i, s) for i in e.args[1].items])
    kind = s.property_of(e.args[0]) if e.args else None
    own = s.udfs.get(e.name, kind is not None and isinstance(kind.type, T.BinaryType))
    if own is not None:
        return own(*[column(a, s) for a in e.args])
    try:
        return scalar.call(e.name, [column(a, s) for a in e.args])
    except scalar.FunctionError as x:
        raise BindError(str(x)) from x


def isof(e: A.Func, s: Scope) -> Column:
    """Whether the row, or a navigation's target, is of a type or of one derived from it."""
    name = _cast_name(e)
    at = e.args[0].parts if len(e.args) == 2 and isinstance(e.args[0], A.Path) else ()
    own = s.row_type(at) if s.row_type else s.type
    names = [t.name for t in s.model.subtypes(s.model.type(name))]
    if s.model.is_polymorphic(own):
        return s.resolve((*at, TYPE_NAME))[0].isin(*names)
    return F.lit(own.name in names)


def predicate(e: A.Expr, s: Scope) -> Column:
    """A boolean Column, null where SQL says unknown."""
    if id(e) in s.flags:
        return s.flags[id(e)]
    if isinstance(e, A.And):
        out = predicate(e.items[0], s)
        for i in e.items[1:]:
            out = out & predicate(i, s)
        return out
    if isinstance(e, A.Or):
        out = predicate(e.items[0], s)
        for i in e.items[1:]:
            out = out | predicate(i, s)
        return out
    if isinstance(e, A.Not):
        return ~predicate(e.item, s)
    if isinstance(e, A.In):
        p = s.property_of(e.left)
        items = [x for i in e.items for x in _listed(i, s)]
        return column(e.left, s).isin(*[column(i, s, p) for i in items])
    if isinstance(e, A.Cmp):
        return comparison(e, s)
    if isinstance(e, A.Quant):
        raise BindError("any and all can't stand here")
    return column(e, s)


def _listed(e: A.Expr, s: Scope) -> list[A.Expr]:
    if isinstance(e, A.Param) and isinstance(s.params.get(e.name), A.Items):
        return list(s.params[e.name].items)
    return [e]


def comparison(e: A.Cmp, s: Scope) -> Column:
    left, right = e.left, e.right
    if isinstance(right, A.Param) and isinstance(s.params.get(right.name), A.Items):  # a list: any of it, or none for ne
        inside = predicate(A.In(left, s.params[right.name].items), s)
        if e.op not in ("eq", "ne"):
            raise BindError(f"{e.op} doesn't take a list")
        return inside if e.op == "eq" else ~inside
    if isinstance(left, A.Lit) and left.kind == "null":
        left, right = right, left
    if isinstance(right, A.Lit) and right.kind == "null":
        if e.op not in ("eq", "ne"):
            return F.lit(None).cast("boolean")
        c = column(left, s)
        return c.isNull() if e.op == "eq" else c.isNotNull()
    a, b = column(left, s, s.property_of(right)), column(right, s, s.property_of(left))
    if e.op == "has":
        return a.bitwiseAND(b) != 0
    return {"eq": a.__eq__, "ne": a.__ne__, "gt": a.__gt__, "ge": a.__ge__, "lt": a.__lt__, "le": a.__le__}[e.op](b)


def aggregate(e: A.Expr, method: str, s: Scope) -> Column:
    if isinstance(e, A.Star):
        if method != "count":
            raise BindError(f"* goes with count, not {method}")
        return F.count(F.lit(1))
    c = column(e, s)
    if method in ("merge", "none"):
        return c
    return {"sum": F.sum, "min": F.min, "max": F.max, "average": F.avg, "count": F.count, "countdistinct": F.count_distinct}[method](c)
