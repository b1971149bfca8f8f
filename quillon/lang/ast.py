"""Syntax trees of the query language."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any


class Expr:
    __slots__ = ()


@dataclass(frozen=True)
class Lit(Expr):
    """kind: string, int, long, double, decimal, bool, null, datetimeoffset, datetime, duration, guid, enum (value: (type, text)), binary."""

    value: Any
    kind: str


@dataclass(frozen=True)
class Path(Expr):
    """Names from the current row on; () is the row itself ($it). Type casts are names with a dot."""

    parts: tuple[str, ...]


@dataclass(frozen=True)
class Star(Expr):
    pass


@dataclass(frozen=True)
class Param(Expr):
    name: str


@dataclass(frozen=True)
class Func(Expr):
    name: str
    args: tuple[Expr, ...]


@dataclass(frozen=True)
class Arith(Expr):
    op: str  # add sub mul div divby mod
    left: Expr
    right: Expr


@dataclass(frozen=True)
class Cmp(Expr):
    op: str  # eq ne gt ge lt le has
    left: Expr
    right: Expr


@dataclass(frozen=True)
class In(Expr):
    left: Expr
    items: tuple[Expr, ...]


@dataclass(frozen=True)
class Items(Expr):
    """A literal list as a function's argument."""

    items: tuple[Expr, ...]


@dataclass(frozen=True)
class And(Expr):
    items: tuple[Expr, ...]


@dataclass(frozen=True)
class Or(Expr):
    items: tuple[Expr, ...]


@dataclass(frozen=True)
class Not(Expr):
    item: Expr


@dataclass(frozen=True)
class Quant(Expr):
    """Navigation path / any or all (var: predicate); predicate None for any()."""

    path: tuple[str, ...]
    kind: str
    var: str | None = None
    predicate: Expr | None = None


@dataclass(frozen=True)
class With(Expr):
    """expr with method, inside an aggregate expression; froms: (expr, method) of `from` clauses."""

    expr: Expr
    method: str
    froms: tuple[tuple[Expr, str], ...] = ()


@dataclass(frozen=True)
class Named:
    expr: Expr
    alias: str


@dataclass(frozen=True)
class Order:
    expr: Expr
    descending: bool = False


@dataclass
class Segment:
    """One step of a resource path: a set, navigation, property or type name, with keys where given."""

    name: str
    keys: dict[str | None, Expr] | None = None


@dataclass
class Query:
    path: list[Segment] = field(default_factory=list)
    filter: Expr | None = None
    where: Expr | None = None
    select: list[Path] = field(default_factory=list)
    orderby: list[Order] = field(default_factory=list)
    top: int | None = None
    skip: int | None = None
    expand: list[Expand] = field(default_factory=list)
    count: bool = False
    format: str | None = None
    groupby: list[Expr] = field(default_factory=list)
    rollup: list[Expr] = field(default_factory=list)
    aggregate: list[Named] = field(default_factory=list)
    compute: list[Named] = field(default_factory=list)
    having: Expr | None = None
    apply: list = field(default_factory=list)
    search: str | None = None
    store: str | None = None
    shard: list[int] | None = None  # None: the default shardlet; []: all
    concurrency: bool = False
    user: str | None = None
    with_ties: bool = False
    params: dict[str, Expr] = field(default_factory=dict)
    custom: dict[str, str] = field(default_factory=dict)

    @property
    def aggregated(self) -> bool:
        return bool(self.groupby or self.rollup or self.aggregate)


@dataclass
class Expand:
    path: tuple[str, ...]
    query: Query = field(default_factory=Query)
    levels: int = 1
    ref: bool = False


def children(e: Any) -> list[Expr]:
    """Direct sub-expressions, predicates of quantifiers included."""
    if isinstance(e, (Arith, Cmp)):
        return [e.left, e.right]
    if isinstance(e, Func):
        return list(e.args)
    if isinstance(e, In):
        return [e.left, *e.items]
    if isinstance(e, (And, Or, Items)):
        return list(e.items)
    if isinstance(e, Not):
        return [e.item]
    if isinstance(e, With):
        return [e.expr, *(x for x, _ in e.froms)]
    if isinstance(e, Quant):
        return [e.predicate] if e.predicate is not None else []
    return []


def walk(e: Any):
    if e is not None:
        yield e
        for c in children(e):
            yield from walk(c)


def conjuncts(e: Expr | None) -> list[Expr]:
    if e is None:
        return []
    return [x for i in e.items for x in conjuncts(i)] if isinstance(e, And) else [e]


def conjunction(items: list[Expr]) -> Expr | None:
    return None if not items else items[0] if len(items) == 1 else And(tuple(items))


def comparisons(e: Expr | None, name: str) -> list[Any]:
    """Values that a property is compared with or listed in, anywhere in a predicate."""
    out: list[Any] = []
    for x in walk(e):
        if isinstance(x, Cmp) and x.left == Path((name,)) and isinstance(x.right, Lit):
            out.append(x.right.value)
        elif isinstance(x, In) and x.left == Path((name,)):
            out += [i.value for i in x.items if isinstance(i, Lit)]
    return out


def name_values(e: Expr | None) -> dict[str, list[Any]]:
    """Property names with the values they are tested for equality with."""
    out: dict[str, list[Any]] = {}
    for x in walk(e):
        if isinstance(x, Cmp) and x.op == "eq" and isinstance(x.left, Path) and isinstance(x.right, Lit):
            out.setdefault("/".join(x.left.parts), []).append(x.right.value)
        elif isinstance(x, In) and isinstance(x.left, Path):
            out.setdefault("/".join(x.left.parts), []).extend(i.value for i in x.items if isinstance(i, Lit))
    return out


def flatten(e: Expr | None) -> list[Expr]:
    """The comparisons and other leaves of a predicate, in order."""
    if e is None:
        return []
    if isinstance(e, (And, Or)):
        return [x for i in e.items for x in flatten(i)]
    return flatten(e.item) if isinstance(e, Not) else [e]
