"""Lexer and precedence-climbing parser of URL queries.

From weakest to strongest: or, and, not, comparisons (eq ne gt ge lt le in has), add sub, mul div divby mod, primaries.
Option and function names are matched in any case and `$` before an option is optional.
"""

from __future__ import annotations

import datetime as dt
import re
from decimal import Decimal
from typing import Any
from urllib.parse import unquote_plus

from quillon.lang import ast as A


class QuerySyntaxError(ValueError):
    pass


#: Comparison words and arithmetic levels of the language.
COMPARISONS = ("eq", "ne", "gt", "ge", "lt", "le", "in", "has")
SUMS, PRODUCTS = ("add", "sub"), ("mul", "div", "divby", "mod")
METHODS = {"sum": "sum", "min": "min", "max": "max", "average": "average", "avg": "average", "count": "count", "countdistinct": "countdistinct", "merge": "merge", "none": "none"}
BOOLEAN = ("contains", "startswith", "endswith", "isof")

TOKEN = re.compile(
    r"""
    (?P<space>\s+)
  | (?P<duration>duration'(?P<dur>[^']*)')
  | (?P<binary>(?:binary'[0-9A-Fa-f]*'|0x(?:[0-9A-Fa-f]{2})+\b))
  | (?P<string>'(?:[^']|'')*')
  | (?P<datetime>\d{4}-\d\d-\d\d(?:T\d\d:\d\d(?::\d\d(?:\.\d+)?)?(?:Z|[+-]\d\d:\d\d)?)?(?![\w-]))
  | (?P<guid>[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12})
  | (?P<number>-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?(?P<suffix>[LlMmFfDd])?(?![\w]))
  | (?P<enum>[A-Za-z_][\w.]*'(?:[^']|'')*')
  | (?P<param>@[A-Za-z_]\w*)
  | (?P<name>[$A-Za-z_][\w$]*(?:\.[A-Za-z_]\w*)*)
  | (?P<punct>[(),/:=;*])
    """,
    re.X,
)
DURATION = re.compile(r"(-)?P(?:(\d+)D)?(?:T(?:(\d+)H)?(?:(\d+)M)?(?:(\d+(?:\.\d+)?)S)?)?$")


def duration(text: str) -> dt.timedelta:
    m = DURATION.match(text)
    if not m or text in ("P", "-P"):
        raise QuerySyntaxError(f"not a duration: {text!r}")
    out = dt.timedelta(days=int(m[2] or 0), hours=int(m[3] or 0), minutes=int(m[4] or 0), seconds=float(m[5] or 0))
    return -out if m[1] else out


def moment(text: str) -> A.Lit:
    """With an offset or Z a datetimeoffset, else a datetime."""
    value = dt.datetime.fromisoformat(text.replace("Z", "+00:00"))
    return A.Lit(value, "datetimeoffset" if value.tzinfo else "datetime")


class Tokens:
    def __init__(self, text: str):
        self.text, self.items, self.at = text, [], 0
        at = 0
        while at < len(text):
            m = TOKEN.match(text, at)
            if not m:
                raise QuerySyntaxError(f"unexpected {text[at : at + 20]!r} in {text!r}")
            if m.lastgroup != "space":
                kind = next(k for k in ("space", "duration", "binary", "string", "datetime", "guid", "number", "enum", "param", "name", "punct") if m[k] is not None)
                if kind != "space":
                    self.items.append((kind, m[kind], m))
            at = m.end()

    def peek(self, offset: int = 0) -> tuple[str, str]:
        k = self.at + offset
        return self.items[k][:2] if k < len(self.items) else ("end", "")

    def next(self) -> tuple[str, str, Any]:
        if self.at >= len(self.items):
            raise QuerySyntaxError(f"unexpected end of {self.text!r}")
        self.at += 1
        return self.items[self.at - 1]

    def accept(self, text: str) -> bool:
        kind, value = self.peek()
        if kind in ("punct", "name") and value.lower() == text:
            self.at += 1
            return True
        return False

    def expect(self, text: str) -> None:
        if not self.accept(text):
            raise QuerySyntaxError(f"expected {text!r} at {self.peek()[1]!r} in {self.text!r}")

    def word(self, *words: str) -> str | None:
        kind, value = self.peek()
        return value.lower() if kind == "name" and value.lower() in words and self.peek(1)[1] != "/" else None

    @property
    def done(self) -> bool:
        return self.at >= len(self.items)


def literal(kind: str, text: str, m: Any) -> A.Lit | None:
    if kind == "string":
        return A.Lit(text[1:-1].replace("''", "'"), "string")
    if kind == "duration":
        return A.Lit(duration(m["dur"]), "duration")
    if kind == "binary":
        return A.Lit(bytes.fromhex(text[2:] if text.startswith("0x") else text[7:-1]), "binary")
    if kind == "datetime":
        return moment(text)
    if kind == "guid":
        return A.Lit(text.lower(), "guid")
    if kind == "number":
        suffix = (m["suffix"] or "").lower()
        body = text[:-1] if suffix else text
        if suffix == "l":
            return A.Lit(int(body), "long")
        if suffix == "m":
            return A.Lit(Decimal(body), "decimal")
        if suffix or "." in body or "e" in body.lower():
            return A.Lit(float(body), "double")
        return A.Lit(int(body), "int" if -(2**31) <= int(body) < 2**31 else "long")
    if kind == "enum":
        name, _, rest = text.partition("'")
        return A.Lit((name, rest[:-1].replace("''", "'")), "enum")
    if kind == "name" and text.lower() in ("true", "false"):
        return A.Lit(text.lower() == "true", "bool")
    return A.Lit(None, "null") if kind == "name" and text.lower() == "null" else None


class Parser:
    def __init__(self, text: str):
        self.t = Tokens(text)

    def finish(self, value):
        if not self.t.done:
            raise QuerySyntaxError(f"unexpected {self.t.peek()[1]!r} in {self.t.text!r}")
        return value

    def expression(self) -> A.Expr:
        items = [self.conjunction()]
        while self.t.word("or"):
            self.t.next()
            items.append(self.conjunction())
        return items[0] if len(items) == 1 else A.Or(tuple(items))

    def conjunction(self) -> A.Expr:
        items = [self.negation()]
        while self.t.word("and"):
            self.t.next()
            items.append(self.negation())
        return items[0] if len(items) == 1 else A.And(tuple(items))

    def negation(self) -> A.Expr:
        if self.t.word("not"):
            self.t.next()
            return A.Not(self.negation())
        return self.comparison()

    def comparison(self) -> A.Expr:
        left = self.sum()
        op = self.t.word(*COMPARISONS)
        if not op:
            return left
        self.t.next()
        if op == "in":
            self.t.expect("(")
            items = [self.sum()]
            while self.t.accept(","):
                items.append(self.sum())
            self.t.expect(")")
            return A.In(left, tuple(items))
        right = self.sum()
        if isinstance(left, A.Quant) and isinstance(right, A.Lit) and right.kind == "bool" and op in ("eq", "ne"):
            return left if right.value == (op == "eq") else A.Not(left)
        return A.Cmp(op, left, right)

    def sum(self) -> A.Expr:
        left = self.product()
        while op := self.t.word(*SUMS):
            self.t.next()
            left = A.Arith(op, left, self.product())
        return left

    def product(self) -> A.Expr:
        left = self.primary()
        while op := self.t.word(*PRODUCTS):
            self.t.next()
            left = A.Arith(op, left, self.primary())
        return left

    def primary(self) -> A.Expr:
        kind, text, m = self.t.next()
        if kind == "punct" and text == "(":
            e = self.expression()
            if self.t.peek()[1] == ",":
                items = [e]
                while self.t.accept(","):
                    items.append(self.expression())
                self.t.expect(")")
                return A.Items(tuple(items))
            e = self.with_(e)
            self.t.expect(")")
            return e
        if kind == "punct" and text == "*":
            return A.Star()
        if kind == "param":
            return A.Param(text[1:])
        if (lit := literal(kind, text, m)) is not None:
            return lit
        if kind != "name":
            raise QuerySyntaxError(f"unexpected {text!r} in {self.t.text!r}")
        if self.t.peek()[1] == "(" and text.lower() not in ("any", "all"):
            self.t.next()
            args = []
            if not self.t.accept(")"):
                args.append(self.argument())
                while self.t.accept(","):
                    args.append(self.argument())
                self.t.expect(")")
            return A.Func(text.lower(), tuple(args))
        parts = [] if text == "$it" else [text]
        while self.t.accept("/"):
            kind, text, _ = self.t.next()
            if kind != "name":
                raise QuerySyntaxError(f"unexpected {text!r} in a path of {self.t.text!r}")
            if text.lower() in ("any", "all") and self.t.peek()[1] == "(":
                self.t.next()
                if self.t.accept(")"):
                    if text.lower() == "all":
                        raise QuerySyntaxError("all() needs a predicate")
                    return A.Quant(tuple(parts), "any")
                var = self.t.next()[1]
                self.t.expect(":")
                predicate = self.expression()
                self.t.expect(")")
                return A.Quant(tuple(parts), text.lower(), var, predicate)
            parts.append(text)
        return A.Path(tuple(parts))

    def argument(self) -> A.Expr:
        return self.expression()

    def with_(self, e: A.Expr) -> A.Expr:
        """expr with method (from expr with method)*, where it stands."""
        if not self.t.word("with"):
            return e
        self.t.next()
        method, froms = self.method(), []
        while self.t.word("from"):
            self.t.next()
            of = self.sum()
            self.t.expect("with")
            froms.append((of, self.method()))
        return A.With(e, method, tuple(froms))

    def method(self) -> str:
        name = self.t.next()[1].lower()
        if name not in METHODS:
            raise QuerySyntaxError(f"unknown aggregate {name!r}")
        return METHODS[name]

    def named(self) -> A.Named:
        e = self.with_(self.sum())
        while op := self.t.word(*SUMS, *PRODUCTS):  # arithmetic over aggregates
            self.t.next()
            e = A.Arith(op, e, self.with_(self.product()))
        froms = []
        alias = None
        if self.t.word("as"):
            self.t.next()
            alias = self.t.next()[1]
        while self.t.word("from"):
            self.t.next()
            of = self.sum()
            self.t.expect("with")
            froms.append((of, self.method()))
        if froms and isinstance(e, A.With):
            e = A.With(e.expr, e.method, (*e.froms, *froms))
        if isinstance(e, A.Path) and e.parts == ("count",):
            e = A.With(A.Star(), "count")
        if alias is None:
            raise QuerySyntaxError(f"{self.t.text!r} needs an alias")
        return A.Named(e, alias)

    def order(self) -> A.Order:
        e = self.expression()
        word = self.t.word("asc", "desc")
        if word:
            self.t.next()
        return A.Order(e, word == "desc")

    def listed(self, item) -> list:
        out = [item()]
        while self.t.accept(","):
            out.append(item())
        return out


def parse_filter(text: str) -> A.Expr:
    p = Parser(text)
    return p.finish(p.expression())


def parse_orderby(text: str) -> list[A.Order]:
    p = Parser(text)
    return p.finish(p.listed(p.order))


def parse_columns(text: str) -> list[A.Named]:
    """The value of aggregate= or compute=."""
    p = Parser(text)
    return p.finish(p.listed(p.named))


def parse_select(text: str) -> list[A.Path]:
    out = [A.Path(tuple(x.strip().split("/"))) for x in text.split(",") if x.strip()]
    return [] if out == [A.Path(("*",))] else out


def parse_groupby(text: str) -> tuple[list[A.Expr], list[A.Expr]]:
    """Plain keys, and the keys of rollup(...)."""
    text = text.strip()
    if text.startswith("(") and text.endswith(")") and _closing(text, 0) == len(text) - 1:
        text = text[1:-1]
    keys, rolled = [], []
    for part in split(text, ","):
        part = part.strip()
        if part.lower().startswith("rollup(") and part.endswith(")"):
            rolled += [parse_filter(x) for x in split(part[7:-1], ",")]
        elif part:
            keys.append(parse_filter(part))
    return keys, rolled


def _closing(text: str, at: int) -> int:
    depth, quoted = 0, False
    for k in range(at, len(text)):
        c = text[k]
        if c == "'":
            quoted = not quoted
        elif not quoted:
            depth += (c == "(") - (c == ")")
            if not depth:
                return k
    raise QuerySyntaxError(f"unbalanced parentheses in {text!r}")


def split(text: str, sep: str) -> list[str]:
    """Parts between separators outside quotes and parentheses."""
    out, depth, quoted, start = [], 0, False, 0
    for k, c in enumerate(text):
        if c == "'":
            quoted = not quoted
        elif not quoted:
            depth += (c == "(") - (c == ")")
            if c == sep and not depth:
                out.append(text[start:k])
                start = k + 1
    if depth or quoted:
        raise QuerySyntaxError(f"unbalanced text: {text!r}")
    return [*out, text[start:]]


def parse_expand(text: str) -> list[A.Expand]:
    out = []
    for part in split(text, ","):
        part = part.strip()
        if not part:
            continue
        options = ""
        if "(" in part:
            at = part.index("(")
            if _closing(part, at) != len(part) - 1:
                raise QuerySyntaxError(f"unexpected text after {part!r}")
            part, options = part[:at], part[at + 1 : -1]
        e = A.Expand(tuple(part.split("/")))
        if e.path[-1] == "$ref":
            e = A.Expand(e.path[:-1], ref=True)
        if options:
            pairs = dict(_option(o) for o in split(options, ";") if o.strip())
            levels = pairs.pop("levels", None)
            e.query = build(pairs)
            if levels is not None:
                if not levels.isdigit():
                    raise QuerySyntaxError("$levels must be a number: unbounded recursion isn't planned")
                e.levels = int(levels)
        out.append(e)
    return out


def _option(text: str) -> tuple[str, str]:
    name, sep, value = text.partition("=")
    if not sep:
        raise QuerySyntaxError(f"not an option: {text!r}")
    return name.strip().lstrip("$").lower(), value.strip()


def number(name: str, text: str) -> int:
    if not re.fullmatch(r"\d+", text.strip()):
        raise QuerySyntaxError(f"{name} must be a number that isn't negative: {text!r}")
    return int(text)


def flag(text: str) -> bool:
    if text.strip().lower() not in ("true", "false"):
        raise QuerySyntaxError(f"not true or false: {text!r}")
    return text.strip().lower() == "true"


def build(options: dict[str, str]) -> A.Query:
    """A query from lower-cased option names without `$`."""
    from quillon.lang.apply import parse_apply

    q = A.Query()
    for name, value in options.items():
        if len(split(value, "=")) > 1 and name not in ("expand", "apply") and not name.startswith("@") and name in KNOWN:
            raise QuerySyntaxError(f"a second = in the value of {name}")
        if name.startswith("@"):
            q.params[name[1:]] = parse_filter(value)
        elif name in ("filter", "where", "having"):
            setattr(q, name, parse_filter(value))
        elif name == "select":
            q.select = parse_select(value)
        elif name == "orderby":
            q.orderby = parse_orderby(value)
        elif name in ("top", "skip"):
            setattr(q, name, number(name, value))
        elif name == "expand":
            q.expand = parse_expand(value)
        elif name in ("count", "concurrency", "withties"):
            setattr(q, "with_ties" if name == "withties" else name, flag(value))
        elif name == "groupby":
            q.groupby, q.rollup = parse_groupby(value)
        elif name in ("aggregate", "compute"):
            setattr(q, name, parse_columns(value))
        elif name == "apply":
            q.apply = parse_apply(value)
        elif name == "shard":
            q.shard = [] if value.strip().lower() == "all" else [int(x) for x in value.split(",")]
        elif name in ("format", "store", "user", "search"):
            setattr(q, name, value)
        else:
            q.custom[name] = value
    if q.compute and q.aggregated:
        raise QuerySyntaxError("compute doesn't go with aggregate or groupby")
    return q


KNOWN = ("filter", "where", "having", "select", "orderby", "top", "skip", "count", "groupby", "aggregate", "compute", "format", "store", "shard", "concurrency", "user", "withties")


def parse_path(text: str) -> list[A.Segment]:
    out = []
    for part in (p for p in split(text.strip().strip("/"), "/") if p):
        keys = None
        if part.endswith(")") and "(" in part:
            at = part.index("(")
            name, inner = part[:at], part[at + 1 : -1]
            keys = {}
            for k in split(inner, ","):
                prop, sep, value = k.partition("=")
                if sep and re.fullmatch(r"\s*[A-Za-z_]\w*\s*", prop):
                    keys[prop.strip()] = parse_filter(value)
                elif k.strip():
                    keys[None] = parse_filter(k)
            part = name
        out.append(A.Segment(part, keys))
    return out


def parse_url(url: str) -> A.Query:
    """A relative URL: /Set(key)/Nav?$filter=...&$top=..."""
    path, _, query = url.partition("?")
    options: dict[str, str] = {}
    for part in _ampersands(query):
        if not part:
            continue
        name, sep, value = part.partition("=")
        name = unquote_plus(name).strip()
        name = name if name.startswith("@") else name.lstrip("$").lower()
        if not sep:
            raise QuerySyntaxError(f"not an option: {part!r}")
        if name in options:
            raise QuerySyntaxError(f"{name} is given twice")
        options[name] = unquote_plus(value.replace("+", "%2B"))
    q = build(options)
    q.path = parse_path(unquote_plus(path.replace("+", "%2B")))
    return q


def _ampersands(text: str) -> list[str]:
    out, quoted, start = [], False, 0
    for k, c in enumerate(text):
        if c == "'":
            quoted = not quoted
        elif c == "&" and not quoted:
            out.append(text[start:k])
            start = k + 1
    return [*out, text[start:]]
