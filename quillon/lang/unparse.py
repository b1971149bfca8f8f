"""Syntax trees back to URL text, so that parse(unparse(q)) equals q; and to and from XML."""

from __future__ import annotations

import datetime as dt
import xml.etree.ElementTree as ET
from decimal import Decimal
from typing import Any
from urllib.parse import quote

from quillon.lang import ast as A

LEVEL = {A.Or: 0, A.And: 1, A.Not: 2, A.Cmp: 3, A.In: 3, A.Arith: 4}


def duration_text(value: dt.timedelta) -> str:
    sign, value = ("-", -value) if value < dt.timedelta(0) else ("", value)
    hours, rest = divmod(value.seconds, 3600)
    minutes, seconds = divmod(rest, 60)
    tail = f"{seconds}.{value.microseconds:06d}".rstrip("0") if value.microseconds else str(seconds)
    return f"{sign}P{value.days}DT{hours}H{minutes}M{tail}S"


def literal(e: A.Lit) -> str:
    v = e.value
    if e.kind == "null":
        return "null"
    if e.kind == "string":
        return "'" + v.replace("'", "''") + "'"
    if e.kind == "bool":
        return str(v).lower()
    if e.kind == "long":
        return f"{v}L"
    if e.kind == "decimal":
        return f"{v}m"
    if e.kind == "double":
        text = repr(float(v))
        return text if any(c in text for c in ".e") else text + ".0"
    if e.kind == "duration":
        return f"duration'{duration_text(v)}'"
    if e.kind in ("datetime", "datetimeoffset"):
        return v.isoformat()
    if e.kind == "binary":
        return f"binary'{v.hex()}'"
    if e.kind == "enum":
        return f"{v[0]}'" + v[1].replace("'", "''") + "'"
    return str(v)


def text(e: Any) -> str:
    def below(x: Any, level: int) -> str:
        own = LEVEL.get(type(x), 9)
        return f"({text(x)})" if own < level else text(x)

    if isinstance(e, A.Lit):
        return literal(e)
    if isinstance(e, A.Path):
        return "/".join(e.parts) or "$it"
    if isinstance(e, A.Star):
        return "*"
    if isinstance(e, A.Param):
        return f"@{e.name}"
    if isinstance(e, A.Func):
        return f"{e.name}({','.join(text(a) for a in e.args)})"
    if isinstance(e, A.Items):
        return f"({','.join(text(a) for a in e.items)})"
    if isinstance(e, A.Arith):
        side = lambda x: f"({text(x)})" if isinstance(x, A.Arith) else f"({text(x)})" if isinstance(x, A.With) else below(x, 4)
        return f"{side(e.left)} {e.op} {side(e.right)}"
    if isinstance(e, A.Cmp):
        return f"{below(e.left, 4)} {e.op} {below(e.right, 4)}"
    if isinstance(e, A.In):
        return f"{below(e.left, 4)} in ({','.join(text(i) for i in e.items)})"
    if isinstance(e, A.Not):
        return f"not ({text(e.item)})"
    if isinstance(e, (A.And, A.Or)):
        word, level = (" and ", 2) if isinstance(e, A.And) else (" or ", 1)
        return word.join(below(i, level) for i in e.items)
    if isinstance(e, A.Quant):
        inner = "" if e.predicate is None else f"{e.var}: {text(e.predicate)}"
        return f"{'/'.join(e.path)}/{e.kind}({inner})"
    if isinstance(e, A.With):
        return f"{below(e.expr, 5)} with {e.method}" + "".join(f" from {text(x)} with {m}" for x, m in e.froms)
    raise TypeError(f"can't write {e!r}")


def options(q: A.Query) -> list[tuple[str, str]]:
    named = lambda xs: ",".join(f"{text(n.expr)} as {n.alias}" for n in xs)
    out = [(f"${k}", text(getattr(q, k))) for k in ("filter",) if getattr(q, k) is not None]
    out += [(k, text(getattr(q, k))) for k in ("where", "having") if getattr(q, k) is not None]
    if q.select:
        out.append(("$select", ",".join("/".join(p.parts) for p in q.select)))
    if q.orderby:
        out.append(("$orderby", ",".join(text(o.expr) + (" desc" if o.descending else "") for o in q.orderby)))
    out += [(f"${k}", str(getattr(q, k))) for k in ("top", "skip") if getattr(q, k) is not None]
    if q.expand:
        out.append(("$expand", ",".join(expand(e) for e in q.expand)))
    if q.count:
        out.append(("$count", "true"))
    if q.format:
        out.append(("$format", q.format))
    if q.groupby or q.rollup:
        keys = [text(k) for k in q.groupby] + ([f"rollup({','.join(text(k) for k in q.rollup)})"] if q.rollup else [])
        out.append(("groupby", f"({','.join(keys)})"))
    out += [(k, named(getattr(q, k))) for k in ("aggregate", "compute") if getattr(q, k)]
    if q.shard is not None:
        out.append(("shard", ",".join(map(str, q.shard)) or "all"))
    out += [(k, getattr(q, k)) for k in ("store", "user") if getattr(q, k)]
    if q.concurrency:
        out.append(("concurrency", "true"))
    if q.with_ties:
        out.append(("withties", "true"))
    if q.search:
        out.append(("$search", q.search))
    return out + [(f"@{k}", text(v)) for k, v in q.params.items()] + list(q.custom.items())


def expand(e: A.Expand) -> str:
    own = options(e.query) + ([("$levels", str(e.levels))] if e.levels != 1 else [])
    return "/".join(e.path) + ("/$ref" if e.ref else "") + (f"({';'.join(f'{k}={v}' for k, v in own)})" if own else "")


def path(q: A.Query) -> str:
    def keys(s: A.Segment) -> str:
        return "" if s.keys is None else "(" + ",".join(text(v) if k is None else f"{k}={text(v)}" for k, v in s.keys.items()) + ")"

    return "/" + "/".join(quote(s.name, safe="$.") + quote(keys(s), safe="(),='@") for s in q.path)


def url(q: A.Query) -> str:
    own = "&".join(f"{k}={quote(v, safe="/(),=':;$@*")}" for k, v in options(q))
    return path(q) + (f"?{own}" if own else "")


# -- XML ----------------------------------------------------------------------------------------------------------------


def to_xml(q: A.Query) -> str:
    """A query as XML: one element for each option; expressions keep their URL text, checked when they are read."""
    root = ET.Element("Query")
    ET.SubElement(root, "Path").text = path(q)
    for name, value in options(q):
        ET.SubElement(root, "Option", Name=name).text = value
    return ET.tostring(root, encoding="unicode")


def from_xml(xml: str) -> A.Query:
    from quillon.lang import parser as P

    root = ET.fromstring(xml)
    if root.tag != "Query":
        raise P.QuerySyntaxError("not a Query element")
    given = {}
    for o in root.findall("Option"):
        name = o.get("Name") or ""
        given[name if name.startswith("@") else name.lstrip("$").lower()] = o.text or ""
    q = P.build(given)
    q.path = P.parse_path(root.findtext("Path") or "")
    return q


def plain(value: Any) -> Any:
    """A literal's Python value for JSON."""
    return float(value) if isinstance(value, Decimal) else value
