"""$apply pipelines: transformations in sequence, parsed to (name, arguments) steps."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from quillon.lang import ast as A

RANKED = ("topcount", "topsum", "toppercent", "bottomcount", "bottomsum", "bottompercent")


@dataclass
class Step:
    """name: filter, groupby, aggregate, compute, identity, concat, expand, search or one of RANKED."""

    name: str
    args: list[Any] = field(default_factory=list)


def parse_apply(text: str) -> list[Step]:
    from quillon.lang import parser as P

    steps = []
    for part in P.split(text, "/"):
        part = part.strip()
        name, sep, rest = part.partition("(")
        name = name.strip().lower()
        inner = rest[:-1] if sep and rest.endswith(")") else ""
        if name == "identity":
            steps.append(Step(name))
        elif not sep or not rest.endswith(")"):
            raise P.QuerySyntaxError(f"not a transformation: {part!r}")
        elif name == "filter":
            steps.append(Step(name, [P.parse_filter(inner)]))
        elif name in ("aggregate", "compute"):
            steps.append(Step(name, [P.parse_columns(inner)]))
        elif name == "groupby":
            parts = P.split(inner, ",")
            keys, rolled = P.parse_groupby(parts[0])
            below = parse_apply(",".join(parts[1:])) if len(parts) > 1 else []
            steps.append(Step(name, [keys, rolled, below]))
        elif name in RANKED:
            n, _, by = inner.partition(",")
            steps.append(Step(name, [P.parse_filter(n), P.parse_filter(by)]))
        elif name == "concat":
            steps.append(Step(name, [[parse_apply(x) for x in P.split(inner, ",")]]))
        elif name == "expand":
            nav, *more = P.split(inner, ",")
            e = A.Expand(tuple(nav.strip().split("/")))
            for x in more:
                below = parse_apply(x)
                if len(below) != 1 or below[0].name not in ("filter", "expand"):
                    raise P.QuerySyntaxError("expand takes filter and expand")
                if below[0].name == "filter":
                    e.query.filter = below[0].args[0]
                else:
                    e.query.expand.append(below[0].args[0])
            steps.append(Step(name, [e]))
        elif name == "search":
            steps.append(Step(name, [inner.strip().strip('"')]))
        else:
            raise P.QuerySyntaxError(f"unknown transformation {name!r}")
    return steps
