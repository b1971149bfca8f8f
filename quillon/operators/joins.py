"""Joins of two frames by key, with the kinds, hints and further conditions that planned queries may ask for."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.plans.columns import BindError, ref

KINDS = {"left": "left", "right": "right", "inner": "inner", "merge": "inner", "full": "full", "anti": "left_anti", "semi": "left_semi"}


def join(left: DataFrame, right: DataFrame, keys: list[tuple[str, str]], kind: str = "inner", prefix: str = "right.", unless: Column | None = None) -> DataFrame:
    """left joined to right where all key pairs are equal. kind: left, right, inner, merge (inner, by sorting both sides), full, semi or anti.

    right's columns are named prefix + name, so that none clashes; `unless`, a condition over these names, keeps rows from matching
    (unknown doesn't).
    """
    if kind not in KINDS:
        raise BindError(f"no join {kind!r}")
    if not keys:
        raise BindError("a join needs keys")
    right = right.select(*[ref(c).alias(prefix + c) for c in right.columns])
    right = right.hint("merge") if kind == "merge" else right
    on = reduce(lambda a, b: a & b, [ref(a) == ref(prefix + b) for a, b in keys])
    if unless is not None:
        on = on & ~F.coalesce(unless, F.lit(False))
    return left.join(right, on, KINDS[kind])


def skipped(df: DataFrame, order: list[Column], keys: list[str], skip: int, top: int | None = None) -> DataFrame:
    """Rows after the first `skip` in order, by an anti join with these: for rows that may repeat between pages it takes keys, which
    must be unique and end the order."""
    first = df.orderBy(*order).limit(skip).select(*[ref(k).alias(f"?{k}") for k in keys])
    rest = df.join(first, reduce(lambda a, b: a & b, [ref(k) == ref(f"?{k}") for k in keys]), "left_anti").orderBy(*order)
    return rest.limit(top) if top is not None else rest
