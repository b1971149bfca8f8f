"""Column and value maps, row filters, retention, banding and time aggregates, as configured feeds use them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.scalar import cast_type
from quillon.plans.columns import BindError, ref


@dataclass(frozen=True)
class ColumnMap:
    """to <- source, with values replaced: text of the source value -> value, cast to type; what no entry matches passes through.

    nested: a map of its own for a dimension in a struct column; key: a navigation's struct gives way to this field of it.
    """

    to: str
    source: str
    values: dict[str, object] = field(default_factory=dict)
    type: str | None = None
    nested: tuple[ColumnMap, ...] = ()
    key: str | None = None


def mapped(df: DataFrame, maps: list[ColumnMap]) -> DataFrame:
    """Columns renamed, reordered and replaced: plain ones first, then dimensions."""
    plain = [m for m in maps if not m.nested]
    return df.select(*[_mapped(m, ref(m.source)).alias(m.to) for m in [*plain, *[m for m in maps if m.nested]]])


def _mapped(m: ColumnMap, c: Column) -> Column:
    if m.key:
        c = c.getField(m.key)
    if m.nested:
        return F.when(c.isNotNull(), F.struct(*[_mapped(n, c.getField(n.source)).alias(n.to) for n in m.nested]))
    if m.values:
        kind = cast_type(m.type) if m.type else None
        lit = lambda v: F.lit(v).cast(kind) if kind else F.lit(v)
        out = None
        for k, v in m.values.items():
            hit = c.cast("string") == F.lit(k)
            out = F.when(hit, lit(v)) if out is None else out.when(hit, lit(v))
        return out.otherwise(c.cast(kind) if kind else c)
    return c.cast(cast_type(m.type)) if m.type else c


def filtered(df: DataFrame, filters: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """Rows whose named columns all pass."""
    for name, f in filters.items():
        if name not in df.columns:
            raise BindError(f"no column {name!r} to filter")
        df = df.where(f(ref(name)))
    return df


def retained(df: DataFrame, column: str, days: int, now: Column | None = None, phased_out: bool = False) -> DataFrame:
    """Rows of the last days; none once the entity is phased out."""
    if phased_out:
        return df.where(F.lit(False))
    return df.where(ref(column) >= (now if now is not None else F.current_timestamp()) - F.make_dt_interval(F.lit(days)))


def banded(df: DataFrame, column: str, bands: list[tuple[float | None, float | None, str]], to: str, otherwise: str | None = None) -> DataFrame:
    """A column with the name of the first band, low <= value < high, that holds the value."""
    out = F.lit(None).cast("string")
    for low, high, name in reversed(bands):
        hit = F.lit(True)
        hit = hit & (ref(column) >= low) if low is not None else hit
        hit = hit & (ref(column) < high) if high is not None else hit
        out = F.when(hit, F.lit(name)).otherwise(out)
    return df.withColumn(to, F.when(ref(column).isNull(), F.lit(otherwise)).otherwise(F.coalesce(out, F.lit(otherwise))))


PERIODS = {"hourly": "hour", "daily": "day", "weekly": "week", "monthly": "month"}


def time_aggregate(df: DataFrame, time: str, period: str, grain: list[str], aggregates: dict[str, tuple[str, str]], where: Column | None = None, computed: dict[str, Column] | None = None) -> DataFrame:
    """Aggregates by period and grain. aggregates: name -> (sum, max, min or latest, column); latest is the value at the greatest time,
    of equal times the greatest value. computed: columns made before aggregating."""
    if period.lower() not in PERIODS:
        raise BindError(f"no period {period!r}")
    df = df.withColumns(computed) if computed else df
    df = df.where(where) if where is not None else df
    aggs = []
    for name, (kind, c) in aggregates.items():
        if kind not in ("sum", "max", "min", "latest"):
            raise BindError(f"no aggregate {kind!r}")
        aggs.append((F.max_by(ref(c), F.struct(ref(time), ref(c))) if kind == "latest" else {"sum": F.sum, "max": F.max, "min": F.min}[kind](ref(c))).alias(name))
    return df.groupBy(F.date_trunc(PERIODS[period.lower()], ref(time)).alias("period"), *[ref(g) for g in grain]).agg(*aggs)
