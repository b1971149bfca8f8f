"""Scalar functions of the query language and the registry of user-defined ones, as Columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


class FunctionError(ValueError):
    pass


# The language's type names for cast().
CASTS = {
    "string": T.StringType(), "int32": T.IntegerType(), "int64": T.LongType(), "int16": T.ShortType(), "byte": T.ShortType(), "sbyte": T.ShortType(),
    "double": T.DoubleType(), "single": T.FloatType(), "decimal": T.DecimalType(19, 9), "boolean": T.BooleanType(), "datetimeoffset": T.TimestampType(),
    "datetime": T.TimestampNTZType(), "date": T.DateType(), "guid": T.StringType(), "binary": T.BinaryType(), "time": T.StringType(), "timeofday": T.StringType(), "duration": T.DayTimeIntervalType(),
}


def cast_type(name: str) -> T.DataType:
    kind = name.strip().removeprefix("Edm.").lower()
    if kind not in CASTS:
        raise FunctionError(f"no type {name!r} to cast to")
    return CASTS[kind]


def cast(c: Column, name: str) -> Column:
    kind = name.strip().removeprefix("Edm.").lower()
    return F.date_format(c, "HH:mm:ss.SSSSSS") if kind in ("time", "timeofday") else c.cast(cast_type(name))


_one: dict[str, Callable[[Column], Column]] = {
    "toupper": F.upper, "tolower": F.lower, "trim": F.trim, "length": F.length, "year": F.year, "month": F.month, "day": F.dayofmonth, "hour": F.hour, "minute": F.minute, "second": F.second,
    "fractionalseconds": lambda c: F.date_format(c, "SSS").cast("int"), "totaloffsetminutes": lambda c: F.when(c.isNotNull(), F.lit(0)),
    "totalseconds": lambda c: F.floor(F.unix_micros((F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + c).cast("timestamp")) / 1_000_000).cast("long"),
    "round": lambda c: F.round(c), "floor": F.floor, "ceiling": F.ceil, "date": F.to_date, "time": lambda c: F.date_format(c, "HH:mm:ss.SSSSSS"),
}
_none: dict[str, Callable[[], Column]] = {
    "now": F.current_timestamp, "mindatetime": lambda: F.lit("0001-01-01 00:00:00").cast("timestamp_ntz"), "maxdatetime": lambda: F.lit("9999-12-31 23:59:59").cast("timestamp_ntz"),
}
UNSUPPORTED = ("geo.distance", "geo.length", "geo.intersects")


def call(name: str, args: list[Column]) -> Column:
    """A built-in by name. substring and indexof count from 1, and indexof gives 0 for what is absent."""
    n = len(args)
    if name in _one and n == 1:
        return _one[name](args[0])
    if name in _none and n == 0:
        return _none[name]()
    if name == "substring" and n == 2:
        return F.substring(args[0], args[1], F.length(args[0]))
    if name == "substring" and n == 3:
        return F.substring(*args)
    if name == "indexof" and n == 2:
        return F.instr(args[0], args[1])
    if name == "concat" and n >= 1:
        return F.concat(*[a.cast("string") for a in args])
    if name == "contains" and n == 2:
        return F.contains(*args)
    if name == "startswith" and n == 2:
        return F.startswith(*args)
    if name == "endswith" and n == 2:
        return F.endswith(*args)
    if name in UNSUPPORTED:
        raise FunctionError(f"{name} isn't supported")
    raise FunctionError(f"no function {name!r} of {n} arguments")


class Udfs:
    """User-defined functions: case-insensitive name -> Callable of Columns. Names may have a dot."""

    def __init__(self, more: dict[str, Callable[..., Column]] | None = None):
        self.by_name = {k.lower(): v for k, v in (DEFAULT | (more or {})).items()}

    def register(self, name: str, f: Callable[..., Column]) -> None:
        self.by_name[name.lower()] = f

    def configure(self, config: dict[str, str]) -> None:
        """A stored type's functions by configuration: Name, and the functions under AggregateFunction (rows to a value), Merge (values to
        one), ToBinary and FromBinary, each the name of a registered function or of one of Spark's. They become name.aggregate and so on;
        name.aggregate of a stored (binary) value merges."""
        for key, own in (("AggregateFunction", "aggregate"), ("Merge", "aggregate@digest"), ("ToBinary", "tobinary"), ("FromBinary", "frombinary")):
            if key in config:
                f = self.get(config[key])
                self.register(f"{config['Name']}.{own}", f or (lambda *args, name=config[key]: F.call_function(name, *args)))

    def get(self, name: str, digest: bool = False) -> Callable[..., Column] | None:
        """digest: whether the argument is a stored digest (binary), for which a function may have a form of its own."""
        return (self.by_name.get(f"{name.lower()}@digest") if digest else None) or self.by_name.get(name.lower())


#: Values of an enumeration whose histogram is exact; the sketch under it tracks twice as many. More raise an error when run.
VALUES = 10_000


def histogram_text(c: Column) -> Column:
    """An enumeration histogram as text: value=count pairs in order of value; nulls aren't counted.

    Counts come from a frequent-items sketch, which combines before the shuffle and is exact while it needn't drop values.
    """
    pairs = F.filter(F.call_function("approx_top_k", c, F.lit(VALUES + 1), F.lit(4 * VALUES)), lambda x: x["item"].isNotNull())
    error = F.raise_error(F.lit(f"a histogram of more than {VALUES} values")).cast("string")
    text = F.array_join(F.transform(F.array_sort(pairs), lambda x: F.concat(x["item"].cast("string"), F.lit("="), x["count"].cast("string"))), ",")
    return F.when(F.size(pairs) > VALUES, error).otherwise(text)


def _quantile(c: Column, q: Column) -> Column:
    return F.call_function("kll_sketch_get_quantile_double", F.call_function("kll_merge_agg_double", c), q.cast("double"))


def _spread(c: Column) -> Column:
    """Quantiles of a merged digest at the middles of 200 equal shares."""
    return F.call_function("kll_sketch_get_quantile_double", F.call_function("kll_merge_agg_double", c), F.array(*[F.lit((k + 0.5) / 200) for k in range(200)]))


def _mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values)


def _variance(values: Column) -> Column:
    return _mean(F.transform(values, lambda x: x * x)) - _mean(values) * _mean(values)


DEFAULT: dict[str, Callable[..., Column]] = {
    "p.getquantile": lambda c, q: F.percentile_approx(c, q, 10_000),
    "p.variance": F.var_pop,
    "p.average": F.avg,
    "p.minimum": F.min,
    "p.maximum": F.max,
    "p.cardinality": F.count,
    "eh.cardinality": lambda c: F.count(c).cast("double"),
    "eh.tostring": histogram_text,
    "digest.merge": lambda c: F.kll_sketch_agg_double(c.cast("double")),
    # Over stored digests: merged exactly as sketches merge; average and variance are those of their quantiles.
    "digest.merge@digest": lambda c: F.call_function("kll_merge_agg_double", c),
    "p.getquantile@digest": _quantile,
    "p.minimum@digest": lambda c: _quantile(c, F.lit(0.0)),
    "p.maximum@digest": lambda c: _quantile(c, F.lit(1.0)),
    "p.cardinality@digest": lambda c: F.sum(F.call_function("kll_sketch_get_n_double", c)),
    "p.average@digest": lambda c: _mean(_spread(c)),
    "p.variance@digest": lambda c: _variance(_spread(c)),
}
