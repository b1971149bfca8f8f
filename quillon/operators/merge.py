"""Upsert, update, delete, insert and link as functions from snapshots to snapshots.

Parquet tables can't be merged in place, so each returns the target's next snapshot as a lazy frame: a full outer join on the
key, or an anti join for deletes. Publishing a snapshot is transactions.Snapshots' business.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.model import EntityModel, EntityType, Navigation
from quillon.plans.columns import BindError, ref


class ConcurrencyError(RuntimeError):
    pass


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _all(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def merge(
    target: DataFrame,
    source: DataFrame,
    keys: list[str],
    columns: list[str] | None = None,
    only_changed: bool = False,
    insert: bool = True,
    update: bool = True,
    delete_matched: bool = False,
    delete_unmatched: bool = False,
    update_unmatched: dict[str, Column] | None = None,
    condition: Column | None = None,
    concurrency: str | None = None,
    inserted_time: str | None = None,
    updated_time: str | None = None,
    changed_by: str | None = None,
    now: dt.datetime | None = None,
    user: str | None = None,
    action: bool = False,
    top: int | None = None,
) -> DataFrame:
    """The target after source's rows are merged into it on keys. Keys match null-safely never: a null key matches nothing.

    columns: what matched rows take from source, by default all that source has beside keys and audit columns; target columns
    that source lacks stay, or are null in inserted rows. only_changed leaves rows whose columns are all null-safely equal,
    and their update time. concurrency: a version column; ConcurrencyError if a key-matching row has another version (this
    runs a job). Source rows must have distinct keys; of repeated ones an arbitrary row would win, so they raise when run.
    action adds a column of INSERT, UPDATE, DELETE or null, and keeps deleted rows, so as to report them. update_unmatched and
    delete_unmatched treat target rows that source lacks. top: at most so many source rows, in key order.
    """
    audit = {c for c in (inserted_time, updated_time, changed_by) if c}
    missing = [k for k in keys if k not in source.columns or k not in target.columns]
    if missing:
        raise BindError(f"merge keys {missing} aren't in both frames")
    columns = [c for c in (columns or source.columns) if c not in keys and c not in audit]
    unknown = [c for c in columns if c not in target.columns]
    if unknown:
        raise BindError(f"target has no {unknown}")
    if concurrency:
        if concurrency not in source.columns:
            raise BindError(f"source has no {concurrency!r}")
        a, b = target.select(*keys, ref(concurrency).alias("?old")), source.select(*keys, ref(concurrency).alias("?new"))
        if not a.join(b, keys).where(~F.col("`?old`").eqNullSafe(F.col("`?new`"))).isEmpty():
            raise ConcurrencyError("Concurrency check failed.")
        columns = [c for c in columns if c != concurrency]
    if top is not None:
        source = source.orderBy(*keys).limit(top)
    src = checked_source(source, keys)
    s = src.selectExpr(*[f"{quoted(c)} as {quoted(f'?s.{c}')}" for c in source.columns], "`?salt` as `?s.salt`", "true as `?s`")
    t = salted(target, keys).withColumnRenamed("?salt", "?t.salt").withColumn("?t", F.lit(True))
    j = t.join(s, [*[ref(k) == ref(f"?s.{k}") for k in keys], ref("?t.salt") == ref("?s.salt")], "full_outer")
    in_t, in_s = ref("?t").isNotNull(), ref("?s").isNotNull()
    both = in_t & in_s
    met = both if condition is None else both & F.coalesce(condition, F.lit(False))
    changed = met
    if only_changed:
        diff = reduce(lambda a, b: a | b, [~ref(c).eqNullSafe(ref(f"?s.{c}")) for c in columns], F.lit(False))
        changed = met & diff
    updated = changed if update and not delete_matched else F.lit(False)
    inserted = ~in_t & in_s if insert else F.lit(False)
    lone = in_t & ~in_s
    dead = (met if delete_matched else F.lit(False)) | (lone if delete_unmatched else F.lit(False))
    when, by = F.lit(now) if now else F.current_timestamp(), F.lit(user)
    if now is not None and updated_time and target.schema[updated_time].dataType.simpleString() == "timestamp_ntz":
        when = F.lit(now.isoformat(" ")).cast("timestamp_ntz")
    touched = updated | inserted | (lone if update_unmatched else F.lit(False))
    j = j.withColumns({"?updated": updated, "?inserted": inserted})
    updated, inserted = ref("?updated"), ref("?inserted")
    out, given, special = [], set(source.columns), {*(update_unmatched or {}), *audit, concurrency}
    for f in target.schema.fields:
        name, kind = quoted(f.name), f.dataType.simpleString()
        theirs = f"cast({quoted(f'?s.{f.name}') if f.name in given else 'null'} as {kind})"
        if f.name not in special and "struct<" not in kind:  # most columns: one text each, which is far quicker to plan than as many Columns
            taken = f"coalesce({name}, {theirs})" if f.name in keys else f"if(`?updated` or `?inserted`, {theirs}, {name})" if f.name in columns else name
            out.append(F.expr(f"{taken} as {name}"))
            continue
        c = own = ref(f.name)
        new = (ref(f"?s.{f.name}") if f.name in given else F.lit(None)).cast(f.dataType)
        if f.name in keys:
            c = F.coalesce(own, new)
        elif f.name == inserted_time:
            c = F.when(inserted, when.cast(f.dataType)).otherwise(own)
        elif f.name == updated_time:
            c = F.when(touched, when.cast(f.dataType)).otherwise(own)
        elif f.name == changed_by:
            c = F.when(touched, by.cast(f.dataType)).otherwise(own)
        elif f.name == concurrency:
            c = F.when(updated, own + 1).when(inserted, F.coalesce(new, F.lit(1).cast(f.dataType))).otherwise(own)
        else:
            if f.name in columns:
                c = F.when(updated | inserted, new).otherwise(own)
            if update_unmatched and f.name in update_unmatched:
                c = F.when(lone, update_unmatched[f.name]).otherwise(c)
        out.append(c.alias(f.name))
    done = F.when(dead, F.lit("DELETE")).when(inserted, F.lit("INSERT")).when(updated, F.lit("UPDATE"))
    if update_unmatched:
        done = F.coalesce(done, F.when(lone, F.lit("UPDATE")))
    keep = in_t | inserted
    if action:
        return j.where(keep).select(*out, done.alias("action"))
    return j.where(keep & ~dead).select(*out)


#: Rows with a null in their key are dealt to so many tasks.
SALTS = 1024


def salted(df: DataFrame, keys: list[str]) -> DataFrame:
    """df with ?salt: 0, but for rows with a null in their key, which match nothing, a hash of the row that keeps them apart."""
    whole = " and ".join(f"{quoted(k)} is not null" for k in keys)
    plain = [quoted(f.name) for f in df.schema.fields if "map<" not in f.dataType.simpleString()]
    return df.selectExpr("*", f"if({whole}, 0, cast(pmod(xxhash64({', '.join(plain)}), {SALTS}) as int)) as `?salt`")


def checked_source(source: DataFrame, keys: list[str]) -> DataFrame:
    """source with ?salt, failing when run if a key comes twice. Rows with a null in their key match nothing and are left as they are.

    Counted over the merge's own keys and salt, so that the join after it needs no further shuffle of source.
    """
    n = F.count(F.lit(1)).over(Window.partitionBy(*[ref(k) for k in keys], ref("?salt")))
    whole = _all([ref(k).isNotNull() for k in keys])
    error = F.raise_error(F.lit("merge source has a key twice")).cast("boolean")
    return salted(source, keys).withColumn("?n", n).where(F.when(whole & (ref("?n") > 1), error).otherwise(F.lit(True))).drop("?n")


def delete(target: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """The target without rows whose key is in keys."""
    k = keys.select(*[ref(c).alias(f"?k.{c}") for c in on]).distinct()
    return target.join(k, [ref(c) == ref(f"?k.{c}") for c in on], "left_anti")


def delete_entity(model: EntityModel, t: EntityType, tables: dict[str, DataFrame], keys: DataFrame) -> dict[str, DataFrame]:
    """Every table of the type's lineage without the keys, derived tables first."""
    names = model.key(t)
    return {x.table: delete(tables[x.table], keys, names) for x in reversed(model.lineage(t)) if x.table}


def insert(target: DataFrame, rows: DataFrame, identity: str | None = None) -> DataFrame:
    """Appended rows. identity: a column that new rows get numbers in, after the largest so far."""
    if identity:
        first = target.agg(F.coalesce(F.max(ref(identity)), F.lit(0)).alias("?m"))
        rows = numbered(rows.drop(identity), identity).crossJoin(F.broadcast(first)).withColumn(identity, (ref(identity) + ref("?m")).cast(target.schema[identity].dataType)).drop("?m")
    return target.unionByName(rows.select(*[ref(f.name).cast(f.dataType).alias(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in target.schema.fields]))


def numbered(rows: DataFrame, name: str) -> DataFrame:
    """Consecutive numbers from 1 without a global sort: positions within partitions plus offsets, one row for each partition."""
    marked = rows.withColumn("?id", F.monotonically_increasing_id())
    part, place = F.shiftright("?id", 33), ref("?id").bitwiseAND(F.lit((1 << 33) - 1))
    marked = marked.withColumn("?part", part).withColumn("?place", place)
    counts = marked.groupBy("?part").agg(F.count(F.lit(1)).alias("?n"))
    starts = counts.select("?part", (F.sum("?n").over(Window.orderBy("?part")) - ref("?n")).alias("?start"))
    return marked.join(F.broadcast(starts), "?part").withColumn(name, ref("?start") + ref("?place") + 1).drop("?id", "?part", "?place", "?start")


def link(model: EntityModel, t: EntityType, nav: Navigation, tables: dict[str, DataFrame], pairs: DataFrame) -> dict[str, DataFrame]:
    """Tables after (host key..., member key...) pairs are linked: bridge rows, or the foreign key of the side that holds it.

    pairs' columns: host_<key>, member_<key>.
    """
    target = model.type(nav.target)
    if nav.bridge:
        rows = pairs.select(*[ref(f"host_{a}").alias(c) for a, c in nav.pairs], *[ref(f"member_{d}").alias(c) for c, d in nav.bridge_pairs]).distinct()
        bridge = tables[nav.bridge]
        new = rows.join(bridge.select(*rows.columns).distinct(), rows.columns, "left_anti")
        return {nav.bridge: insert(bridge, new)}
    if nav.foreign == "own":
        keys, values, table = model.key(t), {a: f"member_{b}" for a, b in nav.pairs}, t.table
        rows = pairs.select(*[ref(f"host_{k}").alias(k) for k in keys], *[ref(v).alias(a) for a, v in values.items() if a not in keys])
    else:
        keys, values, table = model.key(target), {b: f"host_{a}" for a, b in nav.pairs}, target.table
        rows = pairs.select(*[ref(f"member_{k}").alias(k) for k in keys], *[ref(v).alias(b) for b, v in values.items() if b not in keys])
    return {table: merge(tables[table], rows, keys, insert=False)}


def unlink(model: EntityModel, t: EntityType, nav: Navigation, tables: dict[str, DataFrame], pairs: DataFrame) -> dict[str, DataFrame]:
    """Tables after pairs are unlinked: bridge rows go, or the foreign key becomes null where it points at the pair's other side."""
    target = model.type(nav.target)
    if nav.bridge:
        names = [c for _, c in nav.pairs] + [c for c, _ in nav.bridge_pairs]
        rows = pairs.select(*[ref(f"host_{a}").alias(c) for a, c in nav.pairs], *[ref(f"member_{d}").alias(c) for c, d in nav.bridge_pairs])
        return {nav.bridge: delete(tables[nav.bridge], rows, names)}
    own = nav.foreign == "own"
    holder, table = (t, t.table) if own else (target, target.table)
    keys, side, far = model.key(holder), ("host_" if own else "member_"), ("member_" if own else "host_")
    fks = [(a, b) if own else (b, a) for a, b in nav.pairs]
    rows = pairs.select(*[ref(f"{side}{k}").alias(k) for k in keys], *[ref(f"{far}{b}").alias(f"?was.{a}") for a, b in fks])
    j = tables[table].join(rows.withColumn("?hit", F.lit(True)), keys, "left")
    gone = ref("?hit").isNotNull() & _all([ref(a).eqNullSafe(ref(f"?was.{a}")) for a, _ in fks])
    return {table: j.select(*[F.when(~F.coalesce(gone, F.lit(False)), ref(c)).alias(c) if c in {a for a, _ in fks} else ref(c) for c in tables[table].columns])}


def changes(before: DataFrame, after: DataFrame, keys: list[str], columns: list[str] | None = None) -> DataFrame:
    """Audit rows: keys, property, pre, post, op. Inserted rows (op 0) list their non-null properties, kept rows (op 1) those that
    differ null-safely; deleted rows aren't logged. Values are strings."""
    columns = [c for c in (columns or after.columns) if c not in keys]
    b = before.select(*[ref(k).alias(f"?b.{k}") for k in keys], *[ref(c).cast("string").alias(f"?b.{c}") for c in columns if c in before.columns], F.lit(True).alias("?b"))
    a = after.select(*[ref(k) for k in keys], *[ref(c).cast("string").alias(f"?a.{c}") for c in columns])
    j = a.join(b, [ref(k) == ref(f"?b.{k}") for k in keys], "left")
    each = [F.struct(F.lit(c).alias("property"), (ref(f"?b.{c}") if c in before.columns else F.lit(None).cast("string")).alias("pre"), ref(f"?a.{c}").alias("post")) for c in columns]
    rows = j.select(*[ref(k) for k in keys], F.when(ref("?b").isNull(), 0).otherwise(1).alias("op"), F.explode(F.array(*each)).alias("?x"))
    return rows.where(~F.col("`?x`.pre").eqNullSafe(F.col("`?x`.post"))).select(*[ref(k) for k in keys], F.col("`?x`.property").alias("property"), F.col("`?x`.pre").alias("pre"), F.col("`?x`.post").alias("post"), "op")


def link_changes(before: DataFrame, after: DataFrame, columns: list[str]) -> DataFrame:
    """Audit rows of a relation: its columns and op, 2 for added and 3 for removed."""
    b, a = before.select(*columns).distinct(), after.select(*columns).distinct()
    return a.join(b, columns, "left_anti").withColumn("op", F.lit(2)).unionByName(b.join(a, columns, "left_anti").withColumn("op", F.lit(3)))
