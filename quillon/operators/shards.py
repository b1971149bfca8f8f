"""Shards as partitions of a table: placement policies and the shardlet map."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.plans.columns import ref


class ShardError(ValueError):
    pass


Policy = Callable[["ShardMap", int], str]


def even_odd(m: ShardMap, shardlet: int) -> str:
    """Even ids on the first shard by name, odd ones on the second."""
    names = sorted(m.shards)
    if len(names) < 2:
        raise ShardError("even-odd placement needs two shards")
    return names[shardlet % 2]


def least_populated(m: ShardMap, shardlet: int) -> str:
    """The shard with the fewest shardlets; of equal ones the first by name."""
    if not m.shards:
        raise ShardError("no shards")
    return min(sorted(m.shards), key=lambda s: len(m.shards[s]))


def specified(name: str) -> Policy:
    def place(m: ShardMap, shardlet: int) -> str:
        if name not in m.shards:
            raise ShardError(f"no shard {name!r}")
        return name

    return place


@dataclass
class ShardMap:
    """Shard name -> shardlet ids."""

    shards: dict[str, set[int]] = field(default_factory=dict)

    def add_shard(self, name: str) -> None:
        if name in self.shards:
            raise ShardError(f"shard {name!r} is there")
        self.shards[name] = set()

    def shard_of(self, shardlet: int) -> str:
        for name, own in self.shards.items():
            if shardlet in own:
                return name
        raise ShardError(f"no shard holds {shardlet}")

    def add(self, shardlet: int, policy: Policy = least_populated) -> str:
        if any(shardlet in own for own in self.shards.values()):
            raise ShardError(f"shardlet {shardlet} is placed")
        name = policy(self, shardlet)
        self.shards[name].add(shardlet)
        return name

    def move(self, shardlet: int, to: str) -> None:
        if to not in self.shards:
            raise ShardError(f"no shard {to!r}")
        self.shards[self.shard_of(shardlet)].discard(shardlet)
        self.shards[to].add(shardlet)

    def remove(self, shardlet: int) -> None:
        self.shards[self.shard_of(shardlet)].discard(shardlet)

    def route(self, text: str | None, default: int = 0) -> list[int]:
        """`all`, a comma list, or nothing for the default shardlet."""
        if text is None:
            return [default]
        if text.strip().lower() == "all":
            return sorted(s for own in self.shards.values() for s in own)
        return [int(x) for x in text.split(",")]

    def labelled(self, df: DataFrame, column: str, to: str = "shard_name") -> DataFrame:
        """A column with the shard of each row; the map is small and becomes an expression."""
        pairs = [F.lit(x) for name, own in sorted(self.shards.items()) for s in sorted(own) for x in (s, name)]
        return df.withColumn(to, F.element_at(F.create_map(*pairs), ref(column).cast("int")) if pairs else F.lit(None).cast("string"))

    def query(self, df: DataFrame, column: str, shardlets: list[int], complete: bool = True) -> DataFrame:
        """Rows of some shardlets with their shard's name. complete: a shardlet without a shard is an error, else it is left out."""
        held = {s for own in self.shards.values() for s in own}
        lost = [s for s in shardlets if s not in held]
        if lost and complete:
            raise ShardError(f"no shard holds {lost}")
        return self.labelled(df.where(ref(column).isin(*[s for s in shardlets if s in held])), column)
