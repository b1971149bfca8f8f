"""Entity model: types with keys, properties, navigations, inheritance and enums, and the sets that expose them."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import types as T


class ModelError(ValueError):
    """A name that the model doesn't have, or a definition that contradicts itself."""


@dataclass(frozen=True)
class Property:
    """A column. column: its name in the table; flags as write operators need them."""

    name: str
    type: T.DataType
    column: str = ""
    key: bool = False
    required: bool = False
    ignored: bool = False
    max_length: int | None = None
    generated: str | None = None  # "identity" or "computed"
    concurrency: bool = False
    inserted_time: bool = False
    updated_time: bool = False
    changed_by: bool = False
    enum: str | None = None
    default: object = None
    computed: str | None = None  # SQL of a persisted computed column

    def __post_init__(self):
        if not self.column:
            object.__setattr__(self, "column", self.name)


@dataclass(frozen=True)
class Navigation:
    """An equi-join edge: (own property, target property) pairs, or two pair lists through a bridge table."""

    name: str
    target: str
    many: bool
    pairs: tuple[tuple[str, str], ...]
    bridge: str | None = None
    bridge_pairs: tuple[tuple[str, str], ...] = ()  # (bridge column, target property); pairs are (own property, bridge column)
    foreign: str = ""  # "own" if this side holds the foreign key, else "target"


@dataclass
class EntityType:
    name: str
    table: str | None = None
    properties: dict[str, Property] = field(default_factory=dict)
    navigations: dict[str, Navigation] = field(default_factory=dict)
    base: str | None = None
    abstract: bool = False
    trusted: bool = True  # foreign keys hold, so joins that only fetch a key can go
    partition_by: tuple[str, ...] = ()


@dataclass(frozen=True)
class EnumType:
    name: str
    members: dict[str, int]
    flags: bool = False

    def value(self, text: str) -> int:
        out = 0
        for part in (p.strip() for p in text.split(",")):
            if part.lstrip("-").isdigit():
                out |= int(part)
            elif part in self.members:
                out |= self.members[part]
            else:
                raise ModelError(f"{self.name} has no member {part!r}")
        return out


class EntityModel:
    def __init__(self):
        self.types: dict[str, EntityType] = {}
        self.enums: dict[str, EnumType] = {}
        self.sets: dict[str, str] = {}
        self.bridges: dict[str, tuple[str, ...]] = {}

    # -- building ---------------------------------------------------------------------------------------------------
    def entity(self, name: str, table: str | None = None, schema: T.StructType | None = None, key: tuple[str, ...] = (), set_name: str | None = None, base: str | None = None, abstract: bool = False, **flags: dict) -> EntityType:
        """flags: by property name, keyword values of Property that differ from the schema's defaults."""
        props = {f.name: Property(f.name, f.dataType, key=f.name in key, required=not f.nullable) for f in (schema or T.StructType()).fields}
        for prop, values in flags.items():
            props[prop] = replace(props.get(prop) or Property(prop, values.pop("type")), **values)
        self.types[name] = out = EntityType(name, table, props, {}, base, abstract)
        if set_name:
            self.sets[set_name] = name
        return out

    def enum(self, name: str, members: dict[str, int], flags: bool = False) -> EnumType:
        self.enums[name] = out = EnumType(name, members, flags)
        return out

    def one(self, owner: str, name: str, target: str, pairs: list[tuple[str, str]], inverse: str | None = None, inverse_many: bool = True) -> None:
        """owner holds the foreign key: many owners to one target; inverse names the way back."""
        self.types[owner].navigations[name] = Navigation(name, target, False, tuple(pairs), foreign="own")
        if inverse:
            self.types[target].navigations[inverse] = Navigation(inverse, owner, inverse_many, tuple((b, a) for a, b in pairs), foreign="target")

    def many_to_many(self, left: str, name: str, right: str, bridge: str, left_pair: tuple[str, str], right_pair: tuple[str, str], inverse: str | None = None) -> None:
        """left_pair: (left property, bridge column); right_pair: (bridge column, right property). Single-column keys only."""
        self.types[left].navigations[name] = Navigation(name, right, True, (left_pair,), bridge, (right_pair,))
        self.bridges[bridge] = (left_pair[1], right_pair[0])
        if inverse:
            self.types[right].navigations[inverse] = Navigation(inverse, left, True, ((right_pair[1], right_pair[0]),), bridge, ((left_pair[1], left_pair[0]),))

    # -- looking up -------------------------------------------------------------------------------------------------
    def type(self, name: str) -> EntityType:
        for n in (name, name.rpartition(".")[2]):
            if n in self.types:
                return self.types[n]
        raise ModelError(f"no entity type {name!r}")

    def set_type(self, name: str) -> EntityType:
        if name in self.sets:
            return self.type(self.sets[name])
        raise ModelError(f"no entity set {name!r}")

    def lineage(self, t: EntityType) -> list[EntityType]:
        """The type and its bases, root first."""
        out = [t]
        while out[0].base:
            out.insert(0, self.type(out[0].base))
        return out

    def subtypes(self, t: EntityType) -> list[EntityType]:
        """Concrete types that are t or derive from it, by name."""
        return sorted((x for x in self.types.values() if not x.abstract and t in self.lineage(x)), key=lambda x: x.name)

    def is_polymorphic(self, t: EntityType) -> bool:
        return t.abstract or len(self.subtypes(t)) > 1

    def properties(self, t: EntityType) -> dict[str, Property]:
        return {k: p for x in self.lineage(t) for k, p in x.properties.items() if not p.ignored}

    def navigations(self, t: EntityType) -> dict[str, Navigation]:
        return {k: n for x in self.lineage(t) for k, n in x.navigations.items()}

    def key(self, t: EntityType) -> list[str]:
        return [k for k, p in self.properties(t).items() if p.key]

    def is_a(self, name: str, target: str) -> bool:
        return self.type(target) in self.lineage(self.type(name))
