"""The semantic model: entities over DataFrames, their fields, relations and measures. Validated when it is built."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from quern.errors import InvalidQueryError, ModelError, UnknownEntityError

AGGREGATES = ("count", "count_distinct", "sum", "avg", "min", "max")
TYPES = ("string", "number", "integer", "boolean", "datetime", "date", "json", "uuid", "enum", "vector")
NUMERIC = ("number", "integer")
_IDENTIFIER = re.compile(r"[a-z_][a-z0-9_]*\Z")


def is_identifier(name: str) -> bool:
    return bool(_IDENTIFIER.match(name))


def to_identifier(name: str) -> str:
    """A lower-case identifier from any name."""
    slug = re.sub(r"[^a-z0-9]+", "_", re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name).lower()).strip("_")
    return slug if slug and not slug[0].isdigit() else f"_{slug}"


@dataclass(frozen=True)
class Field:
    """A column and what may be done with it. ``embedding`` names the vector column that holds this text's meaning."""

    name: str
    type: str = "string"
    role: str = "dimension"
    aggs: tuple[str, ...] = ()
    additivity: str = "additive"
    time: bool = False
    label: str | None = None
    description: str | None = None
    options: tuple[str, ...] | None = None
    visible: bool = True
    searchable: bool | None = None
    key_order: int | None = None
    group: str | None = None
    embedding: str | None = None

    def __post_init__(self) -> None:
        if self.type not in TYPES or self.role not in ("dimension", "measure") or self.additivity not in ("additive", "semi", "non"):
            raise ModelError(f"field {self.name}: bad type, role or additivity")
        if bad := set(self.aggs) - set(AGGREGATES):
            raise ModelError(f"field {self.name}: unknown aggregates {sorted(bad)}")


@dataclass(frozen=True)
class Rel:
    """An edge. belongs_to: ``fk`` is here and meets the target's key; has_one, has_many: ``fk`` is there and meets ours."""

    name: str
    kind: str
    target: str
    fk: str

    @property
    def to_one(self) -> bool:
        return self.kind in ("belongs_to", "has_one")


@dataclass(frozen=True)
class Eav:
    """Virtual columns in a side table: ``typed`` has one value column a type, ``json`` has JSON text and validity."""

    values: Callable[[SparkSession], DataFrame]
    fields: Mapping[str, tuple[str, Field]]  # name -> (definition id, field)
    shape: str = "typed"
    entity_type: str | None = None

    @staticmethod
    def from_definitions(definitions: DataFrame, values: Callable[[SparkSession], DataFrame], entity_type: str, *, owner: str | None = None, shape: str = "typed", visible_only: bool = True) -> Eav:
        """Reads the (small) definitions of an entity type anew: those of the owner, shown ones unless told otherwise."""
        rows = definitions.where(definitions.entity_type == entity_type)
        if owner is not None:
            rows = rows.where((definitions.organization_id == owner) | (definitions.user_id == owner))
        if visible_only:
            rows = rows.where(definitions.is_visible)
        found = {}
        for r in rows.select("field_definition_id", "key", "data_type", "label").collect():
            kind = eav_type(r["data_type"])
            role = "measure" if kind in NUMERIC else "dimension"
            found[r["key"]] = (r["field_definition_id"], Field(r["key"], kind, role, ("sum", "avg", "min", "max") if role == "measure" else (), label=r["label"]))
        return Eav(values, found, shape, entity_type)


def eav_type(data_type: str) -> str:
    """Field type of a definition's data type."""
    kind = data_type.lower()
    if kind in ("number", "money", "percentage", "decimal", "currency"):
        return "number"
    if kind in ("integer", "date", "datetime", "boolean"):
        return kind
    return "enum" if kind in ("select", "picklist") or kind.startswith("multi") else "string"


@dataclass(frozen=True)
class Computed:
    """A scalar over children: an aggregate of ``over`` = (relation, child field), or the greatest or least of several."""

    name: str
    agg: str
    over: tuple[tuple[str, str], ...]
    where: Any = None
    type: str = "number"

    def __post_init__(self) -> None:
        if self.agg not in ("count", "sum", "min", "max"):
            raise ModelError(f"computed {self.name}: unknown aggregate {self.agg}")
        if len(self.over) != 1 and self.agg not in ("min", "max") or not self.over:
            raise ModelError(f"computed {self.name}: {self.agg} takes one relation")


@dataclass(frozen=True)
class Entity:
    name: str
    load: Callable[[SparkSession], DataFrame]
    pk: str | None
    fields: tuple[Field, ...]
    rels: tuple[Rel, ...] = ()
    kind: str = "entity"
    eav: Eav | None = None
    computed: tuple[Computed, ...] = ()
    table: str | None = None

    def field(self, name: str) -> Field | None:
        return next((f for f in self.fields if f.name == name), None)

    def rel(self, name: str) -> Rel | None:
        return next((r for r in self.rels if r.name == name), None)

    def virtual(self, name: str) -> tuple[str, Field] | None:
        """An EAV field; a native column of the same name wins."""
        return self.eav.fields.get(name) if self.eav and not self.field(name) else None

    def metric(self, name: str) -> Computed | None:
        return next((c for c in self.computed if c.name == name), None)

    def searchable(self) -> list[str]:
        """Text columns that the ``text`` field searches: strings that are no ids, unless a field says otherwise."""
        idlike = lambda n: n in ("id", "external_id", self.pk) or n.endswith(("_id", "key"))
        return [f.name for f in self.fields if f.visible and (f.searchable if f.searchable is not None else f.type == "string" and not idlike(f.name))]


@dataclass(frozen=True)
class Atomic:
    """An aggregate of a field or of a row expression. ``where`` is a filter on the source's own columns."""

    name: str
    source: str
    agg: str
    on: str | None = None
    expr: Any = None
    where: Any = None
    additivity: str | None = None
    label: str | None = None


@dataclass(frozen=True)
class Ratio:
    name: str
    numerator: str
    denominator: str
    label: str | None = None


@dataclass(frozen=True)
class Derived:
    """Arithmetic over measures: {"op": "+", "left": ..., "right": ...} with {"ref": name} and {"value": number} leaves."""

    name: str
    expr: Any
    label: str | None = None


@dataclass(frozen=True)
class Cumulative:
    """Listed in the catalog; measure() refuses it, as it is a window over another measure."""

    name: str
    measure: str
    label: str | None = None


MeasureDef = Atomic | Ratio | Derived | Cumulative


@dataclass
class SemanticModel:
    entities: dict[str, Entity]
    measures: dict[str, MeasureDef] = field(default_factory=dict)

    @staticmethod
    def build(entities: list[Entity], measures: list[MeasureDef] = ()) -> SemanticModel:
        model = SemanticModel({e.name: e for e in entities}, {})
        for e in entities:
            for r in e.rels:
                if r.kind not in ("belongs_to", "has_one", "has_many"):
                    raise ModelError(f"{e.name}.{r.name}: unknown kind {r.kind}")
        catalog = auto_catalog(model)
        slugs = {to_identifier(n): n for n in catalog}
        for m in sorted(measures, key=lambda x: not isinstance(x, Atomic)):
            if (slug := to_identifier(m.name)) in slugs:
                raise ModelError(f"measure {m.name} collides with {slugs[slug]}")
            slugs[slug] = m.name
            _check_measure(model, catalog, m)
            catalog[m.name] = m
        model.measures = catalog
        return model

    def entity(self, name: str) -> Entity:
        if name not in self.entities:
            raise UnknownEntityError(f"unknown entity: {name}")
        return self.entities[name]

    def measure(self, name: str) -> MeasureDef:
        found = self.measures.get(name)
        if found is None:
            raise InvalidQueryError(f"measure: unknown {name}")
        return found


def auto_catalog(model: SemanticModel) -> dict[str, MeasureDef]:
    """``field.agg`` for every aggregate that a measure field is tagged with; a name that two entities give is left out."""
    found: dict[str, list[Atomic]] = {}
    for e in model.entities.values():
        for f in [*e.fields, *(f for _, f in (e.eav.fields.values() if e.eav else ()))]:
            for agg in f.aggs if f.role == "measure" else ():
                additivity = f.additivity if agg in ("sum", "count") else "non"
                found.setdefault(f"{f.name}.{agg}", []).append(Atomic(f"{f.name}.{agg}", e.name, agg, f.name, additivity=additivity))
    return {n: x[0] for n, x in found.items() if len(x) == 1}


def expression_leaves(expr: Any, leaf: str) -> list[Any]:
    """Leaves of an arithmetic tree; refuses what isn't one."""
    if isinstance(expr, Mapping):
        if set(expr) == {leaf}:
            return [expr[leaf]]
        if set(expr) == {"value"} and isinstance(expr["value"], (int, float)):
            return []
        if set(expr) == {"op", "left", "right"} and expr["op"] in ("+", "-", "*", "/"):
            return expression_leaves(expr["left"], leaf) + expression_leaves(expr["right"], leaf)
    raise InvalidQueryError(f"expression: not understood: {expr!r}")


def _check_measure(model: SemanticModel, catalog: dict[str, MeasureDef], m: MeasureDef) -> None:
    if isinstance(m, Atomic):
        if m.source not in model.entities:
            raise ModelError(f"measure {m.name}: unknown source {m.source}")
        if m.agg not in AGGREGATES:
            raise ModelError(f"measure {m.name}: unknown aggregate {m.agg}")
        if m.expr is not None and not expression_leaves(m.expr, "on"):
            raise ModelError(f"measure {m.name}: an expression needs a column")
        f = model.entities[m.source].field(m.on) if m.on else None
        order = ("additive", "semi", "non")
        if f and f.role == "measure" and m.agg == "sum" and m.additivity and order.index(m.additivity) < order.index(f.additivity):
            raise ModelError(f"measure {m.name}: additivity may be tightened, not loosened")
        return
    refs = [m.numerator, m.denominator] if isinstance(m, Ratio) else [m.measure] if isinstance(m, Cumulative) else expression_leaves(m.expr, "ref")
    if not refs:
        raise ModelError(f"measure {m.name}: no measure in it")
    for ref in refs:
        if not isinstance(catalog.get(ref), (Atomic, Derived) if isinstance(m, Derived) else Atomic):
            raise ModelError(f"measure {m.name}: {ref} can't be part of it")


def infer_relations(keys: Mapping[str, str], foreign: list[tuple[str, str, str]], unique: frozenset[tuple[str, str]] = frozenset()) -> tuple[dict[str, list[Rel]], list[str]]:
    """Relations both ways from primary keys and (table, column, target) foreign keys, and what could not be used."""
    rels: dict[str, list[Rel]] = {t: [] for t in keys}
    skipped = []
    for table, column, target in foreign:
        if table not in keys or target not in keys or "," in column:
            skipped.append(f"{table}.{column} -> {target}: unsupported")
            continue
        name = column.removesuffix("_id").removesuffix("key") or target
        rels[table].append(Rel(name if name not in {r.name for r in rels[table]} else f"{name}_{target}", "belongs_to", target, column))
        one = (table, column) in unique or keys[table] == column
        rels[target].append(Rel(table if one else f"{table}s", "has_one" if one else "has_many", table, column))
    return rels, skipped


def with_rels(entity: Entity, rels: list[Rel]) -> Entity:
    return replace(entity, rels=tuple(rels))
