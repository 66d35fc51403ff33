"""Walks over the relation graph: to-one paths, what a dotted name means from a source, grains."""

from __future__ import annotations

from dataclasses import dataclass

from quern.errors import InvalidQueryError
from quern.plans.model import Entity, Field, Rel, SemanticModel

MAX_DEPTH = 6


@dataclass(frozen=True)
class Target:
    """Where a name leads: relations from the source, the entity at their end, and what is named there."""

    hops: tuple[Rel, ...]
    entity: Entity
    name: str
    field: Field
    kind: str  # native, eav, computed or json
    json_path: str | None = None

    @property
    def to_one(self) -> bool:
        return all(r.to_one for r in self.hops)


def to_one_paths(model: SemanticModel, start: str, end: str, depth: int = MAX_DEPTH) -> list[tuple[Rel, ...]]:
    """Every simple path of belongs_to and has_one edges."""
    found: list[tuple[Rel, ...]] = []

    def walk(at: str, path: tuple[Rel, ...], seen: frozenset[str]) -> None:
        if at == end and path:
            found.append(path)
            return
        if len(path) < depth:
            for r in model.entity(at).rels:
                if r.to_one and r.target in model.entities and r.target not in seen:
                    walk(r.target, (*path, r), seen | {r.target})

    walk(start, (), frozenset([start]))
    return found


def _own(entity: Entity, hops: tuple[Rel, ...], parts: list[str]) -> Target | None:
    """A field of the entity itself: native, then computed, then EAV; a JSON column takes a path."""
    name = parts[0]
    if (f := entity.field(name)) and (len(parts) == 1 or f.type == "json"):
        return Target(hops, entity, name, f, "json" if len(parts) > 1 else "native", "$." + ".".join(parts[1:]) if len(parts) > 1 else None)
    if len(parts) > 1:
        return None
    if c := entity.metric(name):
        return Target(hops, entity, name, Field(name, c.type, "measure"), "computed")
    if v := entity.virtual(name):
        return Target(hops, entity, name, v[1], "eav")
    return None


def resolve(model: SemanticModel, source: str, path: str, *, bare_dimension: bool = False) -> Target:
    """What ``path`` names from ``source``: relation names step by step, or an entity that one to-one path reaches.

    ``bare_dimension``: an undotted name may be a dimension of exactly one entity that to-one paths reach.
    """
    parts = path.split(".")
    if not all(parts):
        raise InvalidQueryError(f"field: not a path: {path!r}")
    entity, hops = model.entity(source), ()
    while True:
        if found := _own(entity, hops, parts):
            return found
        rel = entity.rel(parts[0]) if len(parts) > 1 else None
        if rel is None:
            break
        if hops and not all(r.to_one for r in hops) and not rel.to_one:
            raise InvalidQueryError(f"unsupported: {path!r} crosses two to-many relations")
        if hops and not rel.to_one:
            raise InvalidQueryError(f"unsupported: {path!r} goes to many after other relations")
        hops = (*hops, rel)
        entity, parts = model.entity(rel.target), parts[1:]
    if not hops and len(parts) > 1 and parts[0] in model.entities and parts[0] != source:
        target = model.entity(parts[0])
        paths = to_one_paths(model, source, target.name)
        if len(paths) > 1:
            raise InvalidQueryError(f"ambiguous: {source} reaches {target.name} by {len(paths)} paths; name the relations")
        if paths and (found := _own(target, paths[0], parts[1:])):
            return found
        many = [r for r in entity.rels if r.kind == "has_many" and r.target == target.name]
        if not paths and len(many) == 1 and (found := _own(target, (many[0],), parts[1:])):
            return found
        if not paths and not many:
            reach = any(r.kind == "has_many" for r in entity.rels)
            raise InvalidQueryError(f"{'to-many' if reach else 'unreachable'}: {source} has no to-one path to {target.name}")
    if bare_dimension and not hops and len(parts) == 1:
        owners = [(e, paths) for e in model.entities.values() if e.name != source and (own := _own(e, (), parts)) and own.field.role == "dimension" and (paths := to_one_paths(model, source, e.name))]
        if len(owners) > 1 or owners and len(owners[0][1]) > 1:
            raise InvalidQueryError(f"ambiguous: several entities or paths give {path!r}")
        if owners and (found := _own(owners[0][0], owners[0][1][0], parts)):
            return found
    raise InvalidQueryError(f"unknown field: {path} on {source}")


def conformed_dimensions(model: SemanticModel, source: str) -> list[tuple[str, Field, str]]:
    """(path, field, owner): own dimensions, and those of every entity that exactly one to-one path reaches, dotted.

    EAV fields are dimensions like native ones.
    """

    def own(entity: Entity) -> list[Field]:
        virtual = [entity.virtual(n)[1] for n in (entity.eav.fields if entity.eav else ()) if entity.virtual(n)]
        return [f for f in (*entity.fields, *virtual) if f.role == "dimension" and f.visible and f.type != "vector"]

    found = [(f.name, f, source) for f in own(model.entity(source))]
    for other in model.entities.values():
        if other.name != source and len(to_one_paths(model, source, other.name)) == 1:
            found += [(f"{other.name}.{f.name}", f, other.name) for f in own(other)]
    return found


def grain_rank(model: SemanticModel, name: str, seen: frozenset[str] = frozenset()) -> int:
    """Longest chain of belongs_to edges; edges between rows that share a key add nothing."""
    ranks = [0]
    entity = model.entity(name)
    for r in entity.rels:
        if r.kind == "belongs_to" and r.target in model.entities and r.target not in seen | {name}:
            ranks.append((r.fk != entity.pk) + grain_rank(model, r.target, seen | {name}))
    return max(ranks)


def group_grain(model: SemanticModel, source: str, dimensions: list[str]) -> str:
    """The entity of the finest dimension, or the source itself without any."""
    owners = [resolve(model, source, d, bare_dimension=True).entity.name for d in dimensions]
    return max(owners, key=lambda n: grain_rank(model, n), default=source)
