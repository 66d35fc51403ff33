"""describe and diagnose: what a model offers, and what is odd about its relations."""

from __future__ import annotations

from typing import Any

from quern.plans.graph import conformed_dimensions
from quern.plans.model import Atomic, Entity, SemanticModel

# Operators that a field type takes.
_ALWAYS = ["eq", "neq", "in", "nin", "is_null", "is_not_null"]
_ORDERED = ["gt", "gte", "lt", "lte", "between"]
_TEXT = ["contains", "startswith", "endswith", "matches"]


def operators_of(kind: str) -> list[str]:
    if kind == "vector":
        return ["is_null", "is_not_null"]
    if kind in ("number", "integer", "datetime", "date"):
        return _ALWAYS + _ORDERED
    return list(_ALWAYS) if kind in ("boolean", "uuid") else _ALWAYS + _TEXT


def describe_entity(entity: Entity) -> dict[str, Any]:
    """The typed catalog of an entity; hidden fields are left out."""
    rows = []
    sources = [(f, "native") for f in entity.fields] + [(f, "eav") for n, (_, f) in (entity.eav.fields.items() if entity.eav else ()) if entity.virtual(n)]
    for f, source in sources:
        if f.visible:
            rows.append({"name": f.name, "type": f.type, "role": f.role, "source": source, "label": f.label or f.name, "description": f.description, "aggs": list(f.aggs), "additivity": f.additivity if f.role == "measure" else None, "time": f.time, "options": list(f.options) if f.options else None, "key_order": f.key_order, "group": f.group, "semantic": bool(f.embedding) or f.type == "vector", "searchable": f.name in entity.searchable(), "operators": operators_of(f.type) + (["relevant"] if f.embedding or f.type == "vector" else [])})
    for c in entity.computed:
        rows.append({"name": c.name, "type": c.type, "role": "measure", "source": "computed", "label": c.name, "aggs": [], "operators": operators_of(c.type)})
    return {"entity": entity.name, "kind": entity.kind, "primary_key": entity.pk, "fields": rows, "relations": [{"name": r.name, "kind": r.kind, "target": r.target} for r in entity.rels]}


def describe(model: SemanticModel, name: str | None = None) -> dict[str, Any]:
    if name is not None:
        return describe_entity(model.entity(name))
    return {e.name: describe_entity(e) for e in model.entities.values() if e.kind == "entity"}


def describe_dimensions(model: SemanticModel, name: str) -> list[dict[str, Any]]:
    """``value_domain`` is declared where the options are listed, else open."""
    model.entity(name)
    return [{"name": n, "path": n, "column": f.name, "owner": owner, "via": "local" if owner == name else "to-one", "type": f.type, "time": f.time, "value_domain": "declared" if f.options else "open", "options": list(f.options) if f.options else None} for n, f, owner in conformed_dimensions(model, name)]


def describe_measures(model: SemanticModel, name: str) -> list[dict[str, Any]]:
    model.entity(name)
    own = [m for m in model.measures.values() if isinstance(m, Atomic) and m.source == name]
    return [{"name": m.name, "agg": m.agg, "on": m.on, "expr": m.expr, "additivity": m.additivity, "label": m.label} for m in sorted(own, key=lambda m: m.name)]


def describe_metrics(model: SemanticModel) -> list[dict[str, Any]]:
    return [{"name": m.name, "kind": type(m).__name__.lower(), "label": m.label} | {k: v for k, v in vars(m).items() if k not in ("name", "label")} for m in sorted((m for m in model.measures.values() if not isinstance(m, Atomic)), key=lambda m: m.name)]


def shaped(model: SemanticModel, *, find: str | None = None, show: str | dict[str, list[str]] | None = None, sample: int = 12) -> dict[str, Any]:
    """A short catalog for assistants: fields found by a part of their name, a working set, or a sample without ids."""
    out = {}
    for name, d in describe(model).items():
        fields = [f for f in d["fields"] if f["type"] not in ("uuid", "vector")]
        if find:
            fields = [f for f in fields if find.lower() in f["name"].lower() or find.lower() in (f["label"] or "").lower()]
        elif isinstance(show, dict):
            fields = [f for f in fields if f["name"] in show.get(name, ())]
        elif show != "all":
            fields = fields[:sample]
        if fields or not find:
            note = "some dimensions are open: ask for their values before filtering" if any(f["role"] == "dimension" and not f.get("options") for f in fields) else None
            out[name] = {"fields": fields, "key_fields": [f["name"] for f in d["fields"] if f.get("key_order") is not None], "note": note}
    return out


def diagnose(model: SemanticModel, unsupported: list[str] = ()) -> list[dict[str, str]]:
    """Findings on relations: level, code, where, what."""
    found = [{"level": "warn", "code": "UNSUPPORTED_RELATION", "where": x, "what": "can't be walked"} for x in unsupported]
    for e in model.entities.values():
        for r in e.rels:
            where = f"{e.name}.{r.name}"
            if r.target not in model.entities:
                found.append({"level": "warn", "code": "EDGE_TO_UNREGISTERED", "where": where, "what": f"{r.target} is no entity"})
                continue
            target = model.entities[r.target]
            holder = e if r.kind == "belongs_to" else target
            if not holder.field(r.fk) and holder.pk != r.fk:
                found.append({"level": "error", "code": "DANGLING_FK", "where": where, "what": f"{holder.name} has no column {r.fk}"})
            back = [x for x in target.rels if x.target == e.name and x.fk == r.fk and (x.kind == "belongs_to") != (r.kind == "belongs_to")]
            if not back:
                found.append({"level": "warn", "code": "MISSING_INVERSE", "where": where, "what": f"{target.name} doesn't lead back"})
        known = {r.fk for r in e.rels if r.kind == "belongs_to"} | {e.pk}
        for f in e.fields:
            if f.name not in known and f.name.endswith(("_id", "key")):
                found.append({"level": "info", "code": "HEURISTIC_FK", "where": f"{e.name}.{f.name}", "what": "named like a foreign key, but no relation uses it"})
    return found


def format_findings(findings: list[dict[str, str]]) -> str:
    if not findings:
        return "no findings"
    return "\n".join(f"{x['level'].upper():5} {x['code']:22} {x['where']}: {x['what']}" for x in sorted(findings, key=lambda x: ("error", "warn", "info").index(x["level"])))


