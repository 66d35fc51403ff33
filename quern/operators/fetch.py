"""fetch: rows by id with their EAV fields and computed metrics, and related rows nested into them."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.errors import InvalidQueryError
from quern.operators.relation import Reader, Relation, eav_value
from quern.operators.relevance import Embed, split_topk, with_vectors
from quern.plans.language import normalize
from quern.plans.model import Entity

DEPTH, MOST_IDS = 3, 500


def fetch(reader: Reader, name: str, ids: Sequence[Any] | DataFrame, *, filter: Any = None, expand: Sequence[str] = (), embed: Embed | None = None) -> DataFrame:
    """``ids`` is a list of at most 500, or a DataFrame with one column of any size. Sorted by key."""
    entity = reader.model.entity(name)
    if not entity.pk:
        raise InvalidQueryError(f"fetch: {name} has no key")
    relation = Relation(reader, name, whole_days=False)
    if isinstance(ids, DataFrame):
        keys = ids.select(F.col(ids.columns[0]).alias("__id")).distinct()
        relation.df = relation.df.join(keys, relation.key() == F.col("__id"), "left_semi")
    else:
        if len(ids) > MOST_IDS:
            raise InvalidQueryError(f"fetch: at most {MOST_IDS} ids in a list")
        relation.df = relation.df.where(relation.key().isin(list(ids)) if ids else F.lit(False))
    top, rest = split_topk(with_vectors(normalize(filter), embed))
    if top:
        raise InvalidQueryError("fetch: top_k isn't taken here")
    relation.apply(rest)
    return _with_related(reader, entity, _hydrated(reader, relation), _tree(expand)).orderBy(F.col(entity.pk).asc_nulls_last())


def _tree(paths: Sequence[str]) -> dict[str, Any]:
    tree: dict[str, Any] = {}
    for path in paths:
        parts, at = path.split("."), tree
        if len(parts) > DEPTH:
            raise InvalidQueryError(f"expand: {path} is deeper than {DEPTH}")
        for p in parts:
            at = at.setdefault(p, {})
    return tree


def _hydrated(reader: Reader, relation: Relation) -> DataFrame:
    """Visible native columns, keys, computed metrics, and all EAV fields by one grouped pass over the side table."""
    entity, prefix = relation.entity, relation.paths[()]
    names = dict.fromkeys([entity.pk, *(f.name for f in entity.fields if f.visible), *(r.fk for r in entity.rels if r.kind == "belongs_to")])
    columns = [F.col(prefix + n).alias(n) for n in names if n]
    relation.expect(c.name for c in entity.computed)
    columns += [relation.select_path(c.name).alias(c.name) for c in entity.computed]
    df = relation.df.select(*columns)
    return _with_eav(reader, entity, df)


def _with_eav(reader: Reader, entity: Entity, df: DataFrame) -> DataFrame:
    eav = entity.eav
    virtual = {n: x for n, x in (eav.fields.items() if eav else ()) if entity.virtual(n)}
    if not virtual:
        return df
    rows = eav.values(reader.spark).where(F.col("field_definition_id").isin([d for d, _ in virtual.values()]))
    if eav.entity_type:
        rows = rows.where(F.col("entity_type") == eav.entity_type)
    if eav.shape == "json":
        rows = rows.where("valid_to is null")
    pick = []
    for n, (d, f) in virtual.items():
        own = F.col("field_definition_id") == d
        twice = F.count(F.when(own, 1)) > 1
        pick.append(F.when(twice, F.raise_error(F.lit(f"eav: {entity.name}.{n} has several values for one entity"))).otherwise(F.max(F.when(own, eav_value(f.type, eav.shape)))).alias(n))
    side = rows.groupBy(F.col("entity_id").alias("__entity")).agg(*pick)
    return df.join(side, df[entity.pk] == F.col("__entity"), "left").drop("__entity")


def _with_related(reader: Reader, entity: Entity, df: DataFrame, tree: dict[str, Any]) -> DataFrame:
    """To-one rows as structs, to-many rows as arrays of structs in key order; one join for each relation."""
    for name, below in tree.items():
        rel = entity.rel(name)
        if rel is None:
            raise InvalidQueryError(f"expand: {entity.name} has no relation {name}")
        target = reader.model.entity(rel.target)
        own = Relation(reader, rel.target, whole_days=False)
        if rel.kind != "belongs_to":  # the key to the parent stays with the child
            child = _with_related(reader, target, _hydrated_with(reader, own, rel.fk), below)
        else:
            child = _with_related(reader, target, _hydrated(reader, own), below)
        names = [c for c in child.columns if c != "__fk"]
        row = F.struct(*(F.col(f"`{c}`") for c in sorted(names, key=lambda c: c != target.pk)))
        if rel.kind == "belongs_to":
            side = child.select(F.col(target.pk).alias("__key"), row.alias(name))
            df = df.join(side, df[rel.fk] == F.col("__key"), "left").drop("__key")
        else:
            grouped = child.groupBy(F.col("__fk").alias("__key"))
            if rel.kind == "has_one":
                several = F.raise_error(F.lit(f"expand: {name} has more than one row for a key"))
                side = grouped.agg(F.first(row).alias(name), F.count("*").alias("__n")).select("__key", F.when(F.col("__n") > 1, several).otherwise(F.col(name)).alias(name))
                df = df.join(side, df[entity.pk] == F.col("__key"), "left").drop("__key")
            else:
                side = grouped.agg(F.sort_array(F.collect_list(row)).alias(name))
                df = df.join(side, df[entity.pk] == F.col("__key"), "left").drop("__key").withColumn(name, F.coalesce(name, F.array().cast(side.schema[name].dataType)))
    return df


def _hydrated_with(reader: Reader, relation: Relation, fk: str) -> DataFrame:
    """As ``_hydrated``, and the key to the parent as ``__fk``."""
    entity, prefix = relation.entity, relation.paths[()]
    names = dict.fromkeys([entity.pk, *(f.name for f in entity.fields if f.visible), *(r.fk for r in entity.rels if r.kind == "belongs_to")])
    columns = [F.col(prefix + n).alias(n) for n in names if n]
    relation.expect(c.name for c in entity.computed)
    columns += [relation.select_path(c.name).alias(c.name) for c in entity.computed]
    df = relation.df.select(*columns, F.col(prefix + fk).alias("__fk"))
    return _with_eav(reader, entity, df) if entity.pk else df


def project(df: DataFrame, model_entity: Entity, allowed: dict[str, Sequence[str]], entities: dict[str, Entity]) -> DataFrame:
    """Only the allowed columns of each entity, through nested relations too; an entity without a list shows nothing."""

    def rebuilt(column: Any, kind: Any, entity: Entity) -> Any:
        fields = [f for f in kind.fields if f.name in allowed.get(entity.name, ()) or entity.rel(f.name)]
        parts = [(rebuilt_rel(column[f.name], f.dataType, entity, f.name) if entity.rel(f.name) else column[f.name]).alias(f.name) for f in fields]
        return F.when(column.isNotNull(), F.struct(*parts)) if parts else F.when(column.isNotNull(), F.struct())

    def rebuilt_rel(column: Any, kind: Any, entity: Entity, name: str) -> Any:
        target = entities[entity.rel(name).target]
        if kind.typeName() == "array":
            return F.transform(column, lambda x: rebuilt(x, kind.elementType, target))
        return rebuilt(column, kind, target)

    out = []
    for f in df.schema.fields:
        if model_entity.rel(f.name) and f.dataType.typeName() in ("array", "struct"):
            out.append(rebuilt_rel(F.col(f"`{f.name}`"), f.dataType, model_entity, f.name).alias(f.name))
        elif f.name in allowed.get(model_entity.name, ()):
            out.append(F.col(f"`{f.name}`"))
    return df.select(*out)
