"""A source entity as a DataFrame that grows the joins its paths ask for, and no others."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from itertools import count
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.errors import InvalidQueryError, ScopeError
from quern.operators.predicate import condition
from quern.operators.vector import cosine
from quern.plans.graph import Target, resolve
from quern.plans.language import And, Filter, Leaf, Not, conjuncts, leaves, normalize
from quern.plans.model import Computed, Entity, Rel, SemanticModel


class TenantGlobal:
    """Says that an entity has no tenants: the only unscoped read under a real scope."""

    def __repr__(self) -> str:
        return "TENANT_GLOBAL"


TENANT_GLOBAL = TenantGlobal()
ScopeFor = Callable[[str], Any]


class Reader:
    """Scoped DataFrames of a model's entities."""

    def __init__(self, spark: SparkSession, model: SemanticModel, scope: ScopeFor | None):
        self.spark, self.model, self.scope = spark, model, scope

    def table(self, name: str) -> DataFrame:
        """The entity's rows within scope. An entity that the scope says nothing about is refused."""
        entity = self.model.entity(name)
        df = entity.load(self.spark)
        if self.scope is None:
            return df
        found = self.scope(name)
        if found is None:
            raise ScopeError(f"scope: none for {name}")
        if found is TENANT_GLOBAL:
            return df

        def own(f: Filter) -> Column:
            if isinstance(f, Leaf):
                field = entity.field(f.on)
                if field is None:
                    raise ScopeError(f"scope: {f.on} is no column of {name}")
                return condition(df[f.on], f, field.type, whole_days=True)
            return logic(f, own)

        return df.where(own(normalize(found)))


def logic(f: Filter, leaf: Callable[[Filter], Column]) -> Column:
    """And, or, not with SQL's three values."""
    if isinstance(f, Not):
        return ~leaf(f.item)
    out = None
    for item in f.items:
        c = leaf(item)
        out = c if out is None else (out & c if isinstance(f, And) else out | c)
    return F.lit(True) if out is None else out


class Relation:
    """Columns are named by the path that they came in by, so two relations to one table never meet."""

    def __init__(self, reader: Reader, entity: str, *, whole_days: bool):
        self.reader, self.model, self.whole_days = reader, reader.model, whole_days
        self.entity: Entity = self.model.entity(entity)
        self._numbers = count()
        self.paths: dict[tuple[str, ...], str] = {}
        self.extra: dict[tuple, str] = {}
        self.expected: set[str] = set()
        self.df = self._renamed(reader.table(entity), ())

    def _renamed(self, df: DataFrame, path: tuple[str, ...]) -> DataFrame:
        self.paths[path] = prefix = f"t{next(self._numbers)}_"
        return df.select([df[c].alias(prefix + c) for c in df.columns])

    def key(self) -> Column:
        if not self.entity.pk:
            raise InvalidQueryError(f"{self.entity.name} has no key")
        return F.col(self.paths[()] + self.entity.pk)

    def _join(self, hops: tuple[Rel, ...]) -> str:
        """Prefix of the entity at the end of to-one hops; a parent out of scope leaves nulls, not a lost child."""
        path: tuple[str, ...] = ()
        owner = self.entity
        for r in hops:
            prefix, path = self.paths[path], (*path, r.name)
            target = self.model.entity(r.target)
            if path not in self.paths:
                right = self._renamed(self.reader.table(r.target), path)
                mine, theirs = (r.fk, target.pk) if r.kind == "belongs_to" else (owner.pk, r.fk)
                self.df = self.df.join(right, F.col(prefix + mine) == F.col(self.paths[path] + theirs), "left")
            owner = target
        return self.paths[path]

    def column(self, target: Target) -> Column:
        if not target.to_one:
            raise InvalidQueryError(f"to-many: {target.name} can't be a column of {self.entity.name}")
        prefix = self._join(target.hops)
        if target.kind == "native":
            return F.col(prefix + target.name)
        if target.kind == "json":
            return F.get_json_object(F.col(prefix + target.name), target.json_path)
        return F.col(self._eav(target, prefix) if target.kind == "eav" else self._computed(target, prefix))

    def _eav(self, target: Target, prefix: str) -> str:
        key = ("eav", prefix, target.name)
        if key not in self.extra:
            eav, name = target.entity.eav, f"e{next(self._numbers)}_"
            definition, field = target.entity.virtual(target.name)
            rows = eav.values(self.reader.spark).where(F.col("field_definition_id") == definition)
            if eav.entity_type:
                rows = rows.where(F.col("entity_type") == eav.entity_type)
            if eav.shape == "json":
                rows = rows.where("valid_to is null")
            side = rows.groupBy(F.col("entity_id").alias(name + "id")).agg(only_one(eav_value(field.type, eav.shape), f"{target.entity.name}.{target.name}").alias(name + "value"))
            self.df = self.df.join(side, F.col(prefix + target.entity.pk) == F.col(name + "id"), "left")
            self.extra[key] = name + "value"
        return self.extra[key]

    def _computed(self, target: Target, prefix: str) -> str:
        key = ("computed", prefix, target.name)
        if key not in self.extra:
            metric = target.entity.metric(target.name)
            parts = [F.col(self._side(target.entity, prefix, metric, rel, field)) for rel, field in metric.over]
            value = parts[0] if len(parts) == 1 else (F.greatest if metric.agg == "max" else F.least)(*parts)
            name = f"m{next(self._numbers)}_value"
            self.df = self.df.withColumn(name, F.coalesce(value, F.lit(0)) if metric.agg == "count" else value)
            self.extra[key] = name
        return self.extra[key]

    def expect(self, names: Iterable[str]) -> None:
        """Says which fields of the entity will be asked for, so that computed ones over the same children share a pass."""
        self.expected.update(names)

    def _side(self, entity: Entity, prefix: str, metric: Computed, rel_name: str, field: str) -> str:
        """The column of a metric over children, from one grouped pass with all expected metrics over the same children."""
        key = ("side", prefix, metric.name, rel_name, field)
        if key not in self.extra:
            rel = entity.rel(rel_name)
            if rel is None or rel.kind != "has_many":
                raise InvalidQueryError(f"computed {metric.name}: {rel_name} is no to-many relation")
            child = Relation(self.reader, rel.target, whole_days=self.whole_days)
            wanted = [(metric, field)]
            if not prefix.strip("t0_"):  # of this entity itself
                others = [(c, f) for c in entity.computed if c.name in self.expected and c is not metric for r, f in c.over if r == rel_name]
                wanted += [x for x in others if child.is_own(*x)] if child.is_own(metric, field) else []
            if len(wanted) == 1:
                child.apply(normalize(metric.where))
            name = f"c{next(self._numbers)}_"
            aggs = []
            for n, (c, f) in enumerate(wanted):
                own = F.lit(1) if f == "*" else child.column(resolve(self.model, rel.target, f))
                if len(wanted) > 1 and leaves(normalize(c.where)):
                    own = F.when(child.compile(normalize(c.where)), own)
                aggs.append({"count": F.count, "sum": F.sum, "min": F.min, "max": F.max}[c.agg](own).alias(f"{name}{n}"))
                self.extra["side", prefix, c.name, rel_name, f] = f"{name}{n}"
            side = child.df.groupBy(F.col(child.paths[()] + rel.fk).alias(name + "id")).agg(*aggs)
            self.df = self.df.join(side, F.col(prefix + entity.pk) == F.col(name + "id"), "left")
        return self.extra[key]

    def is_own(self, metric: Computed, field: str) -> bool:
        """Whether a metric over this entity's rows needs their native columns alone."""
        names = [x.on for x in leaves(normalize(metric.where))] + ([] if field == "*" else [field])
        found = [None if n == "text" else self.resolve(n) for n in names]
        return all(t is not None and not t.hops and t.kind in ("native", "json") for t in found)

    def resolve(self, path: str, *, bare_dimension: bool = False) -> Target:
        return resolve(self.model, self.entity.name, path, bare_dimension=bare_dimension)

    def select_path(self, path: str) -> Column:
        return self.column(self.resolve(path))

    # --- filters

    def apply(self, f: Filter) -> None:
        """Keeps the rows that ``f`` holds for. Conditions on children become semi and anti joins where they stand alone."""
        later = []
        for item in conjuncts(f):
            negated, leaf = (True, item.item) if isinstance(item, Not) else (False, item)
            target = self._target(leaf) if isinstance(leaf, Leaf) and leaf.on != "text" else None
            if target is not None and not target.to_one:
                later.append((target, leaf, "left_anti" if negated else "left_semi"))
            else:
                held = self.compile(item)  # may join first
                self.df = self.df.where(held)
        for target, leaf, how in later:
            keys = self._matching_parents(target, leaf)
            self.df = self.df.join(keys, self.key() == F.col(keys.columns[0]), how)

    def _target(self, leaf: Leaf) -> Target:
        return self.resolve(leaf.on)

    def compile(self, f: Filter) -> Column:
        if not isinstance(f, Leaf):
            return logic(f, self.compile)
        if f.on == "text" and not self.entity.field("text"):
            names = self.entity.searchable()
            if not names:
                raise InvalidQueryError(f"filter: {self.entity.name} has no searchable column")
            out = None
            for n in names:
                c = condition(F.col(self.paths[()] + n), Leaf(n, "contains" if f.op == "eq" else f.op, f.value), "string", whole_days=False)
                out = c if out is None else out | c
            return out
        target = self._target(f)
        if not target.to_one:  # under or, or deeper: a flag from a left join on distinct keys
            keys = self._matching_parents(target, f)
            flag = f"x{next(self._numbers)}_"
            self.df = self.df.join(keys.withColumn(flag, F.lit(True)), self.key() == F.col(keys.columns[0]), "left")
            return F.coalesce(F.col(flag), F.lit(False))
        if f.op == "sim_gte":
            return cosine(self.column(self.embedding_of(target)), f.value["vector"]) >= F.lit(float(f.value["threshold"]))
        return condition(self.column(target), f, target.field.type, whole_days=self.whole_days)

    def embedding_of(self, target: Target) -> Target:
        """The vector column of a text field, by its path; a vector stands for itself."""
        if target.field.type == "vector":
            return target
        if not target.field.embedding:
            raise InvalidQueryError(f"relevant: {target.name} has no embedding")
        rest = resolve(self.model, target.entity.name, target.field.embedding)
        return Target((*target.hops, *rest.hops), rest.entity, rest.name, rest.field, rest.kind, rest.json_path)

    def _matching_parents(self, target: Target, leaf: Leaf) -> DataFrame:
        """Distinct keys of this entity's rows that have a child which the leaf holds for."""
        rel = target.hops[0]
        if not self.entity.pk or rel.kind != "has_many":
            raise InvalidQueryError(f"unsupported: {leaf.on}")
        child = Relation(self.reader, rel.target, whole_days=self.whole_days)
        tail = Target(target.hops[1:], target.entity, target.name, target.field, target.kind, target.json_path)
        if leaf.op == "sim_gte":
            held = cosine(child.column(child.embedding_of(tail)), leaf.value["vector"]) >= F.lit(float(leaf.value["threshold"]))
        else:
            held = condition(child.column(tail), leaf, tail.field.type, whole_days=self.whole_days)
        if tail.hops:  # the tail must exist
            held = held & F.col(child._join(tail.hops) + tail.entity.pk).isNotNull()
        name = f"k{next(self._numbers)}_"
        fk = F.col(child.paths[()] + rel.fk)
        return child.df.where(held & fk.isNotNull()).select(fk.alias(name)).distinct()

    def within(self, hops: tuple[Rel, ...], keys: DataFrame) -> None:
        """Keeps the rows whose entity at the end of the hops has its key in ``keys`` (one column of distinct keys)."""
        if not hops:
            self.df = self.df.join(keys, self.key() == F.col(keys.columns[0]), "left_semi")
        elif all(r.to_one for r in hops):
            end = self.model.entity(hops[-1].target)
            met = F.col(self._join(hops) + end.pk) == F.col(keys.columns[0])
            self.df = self.df.join(keys, met, "left_semi")
        else:
            child = Relation(self.reader, hops[0].target, whole_days=self.whole_days)
            child.within(hops[1:], keys)
            name = f"k{next(self._numbers)}_"
            parents = child.df.select(F.col(child.paths[()] + hops[0].fk).alias(name)).distinct()
            self.df = self.df.join(parents, self.key() == F.col(name), "left_semi")


def only_one(value: Column, name: str) -> Column:
    """The value of a group of one row; a second one would fan its entity out, so the query fails instead."""
    return F.when(F.count("*") > 1, F.raise_error(F.lit(f"eav: {name} has several values for one entity"))).otherwise(F.max(value))


def eav_value(kind: str, shape: str) -> Column:
    """The value column of a side table by the field's type."""
    if shape == "json":
        text = F.get_json_object("value", "$")
        return {"number": text.try_cast("double"), "integer": text.try_cast("long"), "boolean": text.try_cast("boolean"), "datetime": text.try_cast("timestamp_ntz"), "date": text.try_cast("timestamp_ntz")}.get(kind, text)
    return F.col({"number": "value_number", "integer": "value_number", "boolean": "value_boolean", "datetime": "value_date", "date": "value_date"}.get(kind, "value_text"))
