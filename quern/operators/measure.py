"""Grain-safe grouped measures: every source is aggregated on its own, then sources meet on the group keys."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.errors import InvalidQueryError, QueryError
from quern.operators.predicate import condition
from quern.operators.relation import Reader, Relation, logic
from quern.plans.graph import Target, group_grain, resolve
from quern.plans.language import Filter, Leaf, leaves, normalize
from quern.plans.model import AGGREGATES, NUMERIC, Atomic, Cumulative, Derived, Entity, Ratio, SemanticModel, expression_leaves, is_identifier, to_identifier

MOST_ROWS = 10_000


@dataclass(frozen=True)
class Leg:
    """One aggregate over one source."""

    source: str
    agg: str
    on: str | None
    expr: Any
    where: Filter
    additivity: str | None = None


@dataclass
class Plan:
    legs: list[Leg] = field(default_factory=list)
    outputs: dict[str, Any] = field(default_factory=dict)  # alias -> number of a leg, or a tree over such numbers
    composites: set[str] = field(default_factory=set)

    def leg(self, leg: Leg) -> int:
        if leg not in self.legs:
            self.legs.append(leg)
        return self.legs.index(leg)


def plan_measures(model: SemanticModel, root: str, measures: Sequence[Mapping[str, Any] | str]) -> Plan:
    """Legs and outputs of a request; references are expanded, legs that occur twice are computed once."""
    plan = Plan()
    if not measures:
        raise InvalidQueryError("measure: none asked for")
    for raw in measures:
        raw = {"ref": raw} if isinstance(raw, str) else dict(raw)
        alias, tree = _output(model, root, plan, raw)
        if not is_identifier(alias):
            raise InvalidQueryError(f"measure: {alias!r} is no lower-case identifier")
        if alias in plan.outputs:
            raise InvalidQueryError(f"measure: alias {alias} occurs twice")
        plan.outputs[alias] = tree
        if not isinstance(tree, int):
            plan.composites.add(alias)
    return plan


def _output(model: SemanticModel, root: str, plan: Plan, raw: dict[str, Any]) -> tuple[str, Any]:
    if "ref" in raw:
        found = model.measure(raw["ref"])
        return raw.get("as") or to_identifier(raw["ref"]), _expand(model, plan, found)
    if "ratio" in raw:
        parts = [_output(model, root, plan, _item(raw["ratio"][k]))[1] for k in ("numerator", "denominator")]
        return raw.get("as") or "ratio", ("ratio", *parts)
    if "derived" in raw:
        return raw.get("as") or "derived", _derived(raw["derived"], lambda x: _output(model, root, plan, {"ref": x})[1])
    agg, on = raw.get("agg"), raw.get("on")
    if agg not in AGGREGATES:
        raise InvalidQueryError(f"measure: unknown aggregate {agg!r}")
    source = raw.get("source")
    if source is None and on and on != "*" and "." in on and on.split(".")[0] in model.entities:
        source, on = on.split(".", 1)
    alias = raw.get("as") or to_identifier(f"{agg}_{on or 'all'}" if on != "*" else "count")
    return alias, plan.leg(Leg(source or root, agg, None if on == "*" else on, _freeze(raw.get("expr")), normalize(raw.get("where"))))


def _item(x: Any) -> dict[str, Any]:
    return {"ref": x} if isinstance(x, str) else dict(x)


def _freeze(x: Any) -> Any:
    return tuple(sorted((k, _freeze(v)) for k, v in x.items())) if isinstance(x, Mapping) else x


def _thaw(x: Any) -> Any:
    return {k: _thaw(v) for k, v in x} if isinstance(x, tuple) else x


def _expand(model: SemanticModel, plan: Plan, m: Any) -> Any:
    if isinstance(m, Atomic):
        return plan.leg(Leg(m.source, m.agg, m.on, _freeze(m.expr), normalize(m.where), m.additivity))
    if isinstance(m, Ratio):
        return ("ratio", _expand(model, plan, model.measure(m.numerator)), _expand(model, plan, model.measure(m.denominator)))
    if isinstance(m, Derived):
        return _derived(m.expr, lambda x: _expand(model, plan, model.measure(x)))
    if isinstance(m, Cumulative):
        raise InvalidQueryError(f"cumulative: {m.name} is a window over {m.measure}; ask for that grouped by time")
    raise QueryError(f"measure: {m!r}")


def _derived(expr: Any, ref: Callable[[str], Any]) -> Any:
    expression_leaves(expr, "ref")
    if "ref" in expr:
        return ref(expr["ref"])
    if "value" in expr:
        return ("value", expr["value"])
    return (expr["op"], _derived(expr["left"], ref), _derived(expr["right"], ref))


# --- lints


def lint(model: SemanticModel, plan: Plan, dimensions: Sequence[Target]) -> list[str]:
    """Refuses aggregates that a field's tags forbid; returns warnings about those the tags don't mention."""
    warnings = []
    timed = any(t.field.time for t in dimensions)
    for leg in plan.legs:
        if leg.on is None:
            continue
        target = resolve(model, leg.source, leg.on)
        f = target.field
        if f.role == "dimension" and leg.agg not in ("count", "count_distinct") and not (leg.agg in ("min", "max") and f.time):
            raise InvalidQueryError(f"MEASURE_ON_DIMENSION: {leg.agg} of the dimension {leg.source}.{leg.on}")
        additivity = leg.additivity if leg.additivity and leg.agg in ("sum", "count") else f.additivity
        if leg.agg == "sum" and additivity == "non":
            raise InvalidQueryError(f"SUM_NON_ADDITIVE: {leg.source}.{leg.on} doesn't add up")
        if leg.agg == "sum" and additivity == "semi" and not timed:
            raise InvalidQueryError(f"SEMI_OVER_TIME: the sum of {leg.source}.{leg.on} needs a time dimension")
        if f.role == "measure" and target.kind != "computed" and f.aggs and leg.agg not in (*f.aggs, "count", "count_distinct"):
            warnings.append(f"MEASURE_NO_AGG_TAG: {leg.source}.{leg.on} isn't tagged with {leg.agg}")
    return warnings


# --- compilation


def carried(model: SemanticModel, root: str, source: str, path: str, *, bare_dimension: bool = False) -> Target:
    """What a path from the root means from another source: the same entity's field, by to-one hops only."""
    if source == root:
        return resolve(model, root, path, bare_dimension=bare_dimension)
    wanted = resolve(model, root, path, bare_dimension=bare_dimension)
    name = wanted.name + (wanted.json_path or "$")[1:]
    if wanted.entity.name == source:
        return resolve(model, source, name)
    found = resolve(model, source, f"{wanted.entity.name}.{name}")
    if not found.to_one:
        raise InvalidQueryError(f"to-many: {path} doesn't conform on {source}")
    return found


def _own_condition(relation: Relation, entity: Entity, f: Filter) -> Column:
    """A measure's own ``where``: native columns of its source only."""

    def leaf(x: Filter) -> Column:
        if not isinstance(x, Leaf):
            return logic(x, leaf)
        target = resolve(relation.model, entity.name, x.on)
        if target.hops or target.kind not in ("native", "json"):
            raise InvalidQueryError(f"where: {x.on} is no native column of {entity.name}")
        return condition(relation.column(target), x, target.field.type, whole_days=True)

    return leaf(f)


def row_expression(relation: Relation, expr: Any) -> Column:
    """Arithmetic on a row: null leaves are 0, a zero divisor gives null."""
    if "value" in expr:
        return F.lit(float(expr["value"]))
    if "on" in expr:
        target = relation.resolve(expr["on"])
        if target.field.type not in NUMERIC or not target.to_one:
            raise InvalidQueryError(f"expression: {expr['on']} is no number by to-one relations")
        return F.coalesce(relation.column(target), F.lit(0))
    left, right = row_expression(relation, expr["left"]), row_expression(relation, expr["right"])
    return arithmetic(expr["op"], left, right)


def arithmetic(op: str, left: Column, right: Column) -> Column:
    if op == "/":
        return left / F.nullif(right, F.lit(0))
    return {"+": left + right, "-": left - right, "*": left * right}[op]


def _aggregate(relation: Relation, leg: Leg) -> Column:
    value = None
    if leg.expr is not None:
        value = row_expression(relation, _thaw(leg.expr))
    elif leg.on is not None:
        target = relation.resolve(leg.on)
        if leg.agg in ("sum", "avg") and target.field.type not in NUMERIC:
            raise InvalidQueryError(f"measure: {leg.agg} of {leg.on}, which is no number")
        value = relation.column(target)
    elif leg.agg != "count":
        raise InvalidQueryError(f"measure: {leg.agg} needs a field")
    held = _own_condition(relation, relation.entity, leg.where) if leaves(leg.where) else None
    value = F.lit(1) if value is None else value
    if held is not None:
        value = F.when(held, value)
    return {"count": F.count, "count_distinct": F.count_distinct, "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}[leg.agg](value)


@dataclass
class MeasureResult:
    """``df`` is lazy; counts, nulls and citation are computed when asked for."""

    df: DataFrame
    grouped: DataFrame
    keys: list[str]
    composites: set[str]
    notes: list[str]
    grain: str
    cite: Callable[[], dict[str, Any] | None] = lambda: None

    def group_count(self) -> int:
        """Groups after having, before the limit."""
        return self.grouped.count()

    def warnings(self) -> list[str]:
        out = list(self.notes)
        if self.composites:
            names = sorted(self.composites)
            nulls = self.df.agg(*(F.count(F.when(F.col(f"`{n}`").isNull(), 1)).alias(n) for n in names)).first()
            out += [f"{n}: {nulls[n]} group(s) have a null value (nothing to divide by)" for n in names if nulls[n]]
        return out

    def citation(self) -> dict[str, Any] | None:
        return self.cite()

    def plan(self) -> str:
        return self.df._jdf.queryExecution().toString()


def measure(
    reader: Reader, root: str, *, measures: Sequence[Any], group_by: Sequence[str] = (), filter: Any = None, having: Any = None, order_by: Sequence[Mapping[str, str]] = (), limit: int | None = None,
    cohorts: Callable[[Relation, str], Filter] | None = None,
) -> MeasureResult:
    """``cohorts`` applies the relevance conditions of the filter to a source and returns what is left of the filter."""
    model = reader.model
    model.entity(root)
    plan = plan_measures(model, root, measures)
    sources = list(dict.fromkeys(leg.source for leg in plan.legs))
    for s in sources:
        model.entity(s)
    tree = normalize(filter)
    dims = [resolve(model, root, g, bare_dimension=True) for g in group_by]
    for g, t in zip(group_by, dims, strict=True):
        if not t.to_one:
            raise InvalidQueryError(f"to-many: {g} can't group {root}")
        if t.field.role != "dimension" or t.field.type == "vector":
            raise InvalidQueryError(f"group_by: {g} is no dimension")
    if clash := set(group_by) & set(plan.outputs):
        raise InvalidQueryError(f"measure: alias {sorted(clash)} is a group key too")
    notes = lint(model, plan, dims)
    if limit is not None and not 0 < limit <= MOST_ROWS:
        raise InvalidQueryError(f"limit: from 1 to {MOST_ROWS}")

    parts = []
    for source in sources:
        relation = Relation(reader, source, whole_days=True)
        own = cohorts(relation, source) if cohorts else tree
        if source != root:
            own = _carry_filter(model, root, source, own)
        relation.apply(own)
        keys = [relation.column(carried(model, root, source, g, bare_dimension=True)).alias(g) for g in group_by]
        aggs = [_aggregate(relation, leg).alias(f"__leg{n}") for n, leg in enumerate(plan.legs) if leg.source == source]
        parts.append(relation.df.groupBy(*keys).agg(*aggs))
    merged = parts[0]
    if len(parts) > 1:  # null keys meet, and a key that the first source lacks is still one row
        union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
        merged = union.groupBy(*(F.col(f"`{g}`") for g in group_by)).agg(*(F.max(f"__leg{n}").alias(f"__leg{n}") for n in range(len(plan.legs))))

    outputs = [_composite(plan, t).alias(a) for a, t in plan.outputs.items()]
    grouped = merged.select(*(F.col(f"`{g}`") for g in group_by), *outputs)
    if having is not None:
        grouped = grouped.where(_having(grouped, plan, normalize(having)))
    out = grouped
    if order_by:
        out = out.orderBy(*order_columns(order_by, grouped.columns), *(F.col(f"`{g}`").asc_nulls_last() for g in group_by))
    if limit is not None:
        out = out.limit(limit)
    return MeasureResult(out, grouped, list(group_by), plan.composites, notes, group_grain(model, root, list(group_by)))


def _carry_filter(model: SemanticModel, root: str, source: str, f: Filter) -> Filter:
    """The filter in the other source's names; refused unless every leaf conforms there."""
    if isinstance(f, Leaf):
        target = carried(model, root, source, f.on)
        path = ".".join([*(r.name for r in target.hops), target.name]) + (target.json_path or "$")[1:]
        return Leaf(path, f.op, f.value)
    if hasattr(f, "item"):
        return type(f)(_carry_filter(model, root, source, f.item))
    return type(f)(tuple(_carry_filter(model, root, source, x) for x in f.items))


def _composite(plan: Plan, tree: Any) -> Column:
    if isinstance(tree, int):
        return F.col(f"__leg{tree}")
    kind, *rest = tree
    if kind == "value":
        return F.lit(float(rest[0]))
    if kind == "ratio":
        return _leg_or_zero(plan, rest[0]) / F.nullif(_leg_or_zero(plan, rest[1], always=True), F.lit(0))
    return arithmetic(kind, *(_leg_or_zero(plan, x) for x in rest))


def _leg_or_zero(plan: Plan, tree: Any, *, always: bool = False) -> Column:
    """Sums and counts over nothing are 0 inside a composite; averages and extremes stay null."""
    c = _composite(plan, tree).cast("double")
    return F.coalesce(c, F.lit(0.0)) if isinstance(tree, int) and (always or plan.legs[tree].agg in ("sum", "count", "count_distinct")) else c


def _having(df: DataFrame, plan: Plan, f: Filter) -> Column:
    kinds = dict(df.dtypes)

    def leaf(x: Filter) -> Column:
        if not isinstance(x, Leaf):
            return logic(x, leaf)
        if x.on in plan.composites or x.on not in kinds:
            raise InvalidQueryError(f"having: {x.on} is no plain group key or measure")
        kind = kinds[x.on]
        kind = "datetime" if kind.startswith(("timestamp", "date")) else "string" if kind == "string" else "boolean" if kind == "boolean" else "number"
        return condition(F.col(f"`{x.on}`"), x, kind, whole_days=True)

    return leaf(f)


def order_columns(order_by: Sequence[Mapping[str, str]], columns: Sequence[str]) -> list[Column]:
    """Nulls last both ways."""
    out = []
    for o in order_by:
        name = o.get("on") or o.get("by") or o.get("field")
        if name not in columns:
            raise InvalidQueryError(f"order_by: {name} is no output column")
        c = F.col(f"`{name}`")
        out.append(c.desc_nulls_last() if str(o.get("dir", o.get("direction", "asc"))).lower() == "desc" else c.asc_nulls_last())
    return out
