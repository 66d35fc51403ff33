"""compare: the same measures under several filters, side by side, with differences from a baseline."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.errors import InvalidQueryError
from quern.operators.measure import MeasureResult, order_columns
from quern.plans.language import Filter, Or, both, leaves, normalize
from quern.plans.model import Atomic, SemanticModel, is_identifier

DERIVES = ("delta", "pct_change", "index")
MOST_ROWS = 10_000


@dataclass
class CompareResult:
    df: DataFrame | None
    variants: dict[str, MeasureResult]
    baseline: str
    derive: list[str]
    measures: list[str]
    aligned: DataFrame | None

    def warnings(self) -> list[str]:
        out = [f"[{label}] {w}" for label, v in self.variants.items() for w in v.warnings()]
        if self.aligned is None or not self.derive:
            return out
        counted = {f"{m}__{d}": [(m, label, d) for label in self.variants if label != self.baseline] for m in self.measures for d in self.derive if d != "delta"}
        if counted:
            blocked = lambda m, label, d: F.col(f"`{m}__{label}`").isNotNull() & F.col(f"`{m}__{label}__{d}`").isNull()
            row = self.aligned.agg(*(F.count(F.when(reduce(lambda a, b: a | b, (blocked(*x) for x in xs)), 1)).alias(c) for c, xs in counted.items())).first()
            out += [f"{c}: nothing to divide by in {row[c]} group(s), the baseline has zero or no value there" for c in counted if row[c]]
        if self.variants[self.baseline].df.isEmpty():
            out.append(f"baseline {self.baseline} is empty, so no difference from it is known")
        return out


def derived(kind: str, base: Column, value: Column) -> Column:
    base, value = base.cast("double"), value.cast("double")
    if kind == "delta":
        return value - base
    if kind == "pct_change":
        return (value - base) / F.nullif(base, F.lit(0.0))
    return value / F.nullif(base, F.lit(0.0)) * 100


def compare(
    run: Callable[..., MeasureResult], *, variants: Sequence[Mapping[str, Any]], measures: Sequence[Any], group_by: Sequence[str] = (), filter: Any = None, having: Any = None, baseline: str | None = None, derive: Sequence[str] | None = None,
    order_by: Sequence[Mapping[str, str]] = (), limit: int | None = None, per_variant_top: Mapping[str, Any] | None = None, delivery: str = "stitched",
    plain: Callable[[Any], Mapping[str, Any] | None] = lambda m: None,
) -> CompareResult:
    """``run`` is measure() of the entity; ``plain`` gives a measure as one aggregate of the entity, if it is one. A group that a variant lacks has nulls there; null keys meet."""
    labels = [str(v.get("label", "")) for v in variants]
    if len(labels) < 2:
        raise InvalidQueryError("compare: takes two variants at least")
    if len(set(labels)) < len(labels):
        raise InvalidQueryError("compare: labels must differ")
    for x in labels:
        if not is_identifier(x) or "__" in x:
            raise InvalidQueryError(f"compare: label {x!r} must be a lower-case identifier without __")
    baseline = baseline or labels[0]
    if baseline not in labels:
        raise InvalidQueryError(f"compare: unknown baseline {baseline}")
    derive = list(derive) if derive is not None else ["delta", "pct_change"]
    if bad := set(derive) - set(DERIVES):
        raise InvalidQueryError(f"compare: unknown derives {sorted(bad)}")
    if per_variant_top and (order_by or limit):
        raise InvalidQueryError("compare: per_variant_top stands instead of order_by and limit")
    for n in (limit, per_variant_top["n"] if per_variant_top else None):
        if n is not None and not 0 < n <= MOST_ROWS:
            raise InvalidQueryError(f"limit: from 1 to {MOST_ROWS}")
    base = normalize(filter)
    results = {}
    for label, v in zip(labels, variants, strict=True):
        own = normalize(v.get("filter"))
        if any(x.op == "relevant" for x in leaves(own)):
            raise InvalidQueryError("compare: a variant can't hold a relevance condition; the base filter can")
        extra = {"order_by": [{"on": per_variant_top["by"], "dir": "desc"}], "limit": per_variant_top["n"]} if per_variant_top else {}
        results[label] = run(measures=measures, group_by=group_by, filter=both(base, own), having=having, **extra)
    names = [c for c in results[labels[0]].grouped.columns if c not in group_by]
    if delivery == "separate":
        return CompareResult(None, results, baseline, derive, names, None)
    taken = set(group_by)
    planned = [f"{m}__{x}" for m in names for x in labels] + [f"{m}__{x}__{d}" for m in names for x in labels if x != baseline for d in derive]
    for c in planned:
        if c in taken:
            raise InvalidQueryError(f"compare: column collision on {c}")
        taken.add(c)
    keys = [F.col(f"`{g}`") for g in group_by]
    aligned = None
    wanted = [plain(m) for m in measures]
    if having is None and not per_variant_top and all(wanted):
        aligned = _in_one_scan(run, dict(zip(labels, (normalize(v.get("filter")) for v in variants), strict=True)), wanted, names, group_by, base)
    if aligned is None:
        parts = [r.df.select(*keys, *(F.col(f"`{m}`").alias(f"{m}__{x}") for m in names)) for x, r in results.items()]
        union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
        aligned = union.groupBy(*keys).agg(*(F.max(f"{m}__{x}").alias(f"{m}__{x}") for m in names for x in labels))
    columns = []
    for m in names:
        columns += [F.col(f"{m}__{x}") for x in labels]
        columns += [derived(d, F.col(f"{m}__{baseline}"), F.col(f"{m}__{x}")).alias(f"{m}__{x}__{d}") for d in derive for x in labels if x != baseline]
    aligned = aligned.select(*keys, *columns)
    out = aligned
    if order_by:
        out = out.orderBy(*order_columns(order_by, aligned.columns), *(F.col(f"`{g}`").asc_nulls_last() for g in group_by))
    if limit is not None:
        out = out.limit(limit)
    return CompareResult(out, results, baseline, derive, names, aligned)


def _in_one_scan(run: Callable[..., MeasureResult], filters: Mapping[str, Filter], measures: Sequence[Mapping[str, Any]], names: Sequence[str], group_by: Sequence[str], base: Filter) -> DataFrame | None:
    """All variants as filtered aggregates of one pass, or None where that can't say the same.

    It can if every variant filters native columns of the entity. A variant has a value in a group only if it has rows there,
    and a group is shown only if some variant has.
    """
    each = [{**m, "as": f"{n}__{x}", "where": both(normalize(m.get("where")), f)} for n, m in zip(names, measures, strict=True) for x, f in filters.items()]
    rows = [{"agg": "count", "on": "*", "where": f, "as": f"rows__{x}"} for x, f in filters.items()]
    try:
        found = run(measures=[*each, *rows], group_by=group_by, filter=both(base, Or(tuple(filters.values()))))
    except InvalidQueryError:  # a condition that a measure's where can't take
        return None
    held = {x: F.col(f"rows__{x}") > 0 for x in filters}
    kept = found.df.where(reduce(lambda a, b: a | b, held.values())) if group_by else found.df
    return kept.select(*(F.col(f"`{g}`") for g in group_by), *((F.when(held[x], F.col(f"{n}__{x}")) if group_by else F.col(f"{n}__{x}")).alias(f"{n}__{x}") for n in names for x in filters))


def plain_measure(model: SemanticModel, entity: str, raw: Any) -> dict[str, Any] | None:
    """A measure as one aggregate over the entity's own rows, or None if it is more than that."""
    raw = {"ref": raw} if isinstance(raw, str) else dict(raw)
    if "ref" in raw:
        found = model.measure(raw["ref"])
        if not isinstance(found, Atomic) or found.source != entity:
            return None
        return {"agg": found.agg, "on": found.on or "*", "expr": found.expr, "where": found.where}
    if "agg" not in raw or raw.get("source") not in (None, entity) or str(raw.get("on") or "").split(".")[0] in model.entities:
        return None
    return {k: v for k, v in raw.items() if k in ("agg", "on", "expr", "where")}
