"""Semantic cohorts: the rows that a relevance condition picks, and the citation that makes them auditable."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.errors import InvalidQueryError
from quern.functions.text import head
from quern.operators.relation import Reader, Relation
from quern.operators.vector import cosine
from quern.plans.graph import Target, resolve
from quern.plans.language import And, Filter, Leaf, Not, Or, both, conjuncts

Embed = Callable[[str], Sequence[float]]


def with_vectors(f: Filter, embed: Embed | None) -> Filter:
    """Relevance leaves with their vectors: sim_gte for a threshold, sim_topk for the best k, which stands under and alone."""

    def walk(x: Filter, top: bool) -> Filter:
        if isinstance(x, Leaf):
            if x.op != "relevant":
                return x
            value = dict(x.value)
            if value.get("vector") is None:
                if embed is None:
                    raise InvalidQueryError("relevant: this engine has no embed function")
                value["vector"] = list(embed(value["query"]))
            if "top_k" in value and not top:
                raise InvalidQueryError("relevant: top_k can't stand under or, not")
            return Leaf(x.on, "sim_topk" if "top_k" in value else "sim_gte", value)
        if isinstance(x, Not):
            return Not(walk(x.item, False))
        return And(tuple(walk(i, top) for i in x.items)) if isinstance(x, And) else Or(tuple(walk(i, False) for i in x.items))

    return walk(f, True)


def split_topk(f: Filter) -> tuple[list[Leaf], Filter]:
    items = conjuncts(f)
    top = [x for x in items if isinstance(x, Leaf) and x.op == "sim_topk"]
    return top, both(*(x for x in items if x not in top)) if len(top) < len(items) else And(())


@dataclass
class Cohort:
    """Rows of the semantic entity with their similarity, before the cut; ``per`` is a column of ``scored`` or None."""

    scored: DataFrame
    leaf: Leaf
    target: Target
    per: str | None

    def members(self) -> DataFrame:
        """``key, similarity`` of the rows in the cohort; ties go to the smaller key."""
        if self.leaf.op == "sim_gte":
            return self.scored.where(F.col("similarity") >= float(self.leaf.value["threshold"]))
        order = [F.col("similarity").desc_nulls_last(), F.col("key").asc()]
        k = self.leaf.value["top_k"]
        if self.per is None:
            return self.scored.orderBy(*order).limit(k)
        ranked = self.scored.where(F.col("per").isNotNull()).withColumn("rank", F.row_number().over(Window.partitionBy("per").orderBy(*order)))
        return ranked.where(F.col("rank") <= k).drop("rank")

    def keys(self) -> DataFrame:
        return self.members().select("key")


def cohort(reader: Reader, root: str, leaf: Leaf, *, per: str | None, siblings: Filter | None = None, whole_days: bool) -> Cohort:
    """Scores the rows of the leaf's entity within scope; ``siblings`` are filters of the same entity that apply before the cut.

    Rows without an embedding are in no cohort. Only key, similarity and partition go on, never the vectors.
    """
    target = resolve(reader.model, root, leaf.on)
    relation = Relation(reader, target.entity.name, whole_days=whole_days)
    if siblings is not None:
        relation.apply(siblings)
    own = resolve(reader.model, target.entity.name, target.name)
    similarity = cosine(relation.column(relation.embedding_of(own)), leaf.value["vector"])
    columns = [relation.key().alias("key"), similarity.alias("similarity")]
    if per is not None:
        if target.entity.name != root and "." not in per:
            per_target = resolve(reader.model, target.entity.name, per, bare_dimension=True)
        else:
            wanted = resolve(reader.model, root, per, bare_dimension=True)
            same = wanted.entity.name == target.entity.name
            per_target = resolve(reader.model, target.entity.name, wanted.name if same else f"{wanted.entity.name}.{wanted.name}")
        columns.append(relation.column(per_target).alias("per"))
    return Cohort(relation.df.select(*columns).where("similarity is not null"), leaf, target, per)


def citation(reader: Reader, c: Cohort, *, boundary: bool = False, exemplars: int = 4) -> dict[str, Any]:
    """What the cohort is, how many it holds, its best rows, the weakest one, and on request the best that is left out.

    Keys and similarities are computed once and kept while the citation is put together; they never hold vectors.
    """
    c = replace(c, scored=c.scored.persist())
    try:
        return _cited(reader, c, boundary, exemplars)
    finally:
        c.scored.unpersist()


def _cited(reader: Reader, c: Cohort, boundary: bool, exemplars: int) -> dict[str, Any]:
    members = c.members()
    best = [F.col("similarity").desc(), F.col("key").asc()]
    stats = members.agg(F.count("*").alias("n"), F.min("similarity").alias("low")).first()
    value = c.leaf.value
    mode = "threshold" if c.leaf.op == "sim_gte" else "top_k"
    out = {"on": c.leaf.on, "query": value.get("query"), "mode": mode, "cutoff": value["threshold"] if mode == "threshold" else stats["low"], "match_count": stats["n"]}
    if c.per is not None:
        out["per"] = c.per
    text = _texts(reader, c)

    def shown(rows: DataFrame) -> list[dict[str, Any]]:
        found = rows.join(text, "key", "left").orderBy(*best)
        return [{"id": r["key"], "similarity": r["similarity"], "snippet": r["snippet"], "full_length": r["full_length"]} for r in found.collect()]

    out["exemplars"] = shown(members.orderBy(*best).limit(exemplars))
    lowest = shown(members.orderBy(F.col("similarity").asc(), F.col("key").desc()).limit(1))
    out["boundary"] = {"lowest_included": lowest[0] if lowest else None}
    if boundary:
        rest = shown(c.scored.join(members.select("key"), "key", "left_anti").orderBy(*best).limit(1))
        out["boundary"]["highest_excluded"] = rest[0] if rest else None
    return out


def _texts(reader: Reader, c: Cohort) -> DataFrame:
    relation = Relation(reader, c.target.entity.name, whole_days=False)
    column: Column = F.lit(None).cast("string") if c.target.field.type == "vector" else relation.column(resolve(reader.model, c.target.entity.name, c.target.name))
    return relation.df.select(relation.key().alias("key"), head(column).alias("snippet"), F.char_length(column).alias("full_length"))
