"""select: rows of an entity at their natural grain: filter, projection, sort, page, ranking, window measures."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.errors import InvalidQueryError
from quern.functions.text import headlines, lexical_rank
from quern.operators.relation import Reader, Relation
from quern.operators.relevance import Embed, cohort, split_topk, with_vectors
from quern.operators.relevance import citation as cite_cohort
from quern.operators.vector import cosine
from quern.plans.graph import resolve
from quern.plans.language import Filter, Leaf, check_rank, leaves, normalize, normalize_rank
from quern.plans.model import AGGREGATES, Entity, is_identifier

PAGE, PER_GROUP, MOST_PAGE = 25, 5, 500


@dataclass
class SelectResult:
    """``df`` is the page, lazy; the rest is computed when asked for."""

    df: DataFrame
    matching: DataFrame
    offset: int
    limit: int
    pk: str
    warnings: list[str]
    cite: Callable[[], dict[str, Any] | None]
    group: str | None = None

    def ids(self) -> list[Any]:
        return [r[0] for r in self.df.select(F.col(f"`{self.pk}`")).collect()]

    def total(self) -> int:
        """Rows that match, whatever the page; for a ranking by groups, the groups."""
        return self.matching.select("__group").where("__group is not null").distinct().count() if self.group else self.matching.count()

    def has_more(self) -> bool:
        n = self.df.count()
        return n >= self.limit if self.group else self.offset + n < self.total()

    def citation(self) -> dict[str, Any] | None:
        return self.cite()

    def plan(self) -> str:
        return self.df._jdf.queryExecution().toString()


def default_columns(entity: Entity) -> list[str]:
    """Key fields in their order; all visible native columns without any."""
    keyed = sorted((f for f in entity.fields if f.visible and f.key_order is not None), key=lambda f: f.key_order)
    return [f.name for f in keyed] or [f.name for f in entity.fields if f.visible and f.type != "vector"]


def select(
    reader: Reader, name: str, *, filter: Any = None, columns: Sequence[str] | None = None, sort: Sequence[Mapping[str, str]] = (), page: Mapping[str, int] | None = None, rank_by: Mapping[str, Any] | None = None,
    window: Sequence[Mapping[str, Any]] = (), citation: Mapping[str, Any] | None = None, embed: Embed | None = None,
) -> SelectResult:
    """``_snippets`` among the columns shows where text conditions on the entity's own columns match; ``citation`` with a true
    ``boundary`` asks for the best row that a cohort leaves out."""
    entity = reader.model.entity(name)
    if not entity.pk:
        raise InvalidQueryError(f"select: {name} has no key")
    page = dict(page or {})
    offset, limit = page.get("offset", 0), page.get("limit", PAGE)
    if not 0 < limit <= MOST_PAGE or offset < 0:
        raise InvalidQueryError(f"page: limit is from 1 to {MOST_PAGE}, offset from 0")
    warnings: list[str] = []
    tree = with_vectors(normalize(filter), embed)
    top, rest = split_topk(tree)
    relation = Relation(reader, name, whole_days=False)
    relation.apply(rest)
    cited = [x for x in leaves(tree) if x.op in ("sim_gte", "sim_topk")]
    cohorts = []
    for leaf in top:  # the siblings of a cohort of this entity apply before its cut
        target = resolve(reader.model, name, leaf.on)
        c = cohort(reader, name, leaf, per=leaf.value.get("per"), siblings=rest if not target.hops else None, whole_days=False)
        cohorts.append(c)
        relation.within(target.hops, c.keys())

    def cite() -> dict[str, Any] | None:
        if not cited:
            return None
        own = next((c for c in cohorts if c.leaf is cited[0]), None)
        return cite_cohort(reader, own or cohort(reader, name, cited[0], per=None, whole_days=False), boundary=bool((citation or {}).get("boundary")))

    outputs: dict[str, Column] = {entity.pk: relation.key()}
    if columns is not None:
        relation.expect(columns)
    for path in default_columns(entity) if columns is None else columns:
        if path in ("_rank", "_snippet", "_snippets"):
            continue
        target = relation.resolve(path)
        if not target.to_one:
            continue  # many values are no column; fetch expands them
        c = relation.column(target)
        if target.kind == "computed" and target.field.type == "datetime":
            c = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
        outputs[path] = c
    for w in window:
        outputs[_alias(w, outputs)] = _window(relation, w)

    group, order = None, []
    if rank_by is not None:
        if sort:
            warnings.append("sort: the ranking orders the rows; sort is ignored")
        rank = _ranking(entity, rank_by, embed)
        score, snippet = _score(relation, rank, warnings)
        outputs["_rank"] = score
        if snippet is not None:
            outputs["_snippet"] = snippet  # the text until the page is known
        if rank.get("partition_by"):
            group = rank["partition_by"]
            outputs["__group"] = relation.select_path(group)
            limit = page.get("limit", MOST_PAGE)
        else:
            limit = rank.get("limit") or limit
        order = [F.col("_rank").desc_nulls_last()]
    for n, s in enumerate(sort if rank_by is None else ()):
        target = relation.resolve(s.get("on") or s.get("field") or s.get("by") or "")
        if not target.to_one:
            raise InvalidQueryError(f"sort: {target.name} has many values")
        outputs[f"__sort{n}"] = relation.column(target)
        by = F.col(f"__sort{n}")
        order.append(by.desc_nulls_last() if str(s.get("dir", s.get("direction", "asc"))).lower() == "desc" else by.asc_nulls_last())

    found = text_conditions(entity, rest) if columns is not None and "_snippets" in columns else []
    for n, leaf in enumerate(found):
        outputs[f"__text{n}"] = relation.select_path(leaf.on)

    rows = relation.df.select(*(c.alias(n) for n, c in outputs.items()))
    if rank_by is not None and rank["method"] == "semantic":
        rows = rows.where("_rank is not null")
    if rank_by is not None and rank.get("min_score") is not None:
        rows = rows.where(F.col("_rank") >= float(rank["min_score"]))
    key = F.col(f"`{entity.pk}`")
    shown = [F.col(f"`{n}`") for n in outputs if not n.startswith("__")]
    if group:
        by = Window.partitionBy("__group").orderBy(F.col("_rank").desc_nulls_last(), key.asc())
        ranked = rows.where("__group is not null").withColumn("__n", F.row_number().over(by)).where(F.col("__n") <= (rank.get("limit") or PER_GROUP))
        out = ranked.orderBy(F.col("__group").asc_nulls_last(), "__n").limit(limit)
    else:
        out = rows.orderBy(*order, key.asc())
        out = out.offset(offset).limit(limit) if offset else out.limit(limit)
    if "_snippet" in outputs:
        shown[list(outputs).index("_snippet")] = headlines(F.col("_snippet"), rank["query"]).alias("_snippet")
    if found:
        shown.append(F.filter(F.array(*(snippet_around(F.col(f"__text{n}"), x) for n, x in enumerate(found))), lambda x: x.isNotNull()).alias("_snippets"))
    return SelectResult(out.select(*shown), rows if group else rows.select(key), offset, limit, entity.pk, warnings, cite, group)


def _alias(w: Mapping[str, Any], taken: Mapping[str, Any]) -> str:
    name = w.get("as") or ""
    if not is_identifier(name) or name in taken:
        raise InvalidQueryError(f"window: {name!r} is no free lower-case identifier")
    return name


def _window(relation: Relation, w: Mapping[str, Any]) -> Column:
    """agg(on) over (partition by ...): no order and no frame; an empty list is the whole result."""
    if w.get("agg") not in AGGREGATES:
        raise InvalidQueryError(f"window: unknown aggregate {w.get('agg')!r}")
    value = F.lit(1) if w.get("on", "*") == "*" else relation.select_path(w["on"])
    if w.get("on", "*") == "*" and w["agg"] != "count":
        raise InvalidQueryError("window: only count takes *")
    by = [relation.select_path(p) for p in w.get("partition_by", ())]
    agg = {"count": F.count, "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "count_distinct": F.count_distinct}[w["agg"]](value)
    if not by:  # a window over everything would bring all rows to one task
        return relation.df.select(agg).scalar()
    if w["agg"] == "count_distinct":
        return F.size(F.collect_set(value).over(Window.partitionBy(*by))).cast("long")
    return agg.over(Window.partitionBy(*by))


def text_conditions(entity: Entity, f: Filter) -> list[Leaf]:
    """Conditions for a part of a text, on the entity's own columns; those on ``text`` stand for each searchable one."""
    out = []
    for x in leaves(f):
        if x.op in ("contains", "startswith", "endswith") or x.on == "text" and x.op == "eq":
            names = [x.on] if entity.field(x.on) else entity.searchable() if x.on == "text" else []
            out += [Leaf(n, "contains" if x.op == "eq" else x.op, x.value) for n in names]
    return list(dict.fromkeys(x for x in out if isinstance(x.value, str) and x.value))


def snippet_around(text: Column, leaf: Leaf, reach: int = 60) -> Column:
    """``column, snippet, match, full_length``: where the condition matches, with ``reach`` characters on both sides.

    ``match`` holds offsets within the snippet, an ellipsis counted where something is left out; null if nothing matches.
    """
    n, size = len(leaf.value), F.char_length(text)
    low, part = F.lower(text), F.lit(leaf.value.lower())
    at = {"startswith": F.when(F.startswith(low, part), 1), "endswith": F.when(F.endswith(low, part), size - n + 1)}.get(leaf.op, F.nullif(F.instr(low, leaf.value.lower()), F.lit(0)))
    first, end = F.greatest(at - reach, F.lit(1)), F.least(at + n + reach - 1, size)
    before = F.when(first > 1, "…").otherwise("")
    snippet = F.concat(before, F.substring(text, first, end - first + 1), F.when(end < size, "…").otherwise(""))
    start = at - first + F.char_length(before)
    return F.when(at.isNotNull(), F.struct(F.lit(leaf.on).alias("column"), snippet.alias("snippet"), F.struct(start.alias("start"), (start + n).alias("end")).alias("match"), size.alias("full_length")))


def _ranking(entity: Entity, raw: Mapping[str, Any], embed: Embed | None) -> dict[str, Any]:
    """A ranking with its field, method and vector settled."""
    rank = normalize_rank(raw)
    if "on" not in rank:
        meant = [f.name for f in entity.fields if f.embedding or f.type == "vector"]
        texts = [f.name for f in entity.fields if f.embedding] or meant
        if len(texts) != 1:
            raise InvalidQueryError(f"rank_by: name the field; {entity.name} has {len(texts)} semantic ones")
        rank["on"] = texts[0]
    f = entity.field(rank["on"].split(".")[0])
    if "method" not in rank:
        rank["method"] = "semantic" if rank.get("vector") is not None or f is None or f.embedding or f.type == "vector" else "lexical"
    check_rank(rank)
    if rank["method"] == "semantic" and rank.get("vector") is None:
        if embed is None:
            raise InvalidQueryError("rank_by: this engine has no embed function")
        rank["vector"] = list(embed(rank["query"]))
    return rank


def _score(relation: Relation, rank: Mapping[str, Any], warnings: list[str]) -> tuple[Column, Column | None]:
    target = relation.resolve(rank["on"])
    if rank["method"] == "semantic":
        return cosine(relation.column(relation.embedding_of(target)), rank["vector"]), None
    if target.field.type not in ("string", "enum", "json"):
        raise InvalidQueryError(f"rank_by: {rank['on']} is no text")
    if rank.get("min_score") is not None:
        warnings.append("rank_by: lexical scores aren't calibrated; min_score depends on the query")
    text = relation.column(target)
    return lexical_rank(text, rank["query"]), text


def select_many(reader: Reader, requests: Sequence[Mapping[str, Any]], embed: Embed | None = None) -> list[SelectResult]:
    """Several selects, planned one by one; their results are lazy, so that a caller may run them side by side."""
    return [select(reader, r["entity"], **{k: v for k, v in r.items() if k != "entity"}, embed=embed) for r in requests]


