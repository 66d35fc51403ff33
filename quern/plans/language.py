"""One filter language for filter, where, having and scope: forgiving JSON in, a small tree out."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from quern.errors import InvalidQueryError


@dataclass(frozen=True)
class And:
    items: tuple


@dataclass(frozen=True)
class Or:
    items: tuple


@dataclass(frozen=True)
class Not:
    item: Any


@dataclass(frozen=True)
class Leaf:
    on: str
    op: str
    value: Any = None


Filter = And | Or | Not | Leaf
ALL = And(())

# Operators and the other spellings that mean them.
OPERATORS = ("eq", "neq", "gt", "gte", "lt", "lte", "in", "nin", "between", "contains", "startswith", "endswith", "matches", "is_null", "is_not_null", "relevant")
ALIASES = {
    "equals": "eq", "=": "eq", "==": "eq", "ne": "neq", "not_equals": "neq", "notEquals": "neq", "!=": "neq",
    ">": "gt", ">=": "gte", "<": "lt", "<=": "lte", "not_in": "nin", "notIn": "nin", "like": "contains", "ilike": "contains",
    "starts_with": "startswith", "startsWith": "startswith", "ends_with": "endswith", "endsWith": "endswith", "search": "matches",
    "isNull": "is_null", "isNotNull": "is_not_null", "not_null": "is_not_null",
}
RELEVANT_ALIASES = {"min_score": "threshold", "cutoff": "threshold", "topK": "top_k", "k": "top_k", "per_group": "per", "group_by": "per", "partition_by": "per"}
# The same of a ranking's keys and methods, in lower case.
RANK_ALIASES = {
    "field": "on", "column": "on", "q": "query", "text": "query", "search": "query", "embedding": "vector", "query_vector": "vector", "queryvector": "vector", "mode": "method",
    "top_k": "limit", "topk": "limit", "k": "limit", "minscore": "min_score", "threshold": "min_score",
    "partitionby": "partition_by", "group_by": "partition_by", "groupby": "partition_by", "per": "partition_by", "per_group": "partition_by", "pergroup": "partition_by",
}
SEMANTIC = ("semantic", "similarity", "similar", "cosine", "cosine_similarity", "cosinesimilarity", "vector", "embedding", "embeddings", "nearest", "knn")
LEXICAL = ("lexical", "keyword", "keywords", "fts", "full_text", "fulltext", "text", "ts", "tsvector", "bm25")
METHOD_ALIASES = dict.fromkeys(SEMANTIC, "semantic") | dict.fromkeys(LEXICAL, "lexical")
_LOGIC = ("and", "or", "not")


def operator(name: str) -> str | None:
    name = name.strip().strip("\"'`").strip()
    name = ALIASES.get(name, name)
    return name if name in OPERATORS else None


def _leaf(on: str, op: str, value: Any) -> Filter:
    if op in ("is_null", "is_not_null"):
        flip = value is False
        return Leaf(on, {"is_null": "is_not_null", "is_not_null": "is_null"}[op] if flip else op)
    if op == "relevant":
        return Leaf(on, op, relevance(value))
    if value is None and op in ("eq", "neq"):
        return Leaf(on, "is_null" if op == "eq" else "is_not_null")
    if op in ("in", "nin") and (isinstance(value, str) or not isinstance(value, Sequence)):
        value = [value]
    if op == "between" and (isinstance(value, str) or not isinstance(value, Sequence)):
        value = [value, value]
    if op == "between" and len(value) != 2:
        raise InvalidQueryError(f"filter: between takes two values on {on}")
    return Leaf(on, op, value)


def relevance(value: Any) -> dict[str, Any]:
    """A relevance condition: a query or vector, and exactly one of threshold in [0, 1] and top_k > 0."""
    if isinstance(value, str):
        value = {"query": value}
    if not isinstance(value, Mapping):
        raise InvalidQueryError("filter: relevant takes an object")
    out = {RELEVANT_ALIASES.get(k, k): v for k, v in value.items()}
    if ("threshold" in out) == ("top_k" in out):
        raise InvalidQueryError("filter: relevant takes exactly one of threshold and top_k")
    if not out.get("query") and out.get("vector") is None:
        raise InvalidQueryError("filter: relevant needs a query")
    if "threshold" in out and not (isinstance(out["threshold"], (int, float)) and 0 <= out["threshold"] <= 1):
        raise InvalidQueryError("filter: threshold is a number from 0 to 1")
    if "top_k" in out and not (isinstance(out["top_k"], int) and not isinstance(out["top_k"], bool) and out["top_k"] > 0):
        raise InvalidQueryError("filter: top_k is a positive integer")
    return out


def normalize(raw: Any) -> Filter:
    """The tree of a filter in any accepted form; a tree stays as it is. Nothing, or an empty object, matches all."""
    if raw is None:
        return ALL
    if isinstance(raw, (And, Or, Not, Leaf)):
        return raw
    if not isinstance(raw, Mapping):
        raise InvalidQueryError(f"filter: takes an object, not {type(raw).__name__}")
    if not raw:
        return ALL
    logic = [k for k in raw if k in _LOGIC]
    if logic:
        if len(raw) > 1:
            raise InvalidQueryError("filter: and, or, not stand alone in their object")
        kind, value = logic[0], raw[logic[0]]
        if kind == "not":
            return Not(normalize(value))
        if not isinstance(value, Sequence) or isinstance(value, str) or not value:
            raise InvalidQueryError(f"filter: {kind} takes a list with something in it")
        return (And if kind == "and" else Or)(tuple(normalize(x) for x in value))
    if "on" in raw and "op" in raw and set(raw) <= {"on", "op", "value"}:
        op = operator(str(raw["op"]))
        if op is None:
            raise InvalidQueryError(f"filter: unknown operator {raw['op']!r}")
        return _leaf(str(raw["on"]), op, raw.get("value"))
    items = [x for on, value in raw.items() for x in _natural(str(on), value)]
    return items[0] if len(items) == 1 else And(tuple(items))


def _natural(on: str, value: Any) -> list[Filter]:
    """field: scalar, list, null, {op: value, ...} or {op: name, value: x}."""
    if isinstance(value, Mapping):
        if value and set(value) <= {"op", "value"} and "op" in value:
            op = operator(str(value["op"]))
            if op is None:
                raise InvalidQueryError(f"filter: unknown operator {value['op']!r} on {on}")
            return [_leaf(on, op, value.get("value"))]
        if not value:
            raise InvalidQueryError(f"filter: no operator on {on}")
        out = []
        for name, x in value.items():
            op = operator(str(name))
            if op is None:
                raise InvalidQueryError(f"filter: unknown operator {name!r} on {on}")
            out.append(_leaf(on, op, x))
        return out
    if value is None:
        return [Leaf(on, "is_null")]
    if isinstance(value, Sequence) and not isinstance(value, str):
        return [Leaf(on, "in", list(value))]
    return [Leaf(on, "eq", value)]


def leaves(f: Filter) -> list[Leaf]:
    if isinstance(f, Leaf):
        return [f]
    if isinstance(f, Not):
        return leaves(f.item)
    return [x for item in f.items for x in leaves(item)]


def conjuncts(f: Filter) -> list[Filter]:
    """What must hold at the top level."""
    return [x for item in f.items for x in conjuncts(item)] if isinstance(f, And) else [f]


def both(*filters: Filter) -> Filter:
    items = tuple(x for f in filters for x in conjuncts(f))
    return items[0] if len(items) == 1 else And(items)


def _plain(name: Any) -> str:
    """A name without quotes and blanks around it, in lower case."""
    return str(name).strip().strip("\"'").strip().lower()


def normalize_rank(raw: Mapping[str, Any]) -> dict[str, Any]:
    """Known keys of a ranking under their own names, numbers from numeric strings; unknown keys are dropped."""
    out: dict[str, Any] = {}
    for key, value in raw.items():
        key = _plain(key)
        key = RANK_ALIASES.get(key, key)
        if key not in ("on", "query", "vector", "method", "limit", "min_score", "partition_by"):
            continue
        if key in ("limit", "min_score") and isinstance(value, str):
            try:
                value = float(value) if key == "min_score" else int(value)
            except ValueError:
                raise InvalidQueryError(f"rank_by: {key} is no number") from None
        if key == "method":
            if _plain(value) not in METHOD_ALIASES:
                raise InvalidQueryError(f"rank_by: unknown method {value!r}")
            value = METHOD_ALIASES[_plain(value)]
        out[key] = value
    return out


def check_rank(rank: Mapping[str, Any]) -> None:
    vector, query = rank.get("vector"), rank.get("query")
    if rank["method"] == "lexical":
        if vector is not None or not query:
            raise InvalidQueryError("rank_by: a lexical ranking takes a query")
    elif (vector is None) == (not query):
        raise InvalidQueryError("rank_by: a semantic ranking takes exactly one of query and vector")
    if vector is not None and (not len(vector) or not all(isinstance(x, (int, float)) and math.isfinite(x) for x in vector)):
        raise InvalidQueryError("rank_by: the vector must hold finite numbers")
    if rank.get("limit") is not None and not 0 < rank["limit"] <= 500:
        raise InvalidQueryError("rank_by: limit is from 1 to 500")
