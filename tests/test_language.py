import pytest

from quern.errors import InvalidQueryError
from quern.plans.language import ALL, And, Leaf, Not, Or, both, check_rank, leaves, normalize, normalize_rank


@pytest.mark.parametrize(
    "raw, want",
    [
        (None, ALL),
        ({}, ALL),
        ({"a": 1}, Leaf("a", "eq", 1)),
        ({"a": None}, Leaf("a", "is_null")),
        ({"a": [1, 2]}, Leaf("a", "in", [1, 2])),
        ({"a": {"gt": 1, "lte": 3}}, And((Leaf("a", "gt", 1), Leaf("a", "lte", 3)))),
        ({"a": 1, "b": 2}, And((Leaf("a", "eq", 1), Leaf("b", "eq", 2)))),
        ({"a": {"op": "not_equals", "value": 1}}, Leaf("a", "neq", 1)),
        ({"on": "a.b", "op": "in", "value": 1}, Leaf("a.b", "in", [1])),
        ({"a": {' "startsWith" ': "x"}}, Leaf("a", "startswith", "x")),
        ({"a": {"like": "x"}}, Leaf("a", "contains", "x")),
        ({"a": {"search": "x"}}, Leaf("a", "matches", "x")),
        ({"a": {"is_null": False}}, Leaf("a", "is_not_null")),
        ({"a": {"isNotNull": True}}, Leaf("a", "is_not_null")),
        ({"a": {"between": 3}}, Leaf("a", "between", [3, 3])),
        ({"or": [{"a": 1}, {"not": {"b": 2}}]}, Or((Leaf("a", "eq", 1), Not(Leaf("b", "eq", 2))))),
        ({"a": {"relevant": {"query": "q", "min_score": 0.5}}}, Leaf("a", "relevant", {"query": "q", "threshold": 0.5})),
        ({"a": {"relevant": {"query": "q", "k": 5, "per_group": "g"}}}, Leaf("a", "relevant", {"query": "q", "top_k": 5, "per": "g"})),
    ],
)
def test_forms(raw, want):
    got = normalize(raw)
    assert got == want
    assert normalize(got) == got


@pytest.mark.parametrize(
    "raw",
    [
        3, [], "x", {"and": []}, {"or": "x"}, {"and": [{"a": 1}], "b": 2}, {"and": [{"a": 1}], "or": [{"a": 1}]}, {"a": {"almost": 1}}, {"a": {}}, {"on": "a", "op": "??"}, {"a": {"between": [1]}},
        {"a": {"relevant": {"query": "q"}}}, {"a": {"relevant": {"query": "q", "top_k": 3, "threshold": 0.1}}}, {"a": {"relevant": {"top_k": 3}}}, {"a": {"relevant": {"query": "q", "threshold": 2}}}, {"a": {"relevant": {"query": "q", "top_k": 0}}}, {"a": {"relevant": {"query": "q", "top_k": True}}},
    ],
)
def test_refusals(raw):
    with pytest.raises(InvalidQueryError, match="filter"):
        normalize(raw)


def test_walks():
    tree = normalize({"and": [{"a": 1}, {"or": [{"b": 2}, {"not": {"c": 3}}]}]})
    assert [x.on for x in leaves(tree)] == ["a", "b", "c"]
    assert both(ALL, Leaf("a", "eq", 1)) == Leaf("a", "eq", 1)


def test_rankings():
    assert normalize_rank({"field": "t", "text": "q", "topK": "5", "method": "Vector", "threshold": "0.5", "odd": 1, "group_by": "g"}) == {"on": "t", "query": "q", "limit": 5, "method": "semantic", "min_score": 0.5, "partition_by": "g"}
    for bad in ({"method": "lexical", "vector": [1.0]}, {"method": "semantic"}, {"method": "semantic", "query": "q", "vector": [1.0]}, {"method": "semantic", "vector": [float("nan")]}, {"method": "semantic", "vector": []}, {"method": "lexical", "query": "q", "limit": 501}):
        with pytest.raises(InvalidQueryError):
            check_rank(bad)
    with pytest.raises(InvalidQueryError):
        normalize_rank({"method": "magic"})
    with pytest.raises(InvalidQueryError):
        normalize_rank({"limit": "many"})
