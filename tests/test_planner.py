from datetime import datetime

import pytest

from quern.errors import InvalidQueryError, ModelError, ScopeError, UnknownEntityError
from quern.operators.predicate import coerce
from quern.plans.describe import describe, diagnose, format_findings, shaped
from quern.plans.graph import conformed_dimensions, grain_rank, group_grain, resolve, to_one_paths
from quern.plans.model import Atomic, Computed, Derived, Entity, Field, Ratio, Rel, SemanticModel, infer_relations, is_identifier, to_identifier
from quern.service import UNSCOPED, Engine, tenant_scope
from quern.sources.tables import MEASURES, entities, model

M = model("/nowhere")


def test_paths():
    assert [[r.name for r in p] for p in to_one_paths(M, "orders", "region")] == [["customer", "nation", "region"]]
    assert len(to_one_paths(M, "lineitem", "nation")) == 2
    assert [r.name for r in resolve(M, "orders", "nation.n_name").hops] == ["customer", "nation"]
    assert [r.name for r in resolve(M, "lineitem", "supplier.nation.n_name").hops] == ["supplier", "nation"]
    assert resolve(M, "events", "props.a.b").json_path == "$.a.b"
    assert not resolve(M, "customer", "orders.o_totalprice").to_one
    assert resolve(M, "orders", "r_name", bare_dimension=True).entity.name == "region"
    assert resolve(M, "part", "brand").kind == "eav" and resolve(M, "customer", "spent").kind == "computed"


@pytest.mark.parametrize("source, path, why", [("lineitem", "nation.n_name", "ambiguous"), ("customer", "lineitem.l_tax", "to-many"), ("embeddings", "region.r_name", "unreachable"), ("orders", "nothing", "unknown field"), ("orders", "customer.events.value", "unsupported"), ("orders", "a..b", "not a path")])
def test_rejects(source, path, why):
    with pytest.raises(InvalidQueryError, match=why):
        resolve(M, source, path)


def test_bare_dimension_of_two_entities_is_ambiguous():
    with pytest.raises(InvalidQueryError, match="ambiguous"):
        resolve(M, "lineitem", "n_name", bare_dimension=True)


def test_grains_and_dimensions():
    assert [grain_rank(M, n) for n in ("region", "nation", "customer", "supplier", "part", "orders", "events", "lineitem")] == [0, 1, 2, 2, 0, 3, 3, 4]
    assert group_grain(M, "orders", ["region.r_name", "customer.c_mktsegment"]) == "customer"
    names = [n for n, *_ in conformed_dimensions(M, "lineitem")]
    assert "orders.o_orderstatus" in names and "part.p_brand" in names and "nation.n_name" not in names and "l_tax" not in names


def test_identifiers():
    assert to_identifier("Total Price (EUR)") == "total_price_eur" and to_identifier("o_totalprice.sum") == "o_totalprice_sum" and to_identifier("9x") == "_9x" and to_identifier("netRevenue") == "net_revenue"
    assert is_identifier("a_1") and not is_identifier("A") and not is_identifier("1a") and not is_identifier("a b")


@pytest.mark.parametrize(
    "measures",
    [
        [Atomic("x", "nobody", "sum", "y")], [Atomic("x", "orders", "median", "o_totalprice")], [Atomic("x", "orders", "sum", expr={"value": 1})], [Ratio("r", "o_totalprice.sum", "missing")], [Derived("d", {"value": 2})],
        [Atomic("o_totalprice_sum", "orders", "count")], [Atomic("x", "lineitem", "sum", "l_tax", additivity="additive")], [Ratio("r", "o_totalprice.sum", "o_totalprice.avg"), Ratio("q", "r", "o_totalprice.sum")],
    ],
)
def test_bad_measures_fail_at_load(measures):
    with pytest.raises((ModelError, InvalidQueryError)):
        SemanticModel.build(entities("/nowhere"), measures)


def test_catalog():
    assert M.measures["o_totalprice.sum"].source == "orders" and M.measures["l_tax.avg"].additivity == "non"
    assert "l_tax.sum" not in M.measures and "size.sum" in M.measures
    with pytest.raises(ModelError):
        Field("x", aggs=("median",))
    with pytest.raises(ModelError):
        Computed("x", "sum", (("a", "b"), ("c", "d")))


def test_describe():
    d = describe(M, "customer")
    by_name = {f["name"]: f for f in d["fields"]}
    assert by_name["c_acctbal"]["additivity"] == "semi" and by_name["order_count"]["source"] == "computed" and by_name["score"]["source"] == "eav"
    assert "contains" in by_name["c_name"]["operators"] and "contains" not in by_name["c_acctbal"]["operators"] and by_name["c_name"]["searchable"]
    assert "relevant" in {f["name"]: f for f in describe(M, "documents")["fields"]}["text"]["operators"]
    with pytest.raises(UnknownEntityError):
        describe(M, "nobody")
    assert {f["name"] for f in shaped(M, find="price")["lineitem"]["fields"]} == {"l_extendedprice"} and "region" not in shaped(M, find="price")
    assert [f["name"] for f in shaped(M, show={"orders": ["o_custkey"]})["orders"]["fields"]] == ["o_custkey"]


def test_findings():
    a = Entity("a", None, "id", (Field("id"), Field("b_id"), Field("c_id")), (Rel("b", "belongs_to", "b", "b_id"), Rel("x", "belongs_to", "gone", "c_id")))
    b = Entity("b", None, "id", (Field("id"), Field("owner_id")), (Rel("cs", "has_many", "a", "no_such"),))
    codes = {x["code"] for x in diagnose(SemanticModel.build([a, b]), ["v -> w"])}
    assert codes == {"EDGE_TO_UNREGISTERED", "MISSING_INVERSE", "DANGLING_FK", "HEURISTIC_FK", "UNSUPPORTED_RELATION"}
    assert format_findings([]) == "no findings" and "DANGLING_FK" in format_findings(diagnose(SemanticModel.build([a, b]))).splitlines()[0]


def test_inferred_relations():
    rels, skipped = infer_relations({"a": "id", "b": "id", "p": "a_id"}, [("b", "a_id", "a"), ("p", "a_id", "a"), ("b", "x,y", "a"), ("b", "z_id", "view")])
    assert [(r.name, r.kind) for r in rels["a"]] == [("bs", "has_many"), ("p", "has_one")] and rels["b"][0].kind == "belongs_to" and len(skipped) == 2


def test_values_are_coerced_before_spark_sees_them():
    assert coerce("7", "number", "x") == 7 and coerce("7.5", "number", "x") == 7.5 and coerce(["1", 2], "integer", "x") == [1, 2]
    assert coerce("true", "boolean", "x") is True and coerce("0", "boolean", "x") is False and coerce(5, "string", "x") == "5"
    assert coerce("2024-01-02T03:00:00+02:00", "datetime", "x") == datetime(2024, 1, 2, 1) and coerce(0, "datetime", "x") == datetime(1970, 1, 1)
    for value, kind in (("x", "number"), ("maybe", "boolean"), ("soon", "datetime")):
        with pytest.raises(InvalidQueryError):
            coerce(value, kind, "x")


def test_a_scope_must_be_chosen():
    with pytest.raises(ScopeError):
        Engine(None, M)
    assert Engine(None, M, scope=UNSCOPED).reader.scope is None
    held = {"t": 1}
    scope = tenant_scope(lambda: held["t"], {"orders": "org"}, tenant_global=["region"])
    assert scope("orders") == {"org": 1} and scope("part") is None and repr(scope("region")) == "TENANT_GLOBAL"
    held["t"] = None
    assert scope("orders") is None
    assert len(MEASURES) == 10
