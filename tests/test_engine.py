from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from quern import queries as q
from quern.errors import InvalidQueryError, ScopeError, UnknownEntityError
from quern.operators.fetch import project
from quern.operators.relation import TENANT_GLOBAL
from quern.operators.vector import cosine
from quern.plans.model import Eav, Entity, Field, Rel, SemanticModel
from quern.service import UNSCOPED, Engine
from quern.sources.tables import distinct_values, registered

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not Path(SF).exists(), reason="driver tables")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings labels".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@needs_tables
@pytest.mark.parametrize("name", sorted(q.ORACLES))
def test_query_matches_sql(spark, duck, name):
    df = q.QUERIES[name](spark, SF)
    want = duck.sql(q.ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    order = sorted(df.columns)
    norm = lambda rows, columns: sorted([tuple(repr(dict(zip(columns, r))[c]) for c in order) for r in rows])
    assert norm(df.collect(), df.columns) == norm(want.fetchall(), want.columns)


@pytest.fixture(scope="module")
def engine(spark):
    return q.engine(spark, SF)


@needs_tables
def test_entry(spark):
    assert entry.entry(spark).count() > 0


@needs_tables
def test_naive_join_inflates_what_the_engine_does_not(spark, engine, duck):
    naive = duck.sql("SELECT sum(o_totalprice) FROM lineitem JOIN orders ON l_orderkey = o_orderkey").fetchall()[0][0]
    truth = duck.sql("SELECT sum(o_totalprice) FROM orders").fetchall()[0][0]
    got = engine.measure("orders", measures=["o_totalprice.sum", "l_quantity.sum"]).df.first()["o_totalprice_sum"]
    assert abs(got - truth) < 1 and naive > 3 * truth


REFUSED = [
    ("orders", {"measures": ["nothing"]}, "unknown"),
    ("orders", {"measures": [{"agg": "median", "on": "o_totalprice"}]}, "aggregate"),
    ("orders", {"measures": ["o_totalprice.sum", "o_totalprice.sum"]}, "twice"),
    ("orders", {"measures": ["running_revenue"]}, "cumulative"),
    ("lineitem", {"measures": [{"agg": "sum", "on": "l_discount"}]}, "SUM_NON_ADDITIVE"),
    ("customer", {"measures": [{"agg": "sum", "on": "c_acctbal"}]}, "SEMI_OVER_TIME"),
    ("orders", {"measures": [{"agg": "avg", "on": "o_custkey"}]}, "MEASURE_ON_DIMENSION"),
    ("orders", {"measures": ["orders_count"], "group_by": ["o_totalprice"]}, "dimension"),
    ("customer", {"measures": [{"agg": "count", "on": "*"}], "group_by": ["orders.o_orderstatus"]}, "to-many"),
    ("lineitem", {"measures": ["net_revenue"], "group_by": ["nation.n_name"]}, "ambiguous"),
    ("orders", {"measures": ["o_totalprice.sum", "event_value"], "filter": {"o_orderstatus": "F"}}, "no to-one path|to-many|unknown"),
    ("orders", {"measures": ["o_totalprice.sum", "event_value"], "group_by": ["o_orderstatus"]}, "no to-one path|to-many|unknown"),
    ("orders", {"measures": ["avg_order_value"], "having": {"avg_order_value": {"gt": 1}}}, "having"),
    ("orders", {"measures": ["orders_count"], "order_by": [{"on": "zzz"}]}, "order_by"),
    ("orders", {"measures": ["orders_count"], "limit": 0}, "limit"),
    ("orders", {"measures": [{"agg": "count", "on": "*", "as": "N"}]}, "identifier"),
    ("orders", {"measures": [{"agg": "count", "on": "*", "where": {"customer.c_name": "x"}}]}, "where"),
    ("orders", {"measures": []}, "none"),
    ("part", {"measures": [{"agg": "count", "on": "*"}], "filter": {"p_size": {"contains": "1"}}}, "text"),
    ("documents", {"measures": [{"agg": "count", "on": "*"}], "filter": {"or": [{"text": {"relevant": {"query": "vec:1", "top_k": 3}}}, {"lang": "en"}]}}, "top_k"),
    ("orders", {"measures": [{"agg": "count", "on": "*"}], "filter": {"o_orderstatus": {"relevant": {"query": "vec:1", "threshold": 0.5}}}}, "embedding"),
]


@needs_tables
@pytest.mark.parametrize("name, options, why", REFUSED)
def test_measure_refusals(engine, name, options, why):
    with pytest.raises(InvalidQueryError, match=why):
        engine.measure(name, **options)


@needs_tables
def test_other_refusals(engine, spark):
    with pytest.raises(UnknownEntityError):
        engine.measure("nobody", measures=["orders_count"])
    for options in ({"page": {"limit": 501}}, {"sort": [{"on": "orders.o_orderkey"}]}, {"window": [{"agg": "sum", "on": "*", "partition_by": [], "as": "x"}]}, {"window": [{"agg": "sum", "on": "c_acctbal", "as": "C"}]}, {"rank_by": {"query": "x"}}):
        with pytest.raises(InvalidQueryError):
            engine.select("customer", **options)
    with pytest.raises(InvalidQueryError):
        engine.select("lineitem")
    with pytest.raises(InvalidQueryError):
        engine.fetch("orders", list(range(501)))
    with pytest.raises(InvalidQueryError):
        engine.fetch("orders", [1], expand=["customer.nation.region.nations"])
    for variants, more in (([{"label": "a"}], {}), ([{"label": "a"}, {"label": "a"}], {}), ([{"label": "a__b"}, {"label": "c"}], {}), ([{"label": "a"}, {"label": "b"}], {"baseline": "z"}), ([{"label": "a"}, {"label": "b"}], {"derive": ["log"]}), ([{"label": "a"}, {"label": "b"}], {"per_variant_top": {"by": "x", "n": 1}, "limit": 3})):
        with pytest.raises(InvalidQueryError):
            engine.compare("orders", variants=variants, measures=["orders_count"], **more)
    with pytest.raises(InvalidQueryError):
        engine.compare("documents", variants=[{"label": "a", "filter": {"text": {"relevant": {"query": "vec:1", "top_k": 3}}}}, {"label": "b"}], measures=[{"agg": "count", "on": "*"}])


@needs_tables
def test_scope_fails_closed_wherever_a_query_goes(spark):
    def scope(entity):
        return {"orders": {"o_orderstatus": "F"}, "nation": TENANT_GLOBAL}.get(entity)

    e = q.engine(spark, SF, scope)
    assert e.measure("orders", measures=["orders_count"]).df.first()[0] > 0
    for run in (lambda: e.measure("customer", measures=[{"agg": "count", "on": "*"}]), lambda: e.measure("orders", measures=["orders_count"], group_by=["customer.c_name"]), lambda: e.select("nation", filter={"customers.c_name": "x"}), lambda: e.fetch("orders", [1], expand=["customer"]), lambda: e.measure("orders", measures=["orders_count", "event_value"])):
        with pytest.raises(ScopeError):
            run()


@needs_tables
def test_results_know_more(engine):
    page = engine.select("orders", filter={"o_orderstatus": "F"}, page={"limit": 5})
    assert page.total() > 5 and page.has_more() and len(page.ids()) == 5 and page.citation() is None
    m = engine.measure("orders", measures=["orders_count", {"ratio": {"numerator": "o_totalprice.sum", "denominator": "urgent_revenue"}, "as": "x"}], group_by=["o_orderpriority"], limit=2)
    assert m.group_count() == 5 and m.df.count() == 2 and m.grain == "orders"
    assert any("null value" in w for w in engine.measure("orders", measures=[{"ratio": {"numerator": "o_totalprice.sum", "denominator": "urgent_revenue"}, "as": "x"}], group_by=["o_orderpriority"]).warnings())
    assert "sort" in engine.select("embeddings", rank_by={"on": "embedding", "query": "vec:3"}, sort=[{"on": "label"}]).warnings[0]
    groups = engine.select("embeddings", columns=[], rank_by={"on": "embedding", "query": "vec:3", "per": "label", "limit": 2})
    assert groups.total() == 10 and groups.df.count() == 20
    assert engine.select_many([{"entity": "region"}, {"entity": "nation", "page": {"limit": 3}}]) == [([0, 1, 2, 3, 4], 5), ([0, 1, 2], 25)]
    c = engine.compare("orders", variants=[{"label": "none", "filter": {"o_orderstatus": "Z"}}, {"label": "all"}], measures=["orders_count"], group_by=["o_orderstatus"])
    assert any("is empty" in w for w in c.warnings()) and any("nothing to divide by" in w for w in c.warnings())
    sep = engine.compare("orders", variants=[{"label": "a"}, {"label": "b"}], measures=["orders_count"], delivery="separate")
    assert sep.df is None and sep.variants["a"].df.first() == sep.variants["b"].df.first()


@needs_tables
def test_citations(engine, duck):
    similarity = "list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 5))"
    top = duck.sql(f"SELECT doc_id, {similarity} AS s FROM documents JOIN embeddings ON doc_id = vec_id ORDER BY s DESC, doc_id LIMIT 11").fetchall()
    m = engine.measure("documents", measures=[{"agg": "count", "on": "*", "as": "n"}], filter={"text": {"relevant": {"query": "vec:5", "top_k": 10}}})
    c = m.citation()
    assert m.df.first()["n"] == c["match_count"] == 10 and c["mode"] == "top_k" and abs(c["cutoff"] - top[9][1]) < 1e-9
    assert [x["id"] for x in c["exemplars"]] == [d for d, _ in top[:4]] and abs(c["exemplars"][0]["similarity"] - 1) < 1e-9
    assert c["boundary"]["lowest_included"]["id"] == top[9][0]
    s = engine.select("documents", filter={"text": {"relevant": {"query": "vec:5", "threshold": 0.3}}})
    assert s.citation()["cutoff"] == 0.3 and s.citation()["match_count"] == s.total()


def rows_model(spark):
    frame = lambda rows, schema: lambda s: s.createDataFrame(rows, schema)
    account = Entity("account", frame([(1, "A", 10), (2, "B", 10), (3, None, 20)], "id int, name string, org int"), "id", (Field("id", "integer"), Field("name"), Field("org", "integer")), (Rel("deals", "has_many", "deal", "account_id"), Rel("profile", "has_one", "profile", "account_id")))
    deal = Entity("deal", frame([(1, 1, 5.0, 10), (2, 1, None, 10), (3, None, 7.0, 10), (4, 3, 9.0, 10)], "id int, account_id int, amount double, org int"), "id", (Field("id", "integer"), Field("amount", "number", "measure", ("sum", "avg")), Field("org", "integer")), (Rel("account", "belongs_to", "account", "account_id"),))
    profile = Entity("profile", frame([(1, 1, "gold"), (2, 2, "iron"), (3, 2, "lead")], "id int, account_id int, tier string"), "id", (Field("id", "integer"), Field("tier")), (Rel("account", "belongs_to", "account", "account_id"),))
    visit = Entity("visit", frame([(1, None, 3.0), (2, 2, 4.0)], "id int, account_id int, minutes double"), "id", (Field("id", "integer"), Field("minutes", "number", "measure", ("sum",))), (Rel("account", "belongs_to", "account", "account_id"),))
    return SemanticModel.build([account, deal, profile, visit])


def test_nulls_meet_and_scope_keeps_children(spark):
    e = Engine(spark, rows_model(spark), scope=UNSCOPED)
    got = {r["account.name"]: (r["amount_sum"], r["minutes_sum"]) for r in e.measure("deal", measures=["amount.sum", "minutes.sum"], group_by=["account.name"]).df.collect()}
    assert got == {"A": (5.0, None), "B": (None, 4.0), None: (16.0, 3.0)}
    scoped = Engine(spark, rows_model(spark), scope=lambda n: {"org": 10} if n in ("account", "deal") else None)
    got = {r["account.name"]: r["amount_sum"] for r in scoped.measure("deal", measures=["amount.sum"], group_by=["account.name"]).df.collect()}
    assert got == {"A": 5.0, None: 16.0}  # the deal of the other tenant's account is kept, its parent isn't seen
    assert e.measure("deal", measures=[{"agg": "sum", "on": "amount", "as": "s"}], filter={"amount": {"neq": 5}}).df.first()["s"] == 16.0


def test_fetch_checks_and_projects(spark):
    e = Engine(spark, rows_model(spark), scope=UNSCOPED)
    rows = {r.id: r for r in e.fetch("account", [1, 2, 3, 4], expand=["deals"]).collect()}
    assert [d.amount for d in rows[1].deals] == [5.0, None] and rows[2].deals == [] and len(rows) == 3
    with pytest.raises(Exception, match="more than one row"):
        e.fetch("account", [2], expand=["profile"]).collect()
    df = project(e.fetch("account", [1], expand=["deals"]), e.model.entity("account"), {"account": ["id"], "deal": ["amount"]}, e.model.entities)
    assert df.first().asDict(recursive=True) == {"id": 1, "deals": [{"amount": 5.0}, {"amount": None}]}


def test_eav_definitions_and_registrations(spark):
    definitions = spark.createDataFrame([("d1", "o", None, "size", "integer", "Size", "thing", True), ("d2", "o", None, "kind", "multi_select", "Kind", "thing", False), ("d3", "p", None, "other", "text", "Other", "thing", True)], "field_definition_id string, organization_id string, user_id string, key string, data_type string, label string, entity_type string, is_visible boolean")
    shown = Eav.from_definitions(definitions, None, "thing", owner="o")
    assert set(shown.fields) == {"size"} and shown.fields["size"][1].role == "measure"
    assert Eav.from_definitions(definitions, None, "thing", visible_only=False).fields["kind"][1].type == "enum"
    table = spark.createDataFrame([("B", "b", True, 2), ("A", "a", True, 1), ("C", "c", False, 0), ("D", "gone", True, 3)], "name string, table_key string, enabled boolean, sort_order int")
    a, b = (Entity(n, None, "id", ()) for n in "ab")
    assert registered(table, {"a": a, "b": b}) == [a, b]
    assert distinct_values(table, "table_key") == ("a", "b", "c", "gone") and distinct_values(table, "table_key", 2) == ()


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0],), ([0.0, 0.0],), (None,), ([1.0],), ([3.0, 4.0],)], "v array<float>")
    assert [r[0] for r in df.select(F.round(cosine(F.col("v"), [3, 4]), 6)).collect()] == [0.6, None, None, None, 1.0]


def test_snippets_of_text_conditions(engine):
    rows = engine.select("part", columns=["p_size", "_snippets"], filter={"p_name": {"contains": "RING"}}, page={"limit": 20}).df.collect()
    assert rows and all(len(r["_snippets"]) == 1 for r in rows)
    for r in rows:
        s = r["_snippets"][0]
        assert s["column"] == "p_name" and s["snippet"][s["match"]["start"] : s["match"]["end"]].lower() == "ring" and s["full_length"] == len(s["snippet"].strip("…"))
    magic = engine.select("part", columns=["_snippets"], filter={"text": {"contains": "brand#2"}}, page={"limit": 5}).df.collect()
    assert all("p_brand" in [s["column"] for s in r["_snippets"]] for r in magic)
    ends = engine.select("part", columns=["p_name", "_snippets"], filter={"and": [{"p_name": {"startswith": "small"}}, {"p_name": {"endswith": "widget"}}]}, page={"limit": 5}).df.collect()
    assert all([s["match"]["start"] for s in r["_snippets"]] == [0, len(r["p_name"]) - 6] for r in ends)
    assert engine.select("part", columns=["_snippets"], page={"limit": 1}).df.columns == ["p_partkey"]


def test_one_pass_where_one_is_enough(engine):
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    variants = [{"label": "a", "filter": {"o_orderstatus": "F"}}, {"label": "b", "filter": {"o_orderstatus": "O"}}]
    found = engine.compare("orders", variants=variants, measures=["orders_count"], group_by=["o_orderpriority"])
    assert plan(found.df).count("Relation [") == 1
    assert plan(engine.compare("orders", variants=variants, measures=["orders_count"], group_by=["o_orderpriority"], having={"orders_count": {"gt": 1}}).df).count("Relation [") == 2
    metrics = engine.fetch("customer", engine.reader.table("customer").select("c_custkey")).select("order_count", "finished_orders", "last_order_at", "spent")
    assert plan(metrics).count("o_custkey") > 0 and plan(metrics).count("Aggregate [o_custkey") <= 1
    whole = engine.select("orders", window=[{"agg": "count", "on": "*", "as": "n"}, {"agg": "sum", "on": "o_totalprice", "partition_by": [], "as": "s"}], page={"limit": 3}).df
    assert "Window" not in plan(whole) and len({tuple(r)[-2:] for r in whole.collect()}) == 1


def test_shown_columns_and_requesters(spark, engine):
    from quern.errors import InvalidQueryError
    from quern.service import UNSCOPED, Engine, Surface

    shown = Engine(spark, engine.model, scope=UNSCOPED, expose={"customer": ["c_name"], "orders": ["o_totalprice"]})
    assert shown.select("customer", columns=["c_name", "c_acctbal"], page={"limit": 1}).df.columns == ["c_custkey", "c_name"]
    assert shown.select("orders", columns=["customer.c_name", "customer.c_acctbal", "o_totalprice"], page={"limit": 1}).df.columns == ["o_orderkey", "customer.c_name", "o_totalprice"]
    assert "c_acctbal" not in [f["name"] for f in shown.describe("customer")["fields"]] and "order_count" in [f["name"] for f in shown.describe("customer")["fields"]]
    rows = shown.fetch("customer", [1, 2], expand=["orders"])
    assert "c_acctbal" not in rows.columns and {"c_custkey", "c_name", "order_count", "orders"} <= set(rows.columns)
    assert "o_orderstatus" not in rows.schema["orders"].dataType.elementType.fieldNames()

    seen = []
    surface = Surface(spark, engine.model, requester=lambda: "r", scope_for=lambda r, u: seen.append((r, u)) or (lambda e: {"c_custkey": int(u)} if u else {"c_custkey": {"lt": 5}}), resolve_user=lambda r, v: {"x@y": "3"}.get(v), list_users=lambda r: ["3"])
    count = {"measures": [{"agg": "count", "on": "*", "as": "n"}]}
    assert surface.run("measure", "customer", **count).df.first()["n"] > 1
    assert surface.run("measure", "customer", scope={"as": "user", "user": "x@y"}, **count).df.first()["n"] == 1
    surface.run("measure", "customer", scope={"as": "org"}, **count)
    assert seen == [("r", None), ("r", "3")] and surface.list_users() == ["3"]
    for bad in ({"as": "user"}, {"as": "user", "user": "nobody"}, {"as": "team"}):
        with pytest.raises(InvalidQueryError):
            surface.run("select", "customer", scope=bad)


def test_values_that_repeat_are_refused(spark, engine, monkeypatch):
    from dataclasses import replace

    part = engine.model.entity("part")
    monkeypatch.setitem(engine.model.entities, "part", replace(part, eav=replace(part.eav, values=lambda s, f=part.eav.values: f(s).union(f(s)))))
    with pytest.raises(Exception, match="several values"):
        engine.measure("part", measures=[{"agg": "count", "on": "*", "as": "n"}], group_by=["brand"]).df.collect()


def test_more_of_what_requests_may_say(engine):
    ranked = [engine.select("embeddings", columns=["label"], rank_by=r).df.collect() for r in ({"on": "embedding", "query": "vec:7", "limit": 3}, {"field": "embedding", "q": "vec:7", "topK": 3, "mode": "Cosine"}, {'"search"': "vec:7", "K": "3", "method": "similar"})]
    assert ranked[0] == ranked[1] == ranked[2]
    vector = list(engine.embed("vec:7"))
    assert engine.select("embeddings", columns=["label"], rank_by={"query_vector": vector, "k": 3}).df.collect() == ranked[0]
    dims = {d["path"]: d for d in engine.describe_conformed_dimensions("lineitem")}
    assert dims["part.brand"]["owner"] == "part" and dims["part.brand"]["via"] == "to-one" and dims["l_returnflag"]["via"] == "local"
    cited = engine.select("documents", filter={"text": {"relevant": {"query": "vec:7", "top_k": 5}}}, citation={"boundary": True}).citation()
    assert cited["boundary"]["highest_excluded"]["similarity"] <= cited["boundary"]["lowest_included"]["similarity"]
    from quern.errors import InvalidQueryError

    two = [{"label": "a"}, {"label": "b"}]
    for bad in ({"limit": 10**9}, {"per_variant_top": {"by": "orders_count", "n": 10**6}}):
        with pytest.raises(InvalidQueryError):
            engine.compare("orders", variants=two, measures=["orders_count"], **bad)
    with pytest.raises(InvalidQueryError):
        engine.measure("orders", measures=["orders_count"], filter={"o_orderstatus": {"not": "F"}})
