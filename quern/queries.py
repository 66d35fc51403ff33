"""Queries over the driver's tables, one for each operator, with their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.service import TENANT_GLOBAL, UNSCOPED, Engine
from quern.sources.tables import model

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def engine(spark: SparkSession, folder: str, scope: Any = UNSCOPED) -> Engine:
    def embed(text: str) -> list[float]:
        """``vec:<id>`` stands for the stored vector of that row."""
        row = spark.read.parquet(f"{folder}/embeddings.parquet").where(F.col("vec_id") == int(text.removeprefix("vec:"))).first()
        return list(row["embedding"])

    return Engine(spark, model(folder), scope=scope, embed=embed)


def plain(df: DataFrame, places: int = 2) -> DataFrame:
    """Columns by identifiers, doubles rounded, integers as longs: what both engines can agree on."""
    kinds = dict(df.dtypes)
    out = []
    for c in df.columns:
        column = F.col(f"`{c}`")
        kind = kinds[c]
        if kind in ("double", "float") or kind.startswith("decimal"):
            column = F.round(column.cast("double"), places)
        elif kind in ("int", "smallint", "tinyint"):
            column = column.cast("long")
        elif kind.startswith("timestamp"):
            column = F.date_format(column, "yyyy-MM-dd HH:mm:ss")
        out.append(column.alias(c.replace(".", "_")))
    return df.select(*out)


def add(name: str, run: Callable[[Engine], DataFrame], sql: str | None, scope: Any = UNSCOPED, places: int = 2) -> None:
    QUERIES[name] = lambda spark, folder: plain(run(engine(spark, folder, scope)), places)
    if sql:
        ORACLES[name] = sql


def measured(name: str, entity: str, sql: str, *, scope: Any = UNSCOPED, places: int = 2, **options: Any) -> None:
    add(name, lambda e: e.measure(entity, **options).df, sql, scope, places)


def filtered(name: str, entity: str, key: str, condition: Any, where: str) -> None:
    """All keys that a filter leaves, through measure's grouping by key, which has no page."""
    add(name, lambda e: e.measure(entity, measures=[{"agg": "count", "on": "*", "as": "n"}], group_by=[key], filter=condition).df, f"SELECT {key}::BIGINT AS {key}, count(*)::BIGINT AS n FROM {entity} WHERE {where} GROUP BY 1")


REVENUE = {"ref": "o_totalprice.sum", "as": "revenue"}
COUNT = {"agg": "count", "on": "*", "as": "n"}

# --- measure
measured("measure_local_group", "orders", """
SELECT o_orderstatus, count(*)::BIGINT AS n, count(DISTINCT o_custkey)::BIGINT AS customers, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 2) AS mean, min(o_totalprice) AS low, max(o_totalprice) AS high
FROM orders GROUP BY 1""", group_by=["o_orderstatus"], measures=[COUNT, {"agg": "count_distinct", "on": "o_custkey", "as": "customers"}, *({"agg": a, "on": "o_totalprice", "as": n} for a, n in (("sum", "total"), ("avg", "mean"), ("min", "low"), ("max", "high")))])  # fmt: skip
measured("measure_global", "orders", "SELECT count(*)::BIGINT AS n, round(sum(o_totalprice), 2) AS revenue FROM orders", measures=[COUNT, REVENUE])
measured("measure_to_one", "orders", "SELECT c_mktsegment AS customer_c_mktsegment, round(sum(o_totalprice), 2) AS revenue FROM orders LEFT JOIN customer ON o_custkey = c_custkey GROUP BY 1", group_by=["customer.c_mktsegment"], measures=[REVENUE])
measured("measure_multi_hop", "orders", "SELECT r_name AS region_r_name, round(sum(o_totalprice), 2) AS revenue, count(*)::BIGINT AS n FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey GROUP BY 1", group_by=["region.r_name"], measures=[REVENUE, COUNT])
measured("measure_bare_dimension", "orders", "SELECT r_name, count(*)::BIGINT AS n FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey GROUP BY 1", group_by=["r_name"], measures=[COUNT])
measured("measure_named_path", "lineitem", "SELECT n_name AS supplier_nation_n_name, round(sum(l_quantity), 2) AS quantity FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN nation ON s_nationkey = n_nationkey GROUP BY 1", group_by=["supplier.nation.n_name"], measures=[{"ref": "l_quantity.sum", "as": "quantity"}])
measured("measure_has_one", "documents", "SELECT quality::BIGINT AS label_row_quality, count(*)::BIGINT AS n, sum(n_chars)::BIGINT AS chars FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1", group_by=["label_row.quality"], measures=[COUNT, {"ref": "n_chars.sum", "as": "chars"}])
measured("measure_semijoin_filter", "customer", "SELECT c_mktsegment, count(*)::BIGINT AS n FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000) GROUP BY 1", group_by=["c_mktsegment"], measures=[COUNT], filter={"orders.o_totalprice": {"gt": 300000}})
measured("measure_antijoin_filter", "customer", "SELECT c_mktsegment, count(*)::BIGINT AS n FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000) GROUP BY 1", group_by=["c_mktsegment"], measures=[COUNT], filter={"not": {"orders.o_totalprice": {"gt": 300000}}})
measured("measure_exists_under_or", "customer", "SELECT c_mktsegment, count(*)::BIGINT AS n FROM customer WHERE c_acctbal < 0 OR EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000) GROUP BY 1", group_by=["c_mktsegment"], measures=[COUNT], filter={"or": [{"c_acctbal": {"lt": 0}}, {"orders.o_totalprice": {"gt": 400000}}]})
measured("measure_multi_source", "orders", """
WITH o AS (SELECT c_mktsegment AS k, sum(o_totalprice) AS revenue FROM orders LEFT JOIN customer ON o_custkey = c_custkey GROUP BY 1),
e AS (SELECT c_mktsegment AS k, sum(value) AS events FROM events LEFT JOIN customer ON user_id = c_custkey GROUP BY 1)
SELECT coalesce(o.k, e.k) AS customer_c_mktsegment, round(revenue, 2) AS revenue, round(events, 2) AS events FROM o FULL JOIN e ON o.k IS NOT DISTINCT FROM e.k""", group_by=["customer.c_mktsegment"], measures=[REVENUE, {"ref": "event_value", "as": "events"}])
measured("measure_three_source", "orders", """
WITH o AS (SELECT o_custkey AS k, sum(o_totalprice) AS revenue FROM orders GROUP BY 1),
e AS (SELECT user_id AS k, count(*) AS events FROM events GROUP BY 1),
c AS (SELECT c_custkey AS k, count(*) AS customers FROM customer GROUP BY 1),
k AS (SELECT k FROM o UNION SELECT k FROM e UNION SELECT k FROM c)
SELECT k.k AS customer_c_custkey, round(revenue, 2) AS revenue, events::BIGINT AS events, customers::BIGINT AS customers
FROM k LEFT JOIN o ON k.k IS NOT DISTINCT FROM o.k LEFT JOIN e ON k.k IS NOT DISTINCT FROM e.k LEFT JOIN c ON k.k IS NOT DISTINCT FROM c.k""", group_by=["customer.c_custkey"], measures=[REVENUE, {"agg": "count", "source": "events", "as": "events"}, {"agg": "count", "source": "customer", "as": "customers"}])
measured("measure_fan_contrast", "orders", """
WITH o AS (SELECT o_orderstatus, sum(o_totalprice) AS revenue FROM orders GROUP BY 1),
l AS (SELECT o_orderstatus, sum(l_quantity) AS quantity FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey GROUP BY 1)
SELECT coalesce(o.o_orderstatus, l.o_orderstatus) AS o_orderstatus, round(revenue, 2) AS revenue, round(quantity, 2) AS quantity FROM o FULL JOIN l ON o.o_orderstatus IS NOT DISTINCT FROM l.o_orderstatus""", group_by=["o_orderstatus"], measures=[REVENUE, {"ref": "l_quantity.sum", "as": "quantity"}])
measured("measure_multi_source_filter", "orders", """
WITH o AS (SELECT sum(o_totalprice) AS revenue FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'),
e AS (SELECT sum(value) AS events FROM events JOIN customer ON user_id = c_custkey WHERE c_mktsegment = 'BUILDING')
SELECT round(revenue, 2) AS revenue, round(events, 2) AS events FROM o, e""", measures=[REVENUE, {"ref": "event_value", "as": "events"}], filter={"customer.c_mktsegment": "BUILDING"})
measured("measure_filtered_agg", "orders", "SELECT o_orderpriority, round(sum(o_totalprice) FILTER (WHERE o_orderstatus = 'F'), 2) AS finished, count(*) FILTER (WHERE o_totalprice > 200000)::BIGINT AS large FROM orders GROUP BY 1", group_by=["o_orderpriority"], measures=[{"agg": "sum", "on": "o_totalprice", "where": {"o_orderstatus": "F"}, "as": "finished"}, {"agg": "count", "on": "*", "where": {"o_totalprice": {"gt": 200000}}, "as": "large"}])
measured("measure_having", "orders", "SELECT o_custkey::BIGINT AS o_custkey, count(*)::BIGINT AS n FROM orders GROUP BY 1 HAVING count(*) >= 15", group_by=["o_custkey"], measures=[COUNT], having={"n": {"gte": 15}})
measured("measure_order_limit", "orders", "SELECT o_custkey::BIGINT AS o_custkey, round(sum(o_totalprice), 2) AS revenue FROM orders GROUP BY 1 ORDER BY sum(o_totalprice) DESC NULLS LAST, 1 LIMIT 20", group_by=["o_custkey"], measures=[REVENUE], order_by=[{"on": "revenue", "dir": "desc"}], limit=20)
measured("measure_ratio", "orders", "SELECT o_orderpriority, round(sum(o_totalprice) / count(*), 2) AS avg_order_value, round(coalesce(sum(o_totalprice) FILTER (WHERE o_orderpriority = '1-URGENT'), 0) / nullif(sum(o_totalprice), 0), 2) AS urgent_share FROM orders GROUP BY 1", group_by=["o_orderpriority"], measures=["avg_order_value", "urgent_share"])
measured("measure_ratio_null", "customer", """
WITH o AS (SELECT o_custkey AS k, sum(o_totalprice) AS revenue FROM orders GROUP BY 1), e AS (SELECT user_id AS k, sum(value) AS v FROM events GROUP BY 1), c AS (SELECT c_custkey AS k FROM customer)
SELECT k AS c_custkey, round(coalesce(revenue, 0) / nullif(coalesce(v, 0), 0), 2) AS per_event, 1::BIGINT AS n
FROM c LEFT JOIN o USING (k) LEFT JOIN e USING (k)""", group_by=["c_custkey"], measures=[{"ratio": {"numerator": "o_totalprice.sum", "denominator": "event_value"}, "as": "per_event"}, COUNT])
measured("measure_derived", "orders", """
WITH o AS (SELECT c_mktsegment AS k, sum(o_totalprice) AS revenue FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1), e AS (SELECT c_mktsegment AS k, sum(value) AS v FROM events JOIN customer ON user_id = c_custkey GROUP BY 1)
SELECT coalesce(o.k, e.k) AS customer_c_mktsegment, round(coalesce(revenue, 0) - coalesce(v, 0), 2) AS revenue_minus_events, round(coalesce(revenue, 0) / 2, 2) AS half_revenue FROM o FULL JOIN e ON o.k = e.k""", group_by=["customer.c_mktsegment"], measures=["revenue_minus_events", "half_revenue"])
measured("measure_expression", "lineitem", "SELECT l_returnflag, round(sum(l_extendedprice * (1 - l_discount)), 2) AS net_revenue FROM lineitem GROUP BY 1", group_by=["l_returnflag"], measures=["net_revenue"])
measured("measure_expression_to_one", "lineitem", "SELECT l_linestatus, round(sum(l_quantity * coalesce(p_retailprice, 0)), 2) AS parts_list_value FROM lineitem LEFT JOIN part ON l_partkey = p_partkey GROUP BY 1", group_by=["l_linestatus"], measures=["parts_list_value"])
measured("measure_semi_with_time", "events", "SELECT user_id::BIGINT AS user_id, max(strftime(ts, '%Y-%m-%d %H:%M:%S')) AS last_at, count(*)::BIGINT AS n FROM events GROUP BY 1", group_by=["user_id"], measures=[{"agg": "max", "on": "ts", "as": "last_at"}, COUNT])

# --- filters
filtered("filter_eq", "orders", "o_orderkey", {"o_orderstatus": "F"}, "o_orderstatus = 'F'")
filtered("filter_neq", "orders", "o_orderkey", {"o_orderstatus": {"neq": "F"}}, "o_orderstatus <> 'F'")
filtered("filter_compare", "orders", "o_orderkey", {"o_totalprice": {"gt": 100000, "lte": "200000"}}, "o_totalprice > 100000 AND o_totalprice <= 200000")
filtered("filter_in", "orders", "o_orderkey", {"o_orderpriority": ["1-URGENT", "2-HIGH"]}, "o_orderpriority IN ('1-URGENT', '2-HIGH')")
filtered("filter_in_empty", "orders", "o_orderkey", {"o_orderpriority": []}, "false")
filtered("filter_nin", "orders", "o_orderkey", {"o_orderpriority": {"not_in": ["1-URGENT", "2-HIGH"]}}, "o_orderpriority NOT IN ('1-URGENT', '2-HIGH')")
filtered("filter_nin_empty", "orders", "o_orderkey", {"o_orderpriority": {"nin": []}}, "true")
filtered("filter_between", "orders", "o_orderkey", {"o_totalprice": {"between": [50000, 60000]}}, "o_totalprice BETWEEN 50000 AND 60000")
filtered("filter_contains", "part", "p_partkey", {"p_name": {"contains": "RING"}}, "p_name ILIKE '%ring%'")
filtered("filter_startswith", "part", "p_partkey", {"p_name": {"startsWith": "small"}}, "p_name ILIKE 'small%'")
filtered("filter_endswith", "part", "p_partkey", {"p_name": {"endswith": "widget"}}, "p_name ILIKE '%widget'")
filtered("filter_is_null", "documents", "doc_id", {"label_row.quality": None}, "NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = documents.doc_id)")
filtered("filter_is_not_null", "documents", "doc_id", {"label_row.quality": {"is_null": False}}, "EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = documents.doc_id)")
filtered("filter_date_whole_day", "orders", "o_orderkey", {"or": [{"o_orderdate": "1998-10-03"}, {"o_orderdate": {"gt": "2001-01-15"}}, {"o_orderdate": {"lt": "1995-01-10"}}]}, "o_orderdate::DATE = DATE '1998-10-03' OR o_orderdate::DATE > DATE '2001-01-15' OR o_orderdate::DATE < DATE '1995-01-10'")
filtered("filter_datetime", "events", "event_id", {"ts": {"gte": "2024-01-10T12:00:00Z", "lt": "2024-01-12T00:00:00+02:00"}}, "ts >= TIMESTAMP '2024-01-10 12:00:00' AND ts < TIMESTAMP '2024-01-11 22:00:00'")
filtered("filter_and_or_not", "orders", "o_orderkey", {"and": [{"or": [{"o_orderstatus": "F"}, {"o_totalprice": {"gt": 250000}}]}, {"not": {"o_orderpriority": "5-LOW"}}]}, "(o_orderstatus = 'F' OR o_totalprice > 250000) AND NOT o_orderpriority = '5-LOW'")
filtered("filter_explicit_leaf", "orders", "o_orderkey", {"on": "o_custkey", "op": "in", "value": ["1", 2, 3]}, "o_custkey IN (1, 2, 3)")
filtered("filter_json_path", "events", "event_id", {"props.k": {"in": ["7", "69"]}}, "props->>'$.k' IN ('7', '69')")
filtered("filter_text_magic", "part", "p_partkey", {"text": {"contains": "brand#2"}}, "p_name ILIKE '%brand#2%' OR p_brand ILIKE '%brand#2%' OR p_type ILIKE '%brand#2%'")
filtered("filter_has_many_tail", "nation", "n_nationkey", {"customers.c_acctbal": {"gt": 9900}}, "EXISTS (SELECT 1 FROM customer WHERE c_nationkey = n_nationkey AND c_acctbal > 9900)")
filtered("filter_computed", "customer", "c_custkey", {"order_count": {"gte": 15}}, "(SELECT count(*) FROM orders WHERE o_custkey = c_custkey) >= 15")
filtered("eav_filter", "part", "p_partkey", {"brand": "Brand#2"}, "p_partkey % 5 <> 0 AND p_brand = 'Brand#2'")
filtered("eav_json_filter", "customer", "c_custkey", {"score": {"gte": 7}}, "c_custkey % 3 <> 0 AND c_custkey % 10 >= 7")

# --- EAV
measured("eav_group", "part", "SELECT CASE WHEN p_partkey % 5 <> 0 THEN p_brand END AS brand, count(*)::BIGINT AS n FROM part GROUP BY 1", group_by=["brand"], measures=[COUNT])
measured("eav_measure", "part", "SELECT p_type, sum(p_size) FILTER (WHERE p_partkey % 5 <> 0)::DOUBLE AS size, round(avg(p_size) FILTER (WHERE p_partkey % 5 <> 0), 2) AS mean FROM part GROUP BY 1", group_by=["p_type"], measures=[{"ref": "size.sum", "as": "size"}, {"ref": "size.avg", "as": "mean"}])
measured("eav_to_one_group", "lineitem", "SELECT CASE WHEN p_partkey % 5 <> 0 THEN p_brand END AS part_brand, round(sum(l_quantity), 2) AS quantity FROM lineitem LEFT JOIN part ON l_partkey = p_partkey GROUP BY 1", group_by=["part.brand"], measures=[{"ref": "l_quantity.sum", "as": "quantity"}])
measured("eav_semijoin", "nation", "SELECT n_name, count(*)::BIGINT AS n FROM nation WHERE EXISTS (SELECT 1 FROM customer WHERE c_nationkey = n_nationkey AND c_custkey % 3 <> 0 AND c_custkey % 10 = 9) GROUP BY 1", group_by=["n_name"], measures=[COUNT], filter={"customers.score": 9})
add("eav_hydrate", lambda e: e.fetch("part", e.reader.table("part").select("p_partkey")).select("p_partkey", "brand", "size"), "SELECT p_partkey, CASE WHEN p_partkey % 5 <> 0 THEN p_brand END AS brand, CASE WHEN p_partkey % 5 <> 0 THEN p_size::DOUBLE END AS size FROM part")

# --- select
add("select_sort_page", lambda e: e.select("orders", columns=["o_totalprice", "o_orderstatus"], sort=[{"on": "o_orderstatus"}, {"on": "o_totalprice", "dir": "desc"}], page={"limit": 40, "offset": 10}).df, "SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders ORDER BY o_orderstatus NULLS LAST, o_totalprice DESC NULLS LAST, o_orderkey LIMIT 40 OFFSET 10")
add("select_default_page", lambda e: e.select("customer", filter={"c_acctbal": {"gt": 9000}}).df, "SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_acctbal > 9000 ORDER BY c_custkey LIMIT 25")
add("select_dotted_projection", lambda e: e.select("orders", columns=["customer.c_name", "customer.nation.n_name", "o_orderdate"], filter={"o_totalprice": {"gt": 300000}}, page={"limit": 100}).df, "SELECT o_orderkey, c_name AS customer_c_name, n_name AS customer_nation_n_name, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey WHERE o_totalprice > 300000 ORDER BY o_orderkey LIMIT 100")
add("select_midnight_date", lambda e: e.select("orders", columns=["o_custkey"], filter={"o_orderdate": {"lte": "1995-01-20"}}, page={"limit": 200}).df, "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderdate <= TIMESTAMP '1995-01-20 00:00:00' ORDER BY o_orderkey LIMIT 200")
add("select_window", lambda e: e.select("orders", columns=["o_custkey"], filter={"o_totalprice": {"gt": 100000}}, window=[{"agg": "sum", "on": "o_totalprice", "partition_by": ["o_custkey"], "as": "spent"}, {"agg": "count", "on": "*", "partition_by": [], "as": "everyone"}, {"agg": "count_distinct", "on": "o_orderstatus", "partition_by": ["o_custkey"], "as": "states"}], page={"limit": 100}).df, """
SELECT o_orderkey, o_custkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey), 2) AS spent, count(*) OVER ()::BIGINT AS everyone, (SELECT count(DISTINCT o2.o_orderstatus) FROM orders o2 WHERE o2.o_custkey = o.o_custkey AND o2.o_totalprice > 100000)::BIGINT AS states
FROM orders o WHERE o_totalprice > 100000 ORDER BY o_orderkey LIMIT 100""")
add("select_has_many_filter", lambda e: e.select("customer", columns=["c_name"], filter={"orders.o_totalprice": {"gt": 400000}, "c_acctbal": {"gt": 0}}, page={"limit": 300}).df, "SELECT c_custkey, c_name FROM customer WHERE c_acctbal > 0 AND EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000) ORDER BY c_custkey LIMIT 300")
SIMILARITY = "list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 7))"
add("rank_semantic", lambda e: e.select("embeddings", columns=["label"], rank_by={"on": "embedding", "query": "vec:7", "limit": 15}).df, f"SELECT vec_id, label::BIGINT AS label, round({SIMILARITY}, 6) AS _rank FROM embeddings ORDER BY {SIMILARITY} DESC, vec_id LIMIT 15", places=6)
add("rank_min_score", lambda e: e.select("embeddings", columns=["label"], rank_by={"on": "embedding", "query": "vec:7", "limit": 500, "min_score": "0.2"}).df, f"SELECT vec_id, label::BIGINT AS label, round({SIMILARITY}, 6) AS _rank FROM embeddings WHERE {SIMILARITY} >= 0.2 ORDER BY {SIMILARITY} DESC, vec_id LIMIT 500", places=6)
add("rank_semantic_partition", lambda e: e.select("embeddings", columns=["label"], rank_by={"on": "embedding", "query": "vec:7", "k": 3, "per": "label"}).df, f"SELECT vec_id, label::BIGINT AS label, round(s, 6) AS _rank FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY s DESC, vec_id) AS n FROM (SELECT *, {SIMILARITY} AS s FROM embeddings)) WHERE n <= 3", places=6)

# --- relevance
_DOCS = f"(SELECT doc_id, lang, source, n_chars, {SIMILARITY} AS s FROM documents LEFT JOIN embeddings ON doc_id = vec_id)"
measured("relevant_threshold", "documents", f"SELECT lang, count(*)::BIGINT AS n FROM {_DOCS} WHERE s >= 0.1 GROUP BY 1", group_by=["lang"], measures=[COUNT], filter={"text": {"relevant": {"query": "vec:7", "threshold": 0.1}}})
measured("relevant_topk", "documents", f"SELECT sum(n_chars)::BIGINT AS chars, count(*)::BIGINT AS n FROM (SELECT * FROM {_DOCS} WHERE s IS NOT NULL ORDER BY s DESC, doc_id LIMIT 30)", measures=[{"ref": "n_chars.sum", "as": "chars"}, COUNT], filter={"text": {"relevant": {"query": "vec:7", "top_k": 30}}})
measured("relevant_topk_per", "documents", f"SELECT lang, sum(n_chars)::BIGINT AS chars, count(*)::BIGINT AS n FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY s DESC, doc_id) AS k FROM {_DOCS} WHERE s IS NOT NULL AND lang IS NOT NULL) WHERE k <= 5 GROUP BY 1", group_by=["lang"], measures=[{"ref": "n_chars.sum", "as": "chars"}, COUNT], filter={"text": {"relevant": {"query": "vec:7", "top_k": 5, "per": "lang"}}})
measured("relevant_topk_then_filter", "documents", f"SELECT count(*)::BIGINT AS n FROM (SELECT * FROM {_DOCS} WHERE s IS NOT NULL ORDER BY s DESC, doc_id LIMIT 100) WHERE lang = 'en'", measures=[COUNT], filter={"text": {"relevant": {"query": "vec:7", "top_k": 100}}, "lang": "en"})
measured("relevant_cross_grain", "labels", f"SELECT quality::BIGINT AS quality, count(*)::BIGINT AS n FROM labels WHERE doc_id IN (SELECT doc_id FROM {_DOCS} WHERE s IS NOT NULL ORDER BY s DESC, doc_id LIMIT 200) GROUP BY 1", group_by=["quality"], measures=[COUNT], filter={"document.text": {"relevant": {"query": "vec:7", "top_k": 200, "per": False}}})
add("relevant_select_siblings", lambda e: e.select("documents", columns=["lang"], filter={"text": {"relevant": {"query": "vec:7", "top_k": 20}}, "lang": "fr"}, page={"limit": 50}).df, f"SELECT doc_id, lang FROM (SELECT * FROM {_DOCS} WHERE lang = 'fr' AND s IS NOT NULL ORDER BY s DESC, doc_id LIMIT 20)")

# --- compare
VARIANTS = [{"label": "finished", "filter": {"o_orderstatus": "F"}}, {"label": "open", "filter": {"o_orderstatus": "O"}}]
_PAIR = "sum(o_totalprice) FILTER (WHERE o_orderstatus = 'F') AS f, sum(o_totalprice) FILTER (WHERE o_orderstatus = 'O') AS o"
add("compare_stitched", lambda e: e.compare("orders", variants=VARIANTS, measures=[REVENUE], group_by=["o_orderpriority"]).df, f"SELECT o_orderpriority, round(f, 2) AS revenue__finished, round(o, 2) AS revenue__open, round(o - f, 2) AS revenue__open__delta, round((o - f) / nullif(f, 0), 2) AS revenue__open__pct_change FROM (SELECT o_orderpriority, {_PAIR} FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY 1)")
add("compare_index", lambda e: e.compare("orders", variants=VARIANTS, measures=[REVENUE], baseline="open", derive=["index"], group_by=["customer.c_mktsegment"], order_by=[{"on": "revenue__finished", "dir": "desc"}], limit=3).df, f"SELECT c_mktsegment AS customer_c_mktsegment, round(f, 2) AS revenue__finished, round(o, 2) AS revenue__open, round(f / nullif(o, 0) * 100, 2) AS revenue__finished__index FROM (SELECT c_mktsegment, {_PAIR} FROM orders LEFT JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus IN ('F', 'O') GROUP BY 1) ORDER BY f DESC NULLS LAST, 1 LIMIT 3")
add("compare_three_variants", lambda e: e.compare("orders", variants=[*VARIANTS, {"label": "pending", "filter": {"o_orderstatus": "P"}}], measures=[COUNT], derive=["delta"], group_by=["o_orderpriority"]).df, "SELECT o_orderpriority, f::BIGINT AS n__finished, o::BIGINT AS n__open, p::BIGINT AS n__pending, round((o - f)::DOUBLE, 2) AS n__open__delta, round((p - f)::DOUBLE, 2) AS n__pending__delta FROM (SELECT o_orderpriority, nullif(count(*) FILTER (WHERE o_orderstatus = 'F'), 0) AS f, nullif(count(*) FILTER (WHERE o_orderstatus = 'O'), 0) AS o, nullif(count(*) FILTER (WHERE o_orderstatus = 'P'), 0) AS p FROM orders GROUP BY 1)")
add("compare_periods", lambda e: e.compare("events", variants=[{"label": "first_half", "filter": {"ts": {"lt": "2024-01-16"}}}, {"label": "second_half", "filter": {"ts": {"gte": "2024-01-16"}}}], measures=[{"ref": "event_value", "as": "worth"}], group_by=["event_type"]).df, "SELECT event_type, round(a, 2) AS worth__first_half, round(b, 2) AS worth__second_half, round(b - a, 2) AS worth__second_half__delta, round((b - a) / nullif(a, 0), 2) AS worth__second_half__pct_change FROM (SELECT event_type, sum(value) FILTER (WHERE ts < TIMESTAMP '2024-01-16') AS a, sum(value) FILTER (WHERE ts >= TIMESTAMP '2024-01-16') AS b FROM events GROUP BY 1)")
add("compare_churn", lambda e: e.compare("orders", variants=[{"label": "before", "filter": {"o_orderdate": {"lt": "1998-01-01"}}}, {"label": "after", "filter": {"o_orderdate": {"gte": "1998-01-01"}}}], measures=[REVENUE], group_by=["o_custkey"], derive=["delta"]).df, "SELECT o_custkey, round(a, 2) AS revenue__before, round(b, 2) AS revenue__after, round(b - a, 2) AS revenue__after__delta FROM (SELECT o_custkey, sum(o_totalprice) FILTER (WHERE o_orderdate < TIMESTAMP '1998-01-01') AS a, sum(o_totalprice) FILTER (WHERE o_orderdate >= TIMESTAMP '1998-01-01') AS b FROM orders GROUP BY 1)")
add("compare_per_variant_top", lambda e: e.compare("orders", variants=VARIANTS, measures=[REVENUE], group_by=["o_custkey"], derive=[], per_variant_top={"by": "revenue", "n": 5}).df, "WITH t AS (SELECT o_custkey, o_orderstatus AS s, sum(o_totalprice) AS r, row_number() OVER (PARTITION BY o_orderstatus ORDER BY sum(o_totalprice) DESC, o_custkey) AS k FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY 1, 2) SELECT o_custkey, round(max(r) FILTER (WHERE s = 'F'), 2) AS revenue__finished, round(max(r) FILTER (WHERE s = 'O'), 2) AS revenue__open FROM t WHERE k <= 5 GROUP BY 1")

# --- fetch
add("fetch_expand_to_one", lambda e: e.fetch("orders", e.reader.table("orders").select("o_orderkey"), expand=["customer.nation"]).select("o_orderkey", "o_totalprice", F.col("customer.c_name").alias("c_name"), F.col("customer.nation.n_name").alias("n_name")), "SELECT o_orderkey, o_totalprice, c_name, n_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey")
add("fetch_expand_has_many", lambda e: e.fetch("customer", e.reader.table("customer").select("c_custkey"), expand=["orders"]).select("c_custkey", F.size("orders").alias("n"), F.element_at(F.when(F.size("orders") > 0, F.col("orders")), 1)["o_orderkey"].alias("first_order")), "SELECT c_custkey, count(o_orderkey)::BIGINT AS n, min(o_orderkey) AS first_order FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
add("fetch_has_one", lambda e: e.fetch("documents", e.reader.table("documents").select("doc_id"), expand=["label_row"], filter={"lang": "de"}).select("doc_id", F.col("label_row.quality").alias("quality")), "SELECT doc_id, quality::BIGINT AS quality FROM documents LEFT JOIN labels USING (doc_id) WHERE lang = 'de'")
add("computed_metrics", lambda e: e.fetch("customer", e.reader.table("customer").select("c_custkey")).select("c_custkey", "order_count", "finished_orders", "last_order_at", "last_seen_at", "spent"), """
SELECT c_custkey, coalesce(n, 0)::BIGINT AS order_count, coalesce(f, 0)::BIGINT AS finished_orders, strftime(d, '%Y-%m-%d %H:%M:%S') AS last_order_at, strftime(greatest(d, t), '%Y-%m-%d %H:%M:%S') AS last_seen_at, round(s, 2) AS spent
FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, max(o_orderdate) AS d, sum(o_totalprice) AS s FROM orders GROUP BY 1) ON o_custkey = c_custkey LEFT JOIN (SELECT user_id, max(ts) AS t FROM events GROUP BY 1) ON user_id = c_custkey""")

# --- scope


def in_nation(entity: str) -> Any:
    """Customers of one nation; their orders and events by it; tables without tenants are declared so."""
    return {"customer": {"c_nationkey": 3}, "orders": {"o_orderstatus": ["F", "O"]}}.get(entity, TENANT_GLOBAL if entity in ("nation", "region", "part", "events") else None)


measured("scope_measure", "customer", "SELECT c_mktsegment, count(*)::BIGINT AS n FROM customer WHERE c_nationkey = 3 GROUP BY 1", scope=in_nation, group_by=["c_mktsegment"], measures=[COUNT])
measured("scope_join_on", "orders", "SELECT c_mktsegment AS customer_c_mktsegment, round(sum(o_totalprice), 2) AS revenue FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_nationkey = 3) ON o_custkey = c_custkey WHERE o_orderstatus IN ('F', 'O') GROUP BY 1", scope=in_nation, group_by=["customer.c_mktsegment"], measures=[REVENUE])
measured("scope_semijoin", "customer", "SELECT count(*)::BIGINT AS n FROM customer WHERE c_nationkey = 3 AND EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus IN ('F', 'O') AND o_totalprice > 200000)", scope=in_nation, measures=[COUNT], filter={"orders.o_totalprice": {"gt": 200000}})

# --- full text: by SQL for words that are their own stems and have no other forms in the tables; tests hold the rest against fixtures
add("fts_matches", lambda e: e.measure("documents", measures=[COUNT], group_by=["lang"], filter={"text": {"matches": 'stupid or "the the" -idiot'}}).df, None)
add("fts_lexical_rank", lambda e: e.select("documents", columns=["lang"], rank_by={"on": "text", "query": "stupid idiot loser", "method": "keyword", "limit": 20}).df, None)


def _word(word: str) -> str:
    return f"regexp_matches(text, '(^|[^A-Za-z0-9]){word}($|[^A-Za-z0-9])', 'i')"


add("fts_words", lambda e: e.measure("documents", measures=[COUNT], group_by=["doc_id"], filter={"text": {"matches": "stupid loser or idiot -stupid"}}).df, f"SELECT doc_id, count(*)::BIGINT AS n FROM documents WHERE ({_word('stupid')} AND {_word('loser')}) OR ({_word('idiot')} AND NOT {_word('stupid')}) GROUP BY 1")
add("fts_rank_words", lambda e: e.select("documents", columns=["lang"], rank_by={"on": "text", "query": "stupid idiot", "method": "keyword", "limit": 50}).df.drop("_snippet"), """
SELECT doc_id, lang, round(0.1::DOUBLE * len(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: w IN ('stupid', 'idiot'))), 2) AS _rank FROM documents ORDER BY 3 DESC, 1 LIMIT 50""")
add("select_snippets", lambda e: e.select("part", columns=["p_name", "_snippets"], filter={"p_name": {"contains": "RING"}}, page={"limit": 500}).df.select("p_partkey", "p_name", F.col("_snippets")[0]["snippet"].alias("snippet"), F.col("_snippets")[0]["match"]["start"].alias("first"), F.col("_snippets")[0]["match"]["end"].alias("stop")), "SELECT p_partkey, p_name, p_name AS snippet, (strpos(lower(p_name), 'ring') - 1)::BIGINT AS first, (strpos(lower(p_name), 'ring') + 3)::BIGINT AS stop FROM part WHERE p_name ILIKE '%ring%' ORDER BY p_partkey LIMIT 500")
add("window_global", lambda e: e.select("events", columns=["event_type"], window=[{"agg": a, "on": o, "as": n} for a, o, n in (("sum", "value", "total"), ("count", "*", "n"), ("count_distinct", "user_id", "users"), ("max", "value", "most"))], page={"limit": 50}).df, "SELECT event_id, event_type, round(sum(value) OVER (), 2) AS total, count(*) OVER ()::BIGINT AS n, (SELECT count(DISTINCT user_id) FROM events)::BIGINT AS users, round(max(value) OVER (), 2) AS most FROM events ORDER BY event_id LIMIT 50")


# --- what results know beside their rows


def told(name: str, schema: str, rows: Callable[[Engine], list[tuple]], sql: str, places: int = 2) -> None:
    """A query over answers that are no table: their numbers as rows."""
    add(name, lambda e: e.reader.spark.createDataFrame(rows(e), schema), sql, places=places)


def _totals(e: Engine) -> list[tuple]:
    out = []
    for name, options in (("orders", {"filter": {"o_totalprice": {"gt": 200000}}}), ("nation", {"page": {"limit": 25}}), ("customer", {"filter": {"orders.o_totalprice": {"gt": 400000}}, "page": {"limit": 500}})):
        page = e.select(name, **options)
        out.append((name, page.total(), page.has_more()))
    return out


told("select_totals", "entity string, total long, has_more boolean", _totals, """
SELECT entity, total::BIGINT AS total, total > page AS has_more FROM (
  SELECT 'orders' AS entity, count(*) AS total, 25 AS page FROM orders WHERE o_totalprice > 200000 UNION ALL SELECT 'nation', count(*), 25 FROM nation
  UNION ALL SELECT 'customer', count(*), 500 FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000))""")
told("measure_group_count", "n long", lambda e: [(e.measure("orders", measures=[COUNT], group_by=["o_custkey"], having={"n": {"gte": 15}}, limit=3).group_count(),)], "SELECT count(*)::BIGINT AS n FROM (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) >= 15)")


def _cited(e: Engine) -> list[tuple]:
    c = e.select("documents", filter={"text": {"relevant": {"query": "vec:7", "top_k": 20}}}, citation={"boundary": True}).citation()
    rows = [("exemplar", x["id"], x["similarity"], x["full_length"]) for x in c["exemplars"]]
    edge = [(k, c["boundary"][k]["id"], c["boundary"][k]["similarity"], c["boundary"][k]["full_length"]) for k in ("lowest_included", "highest_excluded")]
    return [*rows, *edge, ("count", c["match_count"], c["cutoff"], None)]


told("relevant_citation", "part string, id long, similarity double, full_length long", _cited, f"""
WITH s AS (SELECT doc_id, length(text) AS size, {SIMILARITY} AS s FROM documents JOIN embeddings ON doc_id = vec_id), r AS (SELECT *, row_number() OVER (ORDER BY s DESC, doc_id) AS n FROM s)
SELECT CASE WHEN n <= 4 THEN 'exemplar' WHEN n = 20 THEN 'lowest_included' ELSE 'highest_excluded' END AS part, doc_id AS id, round(s, 6) AS similarity, size::BIGINT AS full_length FROM r WHERE n <= 4 OR n IN (20, 21)
UNION ALL SELECT 'count', 20, round(s, 6), NULL FROM r WHERE n = 20""", places=6)
told("select_many", "entity string, id long, total long", lambda e: [(r["entity"], i, total) for r, (ids, total) in zip(_MANY, e.select_many(_MANY), strict=True) for i in ids], """
SELECT 'region' AS entity, r_regionkey::BIGINT AS id, (SELECT count(*) FROM region)::BIGINT AS total FROM region
UNION ALL (SELECT 'supplier', s_suppkey, (SELECT count(*) FROM supplier WHERE s_acctbal > 0) FROM supplier WHERE s_acctbal > 0 ORDER BY s_suppkey LIMIT 3)""")
_MANY = [{"entity": "region"}, {"entity": "supplier", "filter": {"s_acctbal": {"gt": 0}}, "page": {"limit": 3}}]
told("compare_warnings", "undefined long", lambda e: [(int(next(w for w in e.compare("orders", variants=[{"label": "none", "filter": {"o_orderstatus": "Z"}}, {"label": "all"}], measures=[COUNT], group_by=["o_custkey"]).warnings() if "divide" in w).split(" in ")[1].split(" ")[0]),)], "SELECT count(DISTINCT o_custkey)::BIGINT AS undefined FROM orders")
