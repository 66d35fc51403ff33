"""Parquet tables as entities, and the semantic model over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.plans.model import Atomic, Computed, Cumulative, Derived, Eav, Entity, Field, MeasureDef, Ratio, Rel, SemanticModel

Load = Callable[[SparkSession], DataFrame]


def parquet(folder: str, name: str) -> Load:
    return lambda spark: spark.read.parquet(f"{folder}/{name}.parquet")


def registered(registrations: DataFrame, catalog: dict[str, Entity]) -> list[Entity]:
    """Entities of a code catalog that a registration table (name, table_key, enabled, sort_order) turns on, in its order."""
    rows = registrations.where("enabled").orderBy(F.col("sort_order").asc_nulls_last(), "name").collect()
    return [catalog[r["table_key"]] for r in rows if r["table_key"] in catalog]


def distinct_values(df: DataFrame, column: str, most: int = 1000) -> tuple[str, ...]:
    """Declared options of a field from its data; a column with more values than ``most`` has none."""
    found = [r[0] for r in df.select(F.col(column).cast("string")).where(F.col(column).isNotNull()).distinct().limit(most + 1).collect()]
    return tuple(sorted(found)) if len(found) <= most else ()


def _money(name: str, **more: object) -> Field:
    return Field(name, "number", "measure", ("sum", "avg", "min", "max"), **more)


def _rate(name: str) -> Field:
    return Field(name, "number", "measure", ("avg", "min", "max"), "non")


def _balance(name: str) -> Field:
    return Field(name, "number", "measure", ("sum", "avg", "min", "max"), "semi")


def part_values(folder: str) -> Load:
    """Sparse typed side table: brand and size of the parts whose key isn't divisible by five."""

    def load(spark: SparkSession) -> DataFrame:
        rows = parquet(folder, "part")(spark).where("p_partkey % 5 <> 0")
        own = rows.select(
            F.col("p_partkey").alias("entity_id"),
            F.lit("part").alias("entity_type"),
            F.explode(F.array(F.struct(F.lit("brand").alias("d"), F.col("p_brand").alias("t"), F.lit(None).cast("double").alias("n")), F.struct(F.lit("size").alias("d"), F.lit(None).cast("string").alias("t"), F.col("p_size").cast("double").alias("n")))).alias("x"),
        )
        return own.select("entity_id", "entity_type", F.col("x.d").alias("field_definition_id"), F.col("x.t").alias("value_text"), F.col("x.n").alias("value_number"), F.lit(None).cast("timestamp_ntz").alias("value_date"), F.lit(None).cast("boolean").alias("value_boolean"))

    return load


def customer_values(folder: str) -> Load:
    """JSON side table with history: a tier by segment that holds, and closed rows that no longer do."""

    def load(spark: SparkSession) -> DataFrame:
        rows = parquet(folder, "customer")(spark).where("c_custkey % 3 <> 0")
        now = rows.select(F.col("c_custkey").alias("entity_id"), F.lit("customer").alias("entity_type"), F.lit("score").alias("field_definition_id"), (F.col("c_custkey") % 10).cast("string").alias("value"), F.lit(None).cast("timestamp_ntz").alias("valid_to"))
        old = now.withColumn("value", F.lit("-1")).withColumn("valid_to", F.lit("2020-01-01").cast("timestamp_ntz"))
        return now.union(old)

    return load


def entities(folder: str) -> list[Entity]:
    """FIXTURES: keys, relations and tags of the driver's tables."""
    load = lambda name: parquet(folder, name)
    return [
        Entity("region", load("region"), "r_regionkey", (Field("r_regionkey", "integer"), Field("r_name", key_order=1)), (Rel("nations", "has_many", "nation", "n_regionkey"),)),
        Entity("nation", load("nation"), "n_nationkey", (Field("n_nationkey", "integer"), Field("n_name", key_order=1), Field("n_regionkey", "integer")), (Rel("region", "belongs_to", "region", "n_regionkey"), Rel("customers", "has_many", "customer", "c_nationkey"), Rel("suppliers", "has_many", "supplier", "s_nationkey"))),
        Entity(
            "customer", load("customer"), "c_custkey",
            (Field("c_custkey", "integer"), Field("c_name", key_order=1), Field("c_nationkey", "integer"), _balance("c_acctbal"), Field("c_mktsegment", key_order=2)),
            (Rel("nation", "belongs_to", "nation", "c_nationkey"), Rel("orders", "has_many", "orders", "o_custkey"), Rel("events", "has_many", "events", "user_id")),
            eav=Eav(customer_values(folder), {"score": ("score", Field("score", "number", "measure", ("avg", "min", "max"), "non"))}, "json", "customer"),
            computed=(
                Computed("order_count", "count", (("orders", "*"),)),
                Computed("finished_orders", "count", (("orders", "*"),), {"o_orderstatus": "F"}),
                Computed("last_order_at", "max", (("orders", "o_orderdate"),), type="datetime"),
                Computed("last_seen_at", "max", (("orders", "o_orderdate"), ("events", "ts")), type="datetime"),
                Computed("spent", "sum", (("orders", "o_totalprice"),)),
            ),
        ),
        Entity("supplier", load("supplier"), "s_suppkey", (Field("s_suppkey", "integer"), Field("s_name"), Field("s_nationkey", "integer"), _balance("s_acctbal")), (Rel("nation", "belongs_to", "nation", "s_nationkey"), Rel("lineitems", "has_many", "lineitem", "l_suppkey"))),
        Entity(
            "part", load("part"), "p_partkey",
            (Field("p_partkey", "integer"), Field("p_name"), Field("p_brand"), Field("p_type"), Field("p_size", "integer"), _rate("p_retailprice")),
            (Rel("lineitems", "has_many", "lineitem", "l_partkey"),),
            eav=Eav(part_values(folder), {"brand": ("brand", Field("brand", "enum")), "size": ("size", Field("size", "number", "measure", ("sum", "avg", "min", "max")))}, "typed", "part"),
        ),
        Entity("orders", load("orders"), "o_orderkey", (Field("o_orderkey", "integer"), Field("o_custkey", "integer"), Field("o_orderstatus"), _money("o_totalprice"), Field("o_orderdate", "datetime", time=True), Field("o_orderpriority")), (Rel("customer", "belongs_to", "customer", "o_custkey"), Rel("lineitems", "has_many", "lineitem", "l_orderkey"))),
        Entity(
            "lineitem", load("lineitem"), None,
            (Field("l_orderkey", "integer"), Field("l_partkey", "integer"), Field("l_suppkey", "integer"), Field("l_linenumber", "integer"), _money("l_quantity"), _money("l_extendedprice"), _rate("l_discount"), _rate("l_tax"), Field("l_returnflag"), Field("l_linestatus"), Field("l_shipdate", "datetime", time=True)),
            (Rel("order", "belongs_to", "orders", "l_orderkey"), Rel("part", "belongs_to", "part", "l_partkey"), Rel("supplier", "belongs_to", "supplier", "l_suppkey")),
        ),
        Entity("events", load("events"), "event_id", (Field("event_id", "integer"), Field("ts", "datetime", time=True), Field("user_id", "integer"), Field("event_type"), _money("value"), Field("props", "json")), (Rel("user", "belongs_to", "customer", "user_id"),)),
        Entity("documents", load("documents"), "doc_id", (Field("doc_id", "integer"), Field("text", embedding="embedding_row.embedding"), Field("lang", "enum"), Field("source", "enum"), Field("n_chars", "integer", "measure", ("sum", "avg", "min", "max"))), (Rel("label_row", "has_one", "labels", "doc_id"), Rel("embedding_row", "has_one", "embeddings", "vec_id"))),
        Entity("labels", load("labels"), "doc_id", (Field("doc_id", "integer"), Field("quality", "integer"), Field("toxic", "integer")), (Rel("document", "belongs_to", "documents", "doc_id"),)),
        Entity("embeddings", load("embeddings"), "vec_id", (Field("vec_id", "integer"), Field("embedding", "vector"), Field("label", "integer"))),
    ]


MEASURES: list[MeasureDef] = [
    Atomic("orders_count", "orders", "count"),
    Atomic("net_revenue", "lineitem", "sum", expr={"op": "*", "left": {"on": "l_extendedprice"}, "right": {"op": "-", "left": {"value": 1}, "right": {"on": "l_discount"}}}),
    Atomic("parts_list_value", "lineitem", "sum", expr={"op": "*", "left": {"on": "l_quantity"}, "right": {"on": "part.p_retailprice"}}),
    Atomic("urgent_revenue", "orders", "sum", "o_totalprice", where={"o_orderpriority": "1-URGENT"}),
    Atomic("event_value", "events", "sum", "value"),
    Ratio("avg_order_value", "o_totalprice.sum", "orders_count"),
    Ratio("urgent_share", "urgent_revenue", "o_totalprice.sum"),
    Derived("revenue_minus_events", {"op": "-", "left": {"ref": "o_totalprice.sum"}, "right": {"ref": "event_value"}}),
    Derived("half_revenue", {"op": "/", "left": {"ref": "o_totalprice.sum"}, "right": {"value": 2}}),
    Cumulative("running_revenue", "o_totalprice.sum"),
]


def model(folder: str, only: Sequence[str] | None = None) -> SemanticModel:
    return SemanticModel.build([e for e in entities(folder) if only is None or e.name in only], MEASURES)
