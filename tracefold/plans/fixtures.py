"""The tables seen as typed causal logs, and the same views as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefold.contract import Edge, Field, Many, Relation
from tracefold.functions.ordered import Ordered
from tracefold.sources.log import identity, origin

# -- contracts --------------------------------------------------------------

VALUE = Field("f64", "Value", "Amount of the event", nullable=False, measure="quantitative")
K = Field("uint8", "K", "Small counter", nullable=False, measure="ordinal")
EVENT_TYPES = ("click", "error", "purchase", "signup", "view")
EVENT = Edge("Event", "Event", "One user event", {"value": VALUE, "k": K})
EVENTS = {t: EVENT.spread(t) for t in EVENT_TYPES}

PERSON = Edge("Person", "Person", "A customer", {
    "id": Field("uint32", "Id", "Customer key", nullable=False, format="id", source_key="c_custkey"),
    "name": Field("utf8", "Name", "Customer name", nullable=False, min_length=1, max_length=200, source_key="c_name"),
    "balance": Field("f64", "Balance", "Account balance", nullable=False, source_key="c_acctbal"),
    "segment": Field("utf8", "Segment", "Market segment", nullable=False, source_key="c_mktsegment"),
}, index="id")

PLACED = Edge("Placed", "Placed", "A placed order", {
    "order": Field("uint32", "Order", "Order key", nullable=False, source_key="o_orderkey"),
    "customer": Field("uint32", "Customer", "Who ordered", nullable=False, source_key="o_custkey",
                      relation=Relation("Person", "id", "many:1")),
    "status": Field("utf8", "Status", "Order status", nullable=False, source_key="o_orderstatus"),
    "price": Field("f64", "Price", "Order total", nullable=False, source_key="o_totalprice"),
}, index="order")

LINE = Edge("Line", "Line", "An order line", {
    "order": Field("uint32", "Order", "Order key", nullable=False, source_key="l_orderkey"),
    "number": Field("uint8", "Number", "Line number", nullable=False, source_key="l_linenumber"),
    "quantity": Field("f64", "Quantity", "Quantity", nullable=False, source_key="l_quantity"),
})

SIZED = Edge("Sized", "Sized", "A part with a size that grows by birthdays", {
    "size": Field("uint8", "Size", "Part size", nullable=False, min=0, max=150, source_key="p_size"),
})

ORDER_WITH_LINES = Edge("OrderWithLines", "Order", "An order and its lines", {
    "order": Field("uint32", "Order", "Order key", nullable=False, source_key="o_orderkey"),
    "lines": Many(Edge("LineItem", "Line", "A line", {
        "quantity": Field("f64", "Quantity", "Quantity", nullable=False, min=0, max=49),
    })),
})


def read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


# -- views ------------------------------------------------------------------

def event_log(spark: SparkSession, sf: str) -> DataFrame:
    """``events`` as one causal chain per user and day."""
    hashes = F.create_map(*[x for t in EVENT_TYPES for x in (F.lit(t), F.lit(EVENTS[t].schema_hash))])
    rows = read(spark, sf, "events").select(
        F.col("event_id").alias("id"),
        (F.col("user_id") * 100 + F.dayofmonth("ts")).alias("correlation_id"),
        "ts", "user_id", F.col("event_type").alias("edge"),
        F.struct("value", F.get_json_object("props", "$.k").cast("smallint").alias("k")).alias("payload"))
    chained = Ordered(rows, ["correlation_id"], ["id"]).numbered("step", {"causation_id": "id"}).df
    return chained.select(
        "id", "correlation_id", "causation_id", "ts", "step",
        F.concat(F.lit("emit_"), "edge").alias("node"), F.lit("1").alias("impl_version"),
        identity(F.col("user_id"), scopes=F.array(F.concat(F.lit("read:Event:"), "edge"))).alias("identity"),
        hashes[F.col("edge")].alias("schema_hash"), "edge", "payload", "user_id")


LOG = """log AS (
  SELECT event_id AS id, user_id * 100 + day(ts) AS corr,
         lag(event_id) OVER w AS cause, row_number() OVER w - 1 AS step,
         event_type AS edge, ts, value, CAST(regexp_extract(props, '[0-9]+') AS INT) AS k, user_id
  FROM events WINDOW w AS (PARTITION BY user_id, day(ts) ORDER BY event_id))"""


def placed(spark: SparkSession, sf: str) -> DataFrame:
    """``orders`` as root instances, one correlation per order."""
    return origin(read(spark, sf, "orders"), PLACED, F.col("o_orderkey"), F.col("o_orderkey"), F.col("o_orderdate"),
                  node="origin_placed")


PLACED_SQL = """placed AS (
  SELECT sha256(o_orderkey || '|origin_placed|Placed|0') AS id, o_orderkey AS corr, o_custkey AS customer,
         o_orderstatus AS status, o_totalprice AS price, o_orderdate AS ts FROM orders)"""


def sized(spark: SparkSession, sf: str) -> DataFrame:
    """``part`` as root instances carrying a size."""
    ts = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    return origin(read(spark, sf, "part"), SIZED, F.col("p_partkey"), F.col("p_partkey"), ts, node="origin_sized")


SIZED_SQL = """sized AS (
  SELECT sha256(p_partkey || '|origin_sized|Sized|0') AS id, p_partkey AS corr, p_size AS size FROM part)"""


def person(spark: SparkSession, sf: str) -> DataFrame:
    """``customer`` with its nation and region nested; Spark sizes the lookups itself."""
    nation = read(spark, sf, "nation").join(
        read(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return (read(spark, sf, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
            .select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"),
                    F.struct(F.col("n_name").alias("name"), F.col("r_name").alias("region")).alias("nation")))


PERSON_SQL = """person AS (
  SELECT c_custkey AS id, c_name AS name, n_name AS nation_name, r_name AS region
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""

# Lines have no key; these columns together order them within an order.
LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate"]
LINE_ORDER_SQL = ", ".join(LINE_ORDER)
