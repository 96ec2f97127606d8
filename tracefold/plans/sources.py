"""Log sources and sinks over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracefold.contract import Edge, Field
from tracefold.functions.columns import cents, row_digest
from tracefold.plans.fixtures import EVENT_TYPES, LINE, LOG, PLACED_SQL, event_log, placed, read
from tracefold.plans.registry import query
from tracefold.session import scratch_path
from tracefold.sources import log as ops
from tracefold.sources.text import decode


@query("b1_origin", f"""
WITH {PLACED_SQL}
SELECT id, corr AS correlation_id, 0 AS step, CAST(NULL AS VARCHAR) AS causation_id, customer, status FROM placed""")
def origin(spark, sf):
    return placed(spark, sf).select("id", "correlation_id", "step", "causation_id", "payload.customer", "payload.status")


@query("b1_origins_many_edges", """
SELECT 'BigOrder' AS edge, o_orderkey AS correlation_id FROM orders WHERE o_totalprice > 100000
UNION ALL SELECT 'OpenOrder', o_orderkey FROM orders WHERE o_orderstatus = 'O'""")
def origins(spark, sf):
    from tracefold.plans.fixtures import PLACED
    orders = read(spark, sf, "orders")
    logs = ops.origins(orders, {
        PLACED.spread("BigOrder"): F.col("o_totalprice") > 100000,
        PLACED.spread("OpenOrder"): F.col("o_orderstatus") == "O",
    }, correlation=F.col("o_orderkey"), source_key=F.col("o_orderkey"), ts=F.col("o_orderdate"))
    return logs["BigOrder"].unionByName(logs["OpenOrder"]).select("edge", "correlation_id")


WEIGHT = Edge("Weight", "Weight", "Weight of a segment", {
    "segment": Field("utf8", "Segment", "Market segment", nullable=False),
    "weight": Field("uint8", "Weight", "Weight", nullable=False),
})


@query("b2_literal", """
SELECT c_mktsegment AS segment, CAST(sum(CASE c_mktsegment WHEN 'MACHINERY' THEN 3 ELSE 1 END) AS BIGINT) AS weight
FROM customer WHERE c_mktsegment IN ('MACHINERY', 'HOUSEHOLD') GROUP BY 1""")
def literal(spark, sf):
    weights = ops.literal(spark, WEIGHT, [{"segment": "MACHINERY", "weight": 3}, {"segment": "HOUSEHOLD", "weight": 1}])
    people = read(spark, sf, "customer").select(F.col("c_mktsegment").alias("segment"))
    return people.join(weights, "segment").groupBy("segment").agg(F.sum("weight").alias("weight"))


def written_log(spark, sf) -> str:
    """The event log as a table in the shared folder."""
    path = scratch_path(spark, "log")
    ops.append_log(event_log(spark, sf), path)
    return path


@query("b3_read_log", f"""
WITH {LOG}
SELECT edge, count(*) AS instances, CAST(sum(step) AS BIGINT) AS steps, CAST(sum(k) AS BIGINT) AS k FROM log WHERE edge IN ('signup', 'purchase') GROUP BY 1""")
def read_log(spark, sf):
    log = ops.read_log(spark, written_log(spark, sf), edges=["signup", "purchase"])
    return log.groupBy("edge").agg(F.count(F.lit(1)).alias("instances"), F.sum("step").alias("steps"),
                                   F.sum("payload.k").alias("k"))


@query("b4_append_log", f"""
WITH {LOG}
SELECT edge, count(*) AS instances, min(id) AS first_id, max(id) AS last_id FROM log GROUP BY 1""")
def append_log(spark, sf):
    path = scratch_path(spark, "log")
    log = event_log(spark, sf)
    ops.append_log(log.filter(F.dayofmonth("ts") <= 15), path)
    ops.append_log(log.filter(F.dayofmonth("ts") > 15), path)
    return ops.read_log(spark, path).groupBy("edge").agg(
        F.count(F.lit(1)).alias("instances"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


@query("b5_dedupe", "SELECT event_id AS id, event_type AS edge FROM events")
def dedupe(spark, sf):
    rows = read(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("edge"))
    return ops.dedupe(rows.unionByName(rows.filter(F.col("id") % 10 == 0)))


@query("b6_unified", """
SELECT event_type AS edge, count(*) AS instances, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY 1
UNION ALL SELECT 'Placed', count(*), CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) FROM orders
UNION ALL SELECT 'Line', count(*), CAST(sum(CAST(round(l_quantity * 100) AS BIGINT)) AS BIGINT) FROM lineitem""")
def unified(spark, sf):
    lines = read(spark, sf, "lineitem")
    key = row_digest(lines.columns)
    line_log = ops.origin(lines, LINE, F.col("l_orderkey"), key, F.col("l_shipdate"), node="origin_line")
    whole = ops.unified([event_log(spark, sf).drop("user_id"), placed(spark, sf), line_log])
    pick = lambda name: F.try_variant_get("payload", f"$.{name}", "double")
    amount = F.coalesce(pick("value"), pick("price"), pick("quantity"))
    return whole.groupBy("edge").agg(F.count(F.lit(1)).alias("instances"), F.sum(cents(amount)).alias("total"))


COUNTER = Edge("Counter", "Counter", "JSON counter", {"k": Field("uint8", "K", "Counter", nullable=False)})


@query("b7_decode", """
SELECT event_id AS id, CASE WHEN event_id % 17 = 0 THEN NULL ELSE CAST(regexp_extract(props, '[0-9]+') AS INT) END AS k,
       CASE WHEN event_id % 17 = 0 THEN 1 ELSE 0 END AS faults FROM events""")
def decode_props(spark, sf):
    raw = F.when(F.col("event_id") % 17 == 0, '{"k": null}').otherwise(F.col("props"))
    rows = decode(read(spark, sf, "events").withColumn("raw", raw), "raw", COUNTER)
    return rows.select(F.col("event_id").alias("id"), F.col("payload.k").cast("int").alias("k"),
                       F.size("violations").alias("faults"))


NOTED = Edge("Noted", "Noted", "A noted event", {"k": Field("uint8", "K", "Counter", nullable=False)})


@query("b8_with_envelope", f"""
WITH {LOG}
SELECT sha256(id || '|note|Noted|0') AS id, corr AS correlation_id, CAST(id AS VARCHAR) AS causation_id, step + 1 AS step,
       CAST(user_id AS VARCHAR) AS sub, k FROM log""")
def with_envelope(spark, sf):
    rows = ops.with_envelope(event_log(spark, sf), F.struct("payload.k"), "note", NOTED)
    return rows.select("id", "correlation_id", "causation_id", "step", "identity.sub", "payload.k")
