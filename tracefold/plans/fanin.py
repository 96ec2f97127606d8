"""Readiness and lookups over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracefold.contract import Edge, Field
from tracefold.operators import fanin as ops
from tracefold.plans.fixtures import EVENT, LINE_ORDER, LOG, event_log, placed, read
from tracefold.plans.registry import query

SMALL = Edge("Small", "Small event", "An event of at most 100", {
    "value": Field("f64", "Value", "Amount", nullable=False, max=100), "k": EVENT.fields["k"]})


@query("d1_latest", f"""
WITH {LOG}
SELECT corr AS correlation_id, edge, max(step) AS step, max_by(id, step) AS id, max_by(k, step) AS k FROM log GROUP BY 1, 2""")
def latest(spark, sf):
    return ops.latest(event_log(spark, sf)).select("correlation_id", "edge", "step", "id", "payload.k")


@query("d2_every", f"""
WITH {LOG}
SELECT corr AS correlation_id, max_by(id, step) FILTER (edge = 'signup') AS signup_id, max_by(id, step) FILTER (edge = 'purchase') AS purchase_id,
       max_by(value, step) FILTER (edge = 'purchase') AS value, max(step) AS step, max_by(id, step) AS causation_id
FROM log WHERE edge IN ('signup', 'purchase') GROUP BY 1 HAVING count(DISTINCT edge) = 2""")
def every(spark, sf):
    return ops.every(event_log(spark, sf), ["signup", "purchase"]).select(
        "correlation_id", F.col("signup.id").alias("signup_id"), F.col("purchase.id").alias("purchase_id"),
        "purchase.payload.value", "step", "causation_id")


FIRE = f"""
WITH {LOG}, fire AS (
  SELECT corr, greatest(min(step) FILTER (edge = 'signup'), min(step) FILTER (edge = 'purchase')) AS f
  FROM log WHERE edge IN ('signup', 'purchase') GROUP BY 1 HAVING count(DISTINCT edge) = 2)
SELECT corr AS correlation_id, f AS step, max_by(id, step) FILTER (edge = 'signup') AS signup_id,
       max_by(id, step) FILTER (edge = 'purchase') AS purchase_id, max_by(k, step) FILTER (edge = 'purchase') AS k
FROM log JOIN fire USING (corr) WHERE step <= f GROUP BY 1, 2"""


@query("d3_every_fire", FIRE)
def every_fire(spark, sf):
    return ops.every(event_log(spark, sf), ["signup", "purchase"], at="fire").select(
        "correlation_id", "step", F.col("signup.id").alias("signup_id"), F.col("purchase.id").alias("purchase_id"),
        "purchase.payload.k")


@query("d4_not_ready", f"""
WITH {LOG}
SELECT corr AS correlation_id, CASE WHEN count(*) FILTER (edge = 'signup') = 0 THEN 'signup' ELSE 'purchase' END AS missing
FROM log WHERE edge IN ('signup', 'purchase') GROUP BY 1 HAVING count(DISTINCT edge) = 1""")
def not_ready(spark, sf):
    return ops.not_ready(event_log(spark, sf), ["signup", "purchase"]).select(
        "correlation_id", F.array_join("missing", ",").alias("missing"))


@query("d4_orders_without_lines", """
SELECT o_orderkey AS correlation_id, 'Line' AS missing FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)""")
def orders_without_lines(spark, sf):
    lines = read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("correlation_id"), F.lit("Line").alias("edge"))
    both = placed(spark, sf).select("correlation_id", "edge").unionByName(lines)
    return ops.not_ready(both, ["Placed", "Line"]).select("correlation_id", F.array_join("missing", ",").alias("missing"))


@query("d5_every_checked", f"""
WITH {LOG}, bag AS (
  SELECT corr, max_by(value, step) FILTER (edge = 'signup') AS s, max_by(value, step) FILTER (edge = 'purchase') AS p
  FROM log WHERE edge IN ('signup', 'purchase') GROUP BY 1 HAVING count(DISTINCT edge) = 2)
SELECT corr AS correlation_id, s <= 100 AND p <= 100 AS ok,
       nullif(concat_ws(',', CASE WHEN s > 100 THEN 'signup.value' END, CASE WHEN p > 100 THEN 'purchase.value' END), '') AS reason
FROM bag""")
def every_checked(spark, sf):
    ok, failed = ops.every_checked(event_log(spark, sf), {"signup": SMALL, "purchase": SMALL}, "domain")
    reason = F.array_join(F.transform("payload.reason", lambda v: v["path"]), ",")
    return ok.select("correlation_id", F.lit(True).alias("ok"), F.lit(None).cast("string").alias("reason")).unionByName(
        failed.select("correlation_id", F.lit(False).alias("ok"), reason.alias("reason")))


@query("d6_any_of", f"""
WITH {LOG}
SELECT corr AS correlation_id, min_by(edge, step) AS edge, min_by(id, step) AS id, min(step) AS step
FROM log WHERE edge IN ('click', 'view') GROUP BY 1""")
def any_of(spark, sf):
    return ops.any_of(event_log(spark, sf), ["click", "view"]).select("correlation_id", "edge", "id", "step")


@query("d7_first", f"""
WITH {LOG}
SELECT corr AS correlation_id, min_by(id, step) AS id, min(step) AS step FROM log WHERE edge = 'purchase' GROUP BY 1""")
def first(spark, sf):
    return ops.first(event_log(spark, sf), "purchase").select("correlation_id", "id", "step")


@query("d7_each", f"""
WITH {LOG}
SELECT corr AS correlation_id, id, step FROM log WHERE edge = 'purchase'""")
def each(spark, sf):
    return ops.each(event_log(spark, sf), "purchase").select("correlation_id", "id", "step")


@query("d8_lookup", """
SELECT o_orderkey AS order_key, c_name AS name, CAST(NULL AS VARCHAR) AS reason FROM orders JOIN customer ON c_custkey = o_custkey AND c_acctbal >= 0
UNION ALL SELECT o_orderkey, NULL, 'no match for o_custkey=' || o_custkey FROM orders
WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0)""")
def lookup(spark, sf):
    solvent = read(spark, sf, "customer").filter(F.col("c_acctbal") >= 0).select("c_custkey", "c_name")
    matched, failed = ops.lookup(read(spark, sf, "orders").select("o_orderkey", "o_custkey"), "o_custkey", solvent, "c_custkey")
    return matched.select(F.col("o_orderkey").alias("order_key"), F.col("c_name").alias("name"),
                          F.lit(None).cast("string").alias("reason")).unionByName(
        failed.select(F.col("input.o_orderkey").alias("order_key"), F.lit(None).cast("string").alias("name"), "reason"))


@query("d8_lookup_many", """
SELECT c_custkey AS id, coalesce(string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey), '') AS orders
FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1""")
def lookup_many(spark, sf):
    rows = ops.lookup_many(read(spark, sf, "customer").select("c_custkey"), "c_custkey", read(spark, sf, "orders"),
                           "o_custkey", ["o_orderkey"], F.col("o_orderkey").cast("string"), "orders")
    return rows.select(F.col("c_custkey").alias("id"), F.array_join("orders", ",").alias("orders"))


@query("d9_lookup_via", """
SELECT p_partkey AS part, s_name AS supplier FROM part JOIN (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) ON p_partkey = l_partkey
JOIN supplier ON s_suppkey = l_suppkey""")
def lookup_via(spark, sf):
    rows = ops.lookup_via(read(spark, sf, "part").select("p_partkey"), "p_partkey", read(spark, sf, "lineitem"),
                          "l_partkey", "l_suppkey", read(spark, sf, "supplier").select("s_suppkey", "s_name"), "s_suppkey")
    return rows.select(F.col("p_partkey").alias("part"), F.col("s_name").alias("supplier"))


@query("d10_pulse", f"""
WITH {LOG} SELECT id, step + 1 AS pulse FROM log""")
def pulse(spark, sf):
    log = event_log(spark, sf).select("id", "causation_id")
    deps = log.filter(F.col("causation_id").isNotNull()).select("id", F.col("causation_id").alias("parent"))
    return ops.pulse(log.select("id"), deps)


@query("d10_pulse_diamond", f"""
WITH {LOG}, ends AS (SELECT corr, max(step) AS last FROM log GROUP BY 1)
SELECT CAST(id AS VARCHAR) AS id, step + 1 AS pulse FROM log
UNION ALL SELECT 'join-' || corr, CASE WHEN last = 0 THEN 2 ELSE last + 2 END FROM ends""")
def pulse_diamond(spark, sf):
    """A closing instance per correlation that needs its first and its last row."""
    log = event_log(spark, sf).select(F.col("id").cast("string").alias("id"), F.col("causation_id").cast("string").alias("parent"),
                                      "correlation_id", "step")
    name = F.concat(F.lit("join-"), F.col("correlation_id").cast("string"))
    tips = log.groupBy("correlation_id").agg(F.min_by("id", "step").alias("a"), F.max_by("id", "step").alias("b"))
    joins = tips.select(name.alias("id"), F.explode(F.array_distinct(F.array("a", "b"))).alias("parent"))
    deps = log.filter(F.col("parent").isNotNull()).select("id", "parent").unionByName(joins)
    return ops.pulse(log.select("id").unionByName(tips.select(name.alias("id"))), deps)


@query("d11_transitive_gaps", f"""
WITH {LOG}
SELECT DISTINCT corr AS correlation_id FROM log WHERE edge = 'purchase' AND corr NOT IN (SELECT corr FROM log WHERE edge = 'signup')
UNION ALL SELECT l_orderkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)""")
def transitive_gaps(spark, sf):
    lines = read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("correlation_id"), F.lit("Line").alias("edge"))
    both = placed(spark, sf).select("correlation_id", "edge").unionByName(lines)
    return ops.transitive_gaps(event_log(spark, sf), "signup", "purchase").unionByName(
        ops.transitive_gaps(both, "Placed", "Line"))
