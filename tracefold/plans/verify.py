"""Checks and generated cases over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracefold.contract import Edge, Field
from tracefold.operators import verify as ops
from tracefold.operators.conform import is_valid
from tracefold.operators.nodes import Node
from tracefold.plans.fixtures import SIZED, placed, read, sized
from tracefold.plans.nodes import BIRTHDAY
from tracefold.plans.registry import query

BROKEN = Node("birthday", SIZED, SIZED, lambda p: {"size": p["size"] + F.when(p["size"] > 25, 2).otherwise(1)})


@query("h1_expect", "SELECT o_orderkey AS order_key, CASE WHEN o_orderstatus = 'F' THEN 'Pass' ELSE 'Fail' END AS verdict FROM orders")
def expect(spark, sf):
    rows = ops.expect(placed(spark, sf), {"status": "F"}, column="payload")
    return rows.select(F.col("correlation_id").alias("order_key"), "verdict")


@query("h1_expect_full", """
SELECT c_custkey AS id, CASE WHEN c_nationkey = 7 AND c_mktsegment = 'MACHINERY' THEN 'Pass' ELSE 'Fail' END AS verdict FROM customer""")
def expect_full(spark, sf):
    rows = read(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.struct(
        F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment")).alias("payload"))
    return ops.expect(rows, {"nation": 7, "segment": "MACHINERY"}, "full", "payload").select("id", "verdict")


@query("h2_run_examples", """
SELECT p_partkey AS part, p_size + 1 AS got, p_size + 2 AS expected FROM part WHERE p_partkey % 10 = 0""")
def run_examples(spark, sf):
    wanted = F.col("p_size") + F.when(F.col("p_partkey") % 10 == 0, 2).otherwise(1)
    examples = read(spark, sf, "part").select(
        F.col("p_partkey").alias("part"), F.struct(F.col("p_size").alias("size")).alias("given"),
        F.struct(wanted.alias("size")).alias("expect"))
    return ops.run_examples(BIRTHDAY, examples).select("part", F.col("got.size").alias("got"), F.col("expect.size").alias("expected"))


TWIN = Edge("Twin", "Twin", "A made-up customer", {
    "age": Field("uint8", "Age", "Age", nullable=False, min=18, max=99),
    "score": Field("f64", "Score", "Score", nullable=False, min=-1, max=1),
    "segment": Field("utf8", "Segment", "Segment", nullable=False, enum=("A", "B", "C")),
    "nickname": Field("utf8", "Nickname", "Nickname", nullable=True, min_length=2, max_length=8),
    "active": Field("bool", "Active", "Active"),
    "home": Edge("Home", "Home", "Home", {"floor": Field("int8", "Floor", "Floor", nullable=False, min=-2, max=40)}),
})


@query("h3_generate", "SELECT c_custkey AS id, true AS in_domain FROM customer")
def generate(spark, sf):
    """A made-up twin per customer; the SQL states that all meet the contract."""
    rows = ops.generate_for(read(spark, sf, "customer"), "c_custkey", TWIN, seed=7)
    return rows.select(F.col("c_custkey").alias("id"),
                       F.coalesce(is_valid(rows, TWIN, "domain", "generated"), F.lit(False)).alias("in_domain"))


@query("h4_boundaries", """
SELECT size, count(*) AS instances, size + 1 <= 150 AS holds FROM (SELECT p_size AS size FROM part UNION ALL VALUES (0), (150)) GROUP BY 1""")
def boundaries(spark, sf):
    """The part sizes with the contract's boundary values added: which still fit after a birthday?"""
    cases = sized(spark, sf).select("payload.size").unionByName(ops.boundary_rows(spark, SIZED))
    return cases.groupBy(F.col("size").cast("int").alias("size")).agg(F.count(F.lit(1)).alias("instances")).withColumn(
        "holds", F.col("size") + 1 <= ops.bounds(SIZED.fields["size"])[1])


@query("h5_check_property", "SELECT p_partkey AS part, p_size AS size, p_size + 2 AS output FROM part WHERE p_size > 25")
def check_property(spark, sf):
    rows = ops.check_property(BROKEN, sized(spark, sf), lambda p, out: out["size"] == p["size"] + 1)
    return rows.select(F.col("correlation_id").alias("part"), "payload.size", F.col("output.size").alias("output"))


@query("h6_compare_impls", """
SELECT l_orderkey AS order_key, CAST(floor(l_extendedprice * (1 - l_discount)) AS BIGINT) AS a, CAST(round(l_extendedprice * (1 - l_discount)) AS BIGINT) AS b
FROM lineitem WHERE floor(l_extendedprice * (1 - l_discount)) <> round(l_extendedprice * (1 - l_discount))""")
def compare_impls(spark, sf):
    net = Edge("Net", fields={"net": Field("f64", "Net", "Net", nullable=False)})
    whole = Edge("Whole", fields={"net": Field("uint32", "Net", "Whole net", nullable=False)})
    down = Node("down", net, whole, lambda p: {"net": F.floor(p["net"])})
    near = Node("near", net, whole, lambda p: {"net": F.round(p["net"]).cast("bigint")})
    rows = read(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("order_key"),
        F.struct((F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net")).alias("payload"))
    return ops.compare_impls(down, near, rows).select("order_key", F.col("first.net").alias("a"), F.col("second.net").alias("b"))


@query("h7_check_chain", """
SELECT p_partkey AS part, p_size AS size, p_size + 3 + greatest(0, least(3, p_size - 23)) AS output FROM part WHERE p_size > 23""")
def check_chain(spark, sf):
    rows = ops.check_chain([BROKEN] * 3, sized(spark, sf), lambda p, out: out["size"] == p["size"] + 3)
    return rows.select(F.col("correlation_id").alias("part"), "payload.size", F.col("output.size").alias("output"))
