"""Node operators over the tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from tracefold.contract import Edge, Field
from tracefold.functions.columns import cents
from tracefold.operators import nodes as ops
from tracefold.plans.fixtures import (
    EVENT, LINE_ORDER, LINE_ORDER_SQL, LOG, PERSON_SQL, PLACED, PLACED_SQL, SIZED, SIZED_SQL, event_log, person,
    placed, read, sized,
)
from tracefold.plans.registry import query

BIRTHDAY = ops.Node("birthday", SIZED, SIZED, lambda p, by=1: {"size": p["size"] + by})


@query("c1_apply", f"""
WITH {SIZED_SQL}
SELECT sha256(id || '|birthday|Sized|0') AS id, corr AS correlation_id, id AS causation_id, 1 AS step, size + 1 AS size
FROM sized""")
def apply(spark, sf):
    return ops.apply(BIRTHDAY, sized(spark, sf)).select("id", "correlation_id", "causation_id", "step", "payload.size")


def decided(spark, sf):
    price = F.col("payload.price")
    grade = F.when(price > 300000, "Big").when(price > 100000, "Medium").when(price > 10000, "Small")
    return ops.one_of(placed(spark, sf), grade, ["Big", "Medium", "Small"], "grade", PLACED)


@query("c2_one_of", """
SELECT o_orderkey AS correlation_id, CASE WHEN o_totalprice > 300000 THEN 'Big' WHEN o_totalprice > 100000 THEN 'Medium'
       WHEN o_totalprice > 10000 THEN 'Small' ELSE 'Failed<Placed>' END AS edge,
       CASE WHEN o_totalprice > 10000 THEN NULL ELSE 'undeclared branch null' END AS reason FROM orders""")
def one_of(spark, sf):
    chosen, failed = decided(spark, sf)
    return chosen.select("correlation_id", "edge", F.lit(None).cast("string").alias("reason")).unionByName(
        failed.select("correlation_id", "edge", "payload.reason"))


@query("c3_all_of", f"""
WITH {PLACED_SQL}
SELECT corr AS correlation_id, id AS causation_id, e AS edge, sha256(id || '|place_order|' || e || '|0') AS id
FROM placed, (VALUES ('InvoiceRequested'), ('InventoryReserved')) v(e)""")
def all_of(spark, sf):
    siblings = ops.all_of(placed(spark, sf), {Edge("InvoiceRequested"): lambda p: {},
                                              Edge("InventoryReserved"): lambda p: {}}, "place_order")
    return siblings.select("correlation_id", "causation_id", "edge", "id")


@query("c3_all_of_mixed", """
SELECT 'Invoice' AS edge, count(*) AS instances, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS total FROM orders
UNION ALL SELECT 'Reserve', count(*), NULL FROM orders""")
def all_of_mixed(spark, sf):
    invoice = Edge("Invoice", fields={"price": PLACED.fields["price"]})
    reserve = Edge("Reserve", fields={"order": PLACED.fields["order"]})
    rows = ops.all_of(placed(spark, sf), {invoice: lambda p: {"price": p["price"]},
                                          reserve: lambda p: {"order": p["order"]}}, "split")
    price = F.try_variant_get("payload", "$.price", "double")
    return rows.groupBy("edge").agg(F.count(F.lit(1)).alias("instances"), F.sum(cents(price)).alias("total"))


@query("c4_many", f"""
WITH {SIZED_SQL}
SELECT corr AS correlation_id, 0 AS ordinal, size - 2 AS size, sha256(id || '|siblings|Sized|0') AS id FROM sized
UNION ALL SELECT corr, 1, size + 2, sha256(id || '|siblings|Sized|1') FROM sized""")
def many(spark, sf):
    pair = lambda p: F.array(F.struct((p["size"] - 2).alias("size")), F.struct((p["size"] + 2).alias("size")))
    rows = ops.many(sized(spark, sf), pair, "siblings", SIZED)
    return rows.select("correlation_id", "ordinal", "payload.size", "id")


def order_with_lines(spark, sf):
    element = F.struct(F.col("l_linenumber").alias("number"), F.col("l_quantity").alias("quantity"),
                       F.col("l_returnflag").alias("flag"))
    return ops.collect_many(read(spark, sf, "orders").select("o_orderkey"), "o_orderkey", read(spark, sf, "lineitem"),
                            "l_orderkey", LINE_ORDER, element, "lines")


@query("c5_collect_many", f"""
SELECT o_orderkey AS order_key, 0 AS part, count(l_orderkey) AS n_lines,
       coalesce(string_agg(CAST(CAST(l_quantity AS INT) AS VARCHAR), ',' ORDER BY {LINE_ORDER_SQL}), '') AS quantities
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""")
def collect_many(spark, sf):
    quantities = F.transform("lines", lambda x: x["quantity"].cast("int").cast("string"))
    return order_with_lines(spark, sf).select(
        F.col("o_orderkey").alias("order_key"), F.lit(0).alias("part"), F.size("lines").alias("n_lines"),
        F.array_join(quantities, ",").alias("quantities"))


@query("c6_append_to_many", f"""
WITH early AS (SELECT l_orderkey AS k, string_agg(CAST(CAST(l_quantity AS INT) AS VARCHAR), ',' ORDER BY {LINE_ORDER_SQL}) AS q
               FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1),
     late AS (SELECT l_orderkey AS k, string_agg(CAST(CAST(l_quantity AS INT) AS VARCHAR), ',' ORDER BY {LINE_ORDER_SQL}) AS q
              FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
SELECT o_orderkey AS order_key, concat_ws(',', early.q, late.q) AS quantities
FROM orders LEFT JOIN early ON early.k = o_orderkey LEFT JOIN late ON late.k = o_orderkey""")
def append_to_many(spark, sf):
    lines = read(spark, sf, "lineitem")
    late = F.col("l_returnflag") == "R"
    element = F.col("l_quantity").cast("int").cast("string")
    base = ops.collect_many(read(spark, sf, "orders").select("o_orderkey"), "o_orderkey", lines.filter(~late),
                            "l_orderkey", LINE_ORDER, element, "lines")
    grown = ops.append_to_many(base, "o_orderkey", "lines", lines.filter(late), "l_orderkey", LINE_ORDER, element)
    return grown.select(F.col("o_orderkey").alias("order_key"), F.array_join("lines", ",").alias("quantities"))


@query("c7_nested", f"""
WITH {PERSON_SQL}
SELECT id, name || ' of ' || nation_name AS name, upper(region) AS region, nation_name FROM person""")
def nested(spark, sf):
    people = person(spark, sf)
    return people.select(
        "id", F.concat("name", F.lit(" of "), ops.read_nested("nation", "name")).alias("name"),
        ops.write_nested("nation", "region", F.upper("nation.region")).alias("nation")).select(
        "id", "name", "nation.region", F.col("nation.name").alias("nation_name"))


@query("c8_array_aggregate", """
SELECT o_orderkey AS order_key, count(l_orderkey) AS n_lines, CAST(coalesce(sum(CAST(l_quantity AS BIGINT)), 0) AS BIGINT) AS quantity,
       coalesce(bool_or(l_returnflag = 'R'), false) AS any_returned
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""")
def array_aggregate(spark, sf):
    found = ops.reduce_many(read(spark, sf, "orders").select("o_orderkey"), "o_orderkey", read(spark, sf, "lineitem"), "l_orderkey",
                            n=F.count(F.lit(1)), total=F.sum(F.col("l_quantity").cast("bigint")), hit=F.bool_or(F.col("l_returnflag") == "R"))
    return found.select(
        F.col("o_orderkey").alias("order_key"), F.coalesce("n", F.lit(0)).alias("n_lines"), F.coalesce("total", F.lit(0)).alias("quantity"),
        F.coalesce("hit", F.lit(False)).alias("any_returned"))


@query("c9_null_aware", """
SELECT o_orderkey AS order_key, CASE WHEN n IS NULL THEN 'order ' || o_orderkey || ' (no lines)'
       ELSE 'order ' || o_orderkey || ' (' || n || ' lines)' END AS title
FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""")
def null_aware(spark, sf):
    counts = read(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    orders = read(spark, sf, "orders").join(counts, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    title = F.when(F.col("n").isNull(), F.lit("no lines")).otherwise(F.concat(F.col("n").cast("string"), F.lit(" lines")))
    return orders.select(F.col("o_orderkey").alias("order_key"), F.concat(
        F.lit("order "), F.col("o_orderkey").cast("string"), F.lit(" ("), title, F.lit(")")).alias("title"))


@query("c10_spread", f"""
WITH {PERSON_SQL}
SELECT id, nation_name AS name, region, length(name) AS name_length FROM person""")
def spread(spark, sf):
    people = person(spark, sf).withColumn("name_length", F.length("name")).drop("name")
    return ops.spread(people, "nation")


EXPECT_12 = ops.Node("expect_12", SIZED, Edge("Verdict", fields={"passed": Field("bool", "Passed", "Size is 12")}),
                     lambda p: {"passed": p["size"] == 12})


@query("c11_pipe", f"""
WITH {SIZED_SQL}
SELECT corr AS correlation_id, s AS step, CASE s WHEN 3 THEN 'expect_12' ELSE 'birthday' END AS node,
       CASE s WHEN 3 THEN NULL ELSE size + s END AS size, CASE s WHEN 3 THEN size + 2 = 12 END AS passed
FROM sized, (VALUES (1), (2), (3)) v(s)""")
def pipe(spark, sf):
    """Two birthdays and an expectation over one reading of the parts."""
    rows = ops.pipe(sized(spark, sf), BIRTHDAY, BIRTHDAY, EXPECT_12)
    return rows.select("correlation_id", "step", "node", F.try_variant_get("payload", "$.size", "int").alias("size"),
                       F.try_variant_get("payload", "$.passed", "boolean").alias("passed"))


@query("c12_parallel", """
SELECT 'birthday' AS node, count(*) AS instances FROM part UNION ALL SELECT 'reprice', count(*) FROM orders""")
def parallel(spark, sf):
    reprice = ops.Node("reprice", PLACED, PLACED, lambda p: {**{n: p[n] for n in PLACED.fields}, "price": p["price"] * 2})
    parts, orders = ops.parallel([(BIRTHDAY, sized(spark, sf)), (reprice, placed(spark, sf))])
    return parts.select("node").unionByName(orders.select("node")).groupBy("node").agg(
        F.count(F.lit(1)).alias("instances"))


@query("c13_copy_discard", f"""
WITH {LOG}
SELECT 'k' AS consumer, edge, CAST(sum(k) AS BIGINT) AS total FROM log WHERE edge <> 'error' GROUP BY 2
UNION ALL SELECT 'step', edge, CAST(sum(step) AS BIGINT) FROM log WHERE edge <> 'error' GROUP BY 2""")
def copy_discard(spark, sf):
    def total(name, column):
        return lambda log: log.groupBy("edge").agg(F.sum(column).alias("total")).select(
            F.lit(name).alias("consumer"), "edge", "total")
    left = ops.discard(event_log(spark, sf), "error")
    a, b = ops.copy(left, total("k", "payload.k"), total("step", "step"))
    return a.unionByName(b)


@query("c14_repeat", f"""
WITH {SIZED_SQL}
SELECT corr AS correlation_id, s AS step, size + s AS size FROM sized, (VALUES (1), (2), (3)) v(s)""")
def repeat(spark, sf):
    return ops.repeat(BIRTHDAY, sized(spark, sf), 3).select("correlation_id", "step", "payload.size")


ACTIVITY = Edge("Activity", "Activity", "Any user event", {"k": EVENT.fields["k"]})


def activity(spark, sf):
    return ops.erase([event_log(spark, sf)], ["k"], ACTIVITY, "to_activity")


@query("c15_erase", """
SELECT event_type AS source_edge, 'Activity' AS edge, count(*) AS instances,
       CAST(sum(CAST(regexp_extract(props, '[0-9]+') AS INT)) AS BIGINT) AS k FROM events GROUP BY 1""")
def erase(spark, sf):
    return activity(spark, sf).groupBy("source_edge", "edge").agg(
        F.count(F.lit(1)).alias("instances"), F.sum("payload.k").alias("k"))


LANE = Edge("Lane", "Lane", "Where a row was routed", {"lane": Field("utf8", "Lane", "Lane", nullable=False)})


@query("c16_env_apply", f"""
WITH {LOG}
SELECT CAST(id AS VARCHAR) AS causation_id, step + 1 AS step, CASE step % 2 WHEN 0 THEN 'even' ELSE 'odd' END AS lane FROM log""")
def env_apply(spark, sf):
    route = lambda log: F.struct(F.when(log["step"] % 2 == 0, "even").otherwise("odd").alias("lane"))
    return ops.env_apply(event_log(spark, sf), "router", LANE, route).select("causation_id", "step", "payload.lane")


@query("c17_closure", """
SELECT o_orderkey AS correlation_id, o_totalprice > 150000 AS above FROM orders""")
def closure(spark, sf):
    above = ops.Node("above", PLACED, Edge("Above", fields={"above": Field("bool", "Above", "Above the threshold")}),
                     lambda p, threshold: {"above": p["price"] > threshold})
    return ops.apply(ops.closure(above, threshold=150000), placed(spark, sf)).select("correlation_id", "payload.above")


@query("c18_check_output", """
SELECT p_partkey AS correlation_id, p_size + 120 AS size, CASE WHEN p_size + 120 <= 150 THEN 'Sized' ELSE 'Failed<Sized>' END AS edge,
       CASE WHEN p_size + 120 <= 150 THEN NULL ELSE 'size:max' END AS reason FROM part""")
def check_output(spark, sf):
    older = ops.apply(ops.closure(BIRTHDAY, by=120), sized(spark, sf))
    ok, failed = ops.check_output(older, SIZED)
    reasons = F.array_join(F.transform("payload.reason", lambda v: F.concat(v["path"], F.lit(":"), v["rule"])), ",")
    return ok.select("correlation_id", F.col("payload.size").cast("int").alias("size"), "edge",
                     F.lit(None).cast("string").alias("reason")).unionByName(
        failed.select("correlation_id", F.col("payload.input.size").cast("int").alias("size"), "edge", reasons.alias("reason")))


def normalise(rows: pd.DataFrame) -> pd.DataFrame:
    """Trim and squeeze blanks; refuses texts that hold an at sign."""
    if rows["text"].str.contains("@", regex=False).any():
        raise ValueError("contact data")
    return pd.DataFrame({"text": rows["text"].str.strip(" ").str.replace("  ", " ", regex=False)})


@query("c19_python_node", """
SELECT doc_id, CASE WHEN contains(text, '@') THEN NULL ELSE md5(replace(trim(text, ' '), '  ', ' ')) END AS digest,
       CASE WHEN contains(text, '@') THEN 'ValueError: contact data' END AS reason FROM documents""")
def python_node(spark, sf):
    rows = ops.python_node(read(spark, sf, "documents"), normalise, "text string", keep=["doc_id"], inputs=["text"])
    return rows.select("doc_id", F.md5("text").alias("digest"), "reason")


@query("c20_pin", """
SELECT o_orderkey AS order_key, false AS is_complete, 'new' AS status FROM orders""")
def pin(spark, sf):
    rows = read(spark, sf, "orders").select(F.col("o_orderkey").alias("order_key"), F.lit(True).alias("is_complete"),
                                            F.col("o_orderstatus").alias("status"))
    return ops.pin(rows, is_complete=F.lit(False), status=F.lit("new"))
