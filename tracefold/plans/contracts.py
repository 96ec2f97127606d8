"""Contract operators over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracefold.contract import Edge, Field
from tracefold.operators import conform as ops
from tracefold.operators.nodes import collect_many
from tracefold.plans.fixtures import (
    EVENTS, LINE_ORDER, LINE_ORDER_SQL, LOG, ORDER_WITH_LINES, PERSON, PERSON_SQL, PLACED, event_log, person, read,
)
from tracefold.plans.registry import query
from tracefold.sources.text import json_violations

SOLVENT = Edge("Solvent", "Solvent person", "A person without debt", {
    **PERSON.fields,
    "balance": Field("f64", "Balance", "Account balance", nullable=False, min=0, source_key="c_acctbal"),
}, index="id")

METRIC = Edge("Metric", "Metric", "A small event", {
    "value": Field("f64", "Value", "Amount", nullable=False, max=100),
    "event_type": Field("utf8", "Type", "Event type", nullable=False, enum=("click", "purchase", "signup", "view")),
    "props": Field("utf8", "Props", "Raw properties", nullable=False, min_length=8, pattern=r"^\{.*[0-9]\}$"),
})

LOCATED = Edge("Located", "Located person", "A person with a nation", {
    "id": Field("uint32", "Id", "Key", nullable=False),
    "nation": Edge("Nation", "Nation", "Where", {
        "name": Field("utf8", "Name", "Nation name", nullable=False, pattern="^NATION_[0-9]$"),
        "region": Field("utf8", "Region", "Region name", nullable=False),
    }),
})

COUNTER = Edge("Counter", "Counter", "JSON counter", {"k": Field("uint8", "K", "Counter", nullable=False)})


@query("a1_apply_contract", """
SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance, c_mktsegment AS segment FROM customer""")
def apply_contract(spark, sf):
    return ops.apply_contract(read(spark, sf, "customer"), PERSON)


@query("a2_violations_shape", """
SELECT event_id, CASE WHEN event_id % 17 IN (3, 4) THEN 'Counter' ELSE 'k' END AS path,
       CASE event_id % 17 WHEN 0 THEN 'null' WHEN 1 THEN 'missing' WHEN 2 THEN 'type' WHEN 3 THEN 'object'
            WHEN 4 THEN 'malformed' ELSE 'type' END AS rule
FROM events WHERE event_id % 17 <= 5""")
def violations_shape(spark, sf):
    fault = F.col("event_id") % 17
    raw = (F.when(fault == 0, '{"k": null}').when(fault == 1, "{}").when(fault == 2, '{"k": "old"}')
           .when(fault == 3, "[]").when(fault == 4, "{bad").when(fault == 5, '{"k": 1.5}').otherwise(F.col("props")))
    faults = read(spark, sf, "events").select("event_id", F.explode(json_violations(raw, COUNTER)).alias("v"))
    return faults.select("event_id", "v.path", "v.rule")


@query("a3_violations_domain", """
SELECT event_id, 'value' AS path, 'max' AS rule FROM events WHERE value > 100
UNION ALL SELECT event_id, 'event_type', 'enumValues' FROM events WHERE event_type = 'error'
UNION ALL SELECT event_id, 'props', 'minLength' FROM events WHERE length(props) < 8""")
def violations_domain(spark, sf):
    events = read(spark, sf, "events")
    faults = events.select("event_id", F.explode(ops.violations(events, METRIC, "domain")).alias("v"))
    return faults.select("event_id", "v.path", "v.rule")


@query("a3_violations_seeded_nulls", """
SELECT event_id, 'value' AS path, CASE WHEN event_id % 17 = 0 THEN 'null' ELSE 'max' END AS rule
FROM events WHERE event_id % 17 = 0 OR value > 100""")
def violations_seeded_nulls(spark, sf):
    edge = Edge("Small", fields={"value": METRIC.fields["value"]})
    events = read(spark, sf, "events").withColumn(
        "value", F.when(F.col("event_id") % 17 != 0, F.col("value")))
    faults = events.select("event_id", F.explode(ops.violations(events, edge, "domain")).alias("v"))
    return faults.select("event_id", "v.path", "v.rule")


@query("a4_violations_nested", f"""
WITH {PERSON_SQL}
SELECT id, 'nation.name' AS path, 'pattern' AS rule FROM person WHERE NOT regexp_matches(nation_name, '^NATION_[0-9]$')
UNION ALL SELECT id, 'nation.region', 'null' FROM person WHERE id % 17 = 0""")
def violations_nested(spark, sf):
    people = person(spark, sf)
    people = people.withColumn("nation", F.col("nation").withField(
        "region", F.when(F.col("id") % 17 != 0, F.col("nation.region"))))
    faults = people.select("id", F.explode(ops.violations(people, LOCATED, "domain")).alias("v"))
    return faults.select("id", "v.path", "v.rule")


@query("a5_violations_many", f"""
WITH numbered AS (
  SELECT l_orderkey, l_quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY {LINE_ORDER_SQL}) - 1 AS i
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT l_orderkey AS order_key, 'lines[' || i || '].quantity' AS path, 'max' AS rule FROM numbered WHERE l_quantity > 49""")
def violations_many(spark, sf):
    lines = read(spark, sf, "lineitem")
    whole = collect_many(read(spark, sf, "orders").select("o_orderkey"), "o_orderkey", lines, "l_orderkey", LINE_ORDER,
                         F.struct(F.col("l_quantity").alias("quantity")), "lines")
    faults = whole.select(F.col("o_orderkey").alias("order_key"),
                          F.explode(ops.violations(whole, ORDER_WITH_LINES, "domain")).alias("v"))
    return faults.select("order_key", "v.path", "v.rule")


@query("a6_conform", """
SELECT c_custkey AS id, CASE WHEN c_acctbal >= 0 THEN 'ok' ELSE 'Failed<Solvent>' END AS outcome,
       CASE WHEN c_acctbal >= 0 THEN NULL ELSE 'balance:min' END AS reason FROM customer""")
def conform(spark, sf):
    ok, failed = ops.conform(read(spark, sf, "customer"), SOLVENT)
    return ok.select("id", F.lit("ok").alias("outcome"), F.lit(None).cast("string").alias("reason")).unionByName(
        failed.select(F.col("input.c_custkey").alias("id"), F.col("edge").alias("outcome"), F.array_join(
            F.transform("reason", lambda v: F.concat(v["path"], F.lit(":"), v["rule"])), ",").alias("reason")))


@query("a7_check_index", """
SELECT l_orderkey, l_linenumber, count(*) AS instances FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1""")
def check_index(spark, sf):
    return ops.check_index(read(spark, sf, "lineitem"), keys=["l_orderkey", "l_linenumber"])


@query("a8_check_relation", """
WITH lk AS (SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY 1),
     ok AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1)
SELECT 'orders-customer' AS relation, (SELECT count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)) AS orphans,
       (SELECT count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)) AS unreferenced,
       CASE WHEN (SELECT max(n) FROM ok) > 1 THEN 'many' ELSE '1' END || ':1' AS observed, 'many:1' AS declared, true AS holds
UNION ALL
SELECT 'orders-lineitem', (SELECT count(*) FROM orders WHERE o_orderkey NOT IN (SELECT k FROM lk)),
       (SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)),
       '1:' || CASE WHEN (SELECT max(n) FROM lk) > 1 THEN 'many' ELSE '1' END, '1:1', (SELECT max(n) FROM lk) <= 1""")
def check_relation(spark, sf):
    orders, lines = read(spark, sf, "orders"), read(spark, sf, "lineitem")
    declared = ops.relation_of(PLACED, "customer").cardinality
    to_customer = ops.check_relation(orders, "o_custkey", read(spark, sf, "customer"), "c_custkey", declared)
    to_lines = ops.check_relation(orders, "o_orderkey", lines, "l_orderkey", "1:1")
    return (to_customer.withColumn("relation", F.lit("orders-customer"))
            .unionByName(to_lines.withColumn("relation", F.lit("orders-lineitem"))))


_PERSON_TEXT = (
    '{"name":"Person","index":"id","fields":{"balance":{"type":"f64"},"id":{"type":"uint32","format":"id"},'
    '"name":{"type":"utf8","validations":{"minLength":1,"maxLength":200}},"segment":{"type":"utf8"}}}')


@query("a9_stamp_schema_hash", f"""
SELECT c_custkey AS id, sha256('{_PERSON_TEXT}') AS schema_hash, substr(sha256('{_PERSON_TEXT}'), 1, 8) AS short_hash
FROM customer""")
def stamp_schema_hash(spark, sf):
    people = ops.apply_contract(read(spark, sf, "customer"), PERSON).select("id")
    return ops.stamp_schema_hash(ops.stamp_schema_hash(people, PERSON), PERSON, "short_hash", short=True)


OLD_HASH = "4b7c35de"


def _aged(log):
    """The log as if a third of it had been written under an older contract."""
    return log.withColumn("schema_hash", F.when(F.col("id") % 3 == 0, F.lit(OLD_HASH)).otherwise(F.col("schema_hash")))


@query("a10_drift_report", """
SELECT event_type AS edge, CASE WHEN event_type = 'error' THEN 'unknown' WHEN event_id % 3 = 0 THEN 'stale' ELSE 'current' END AS status,
       event_id % 3 = 0 AS old, count(*) AS instances FROM events GROUP BY 1, 2, 3""")
def drift_report(spark, sf):
    known = [e for name, e in EVENTS.items() if name != "error"]
    report = ops.drift_report(_aged(event_log(spark, sf)), known)
    return report.select("edge", "status", (F.col("schema_hash") == OLD_HASH).alias("old"), "instances")


AMOUNT = Edge("purchase", "Purchase", "A purchase with an amount", {
    "amount": Field("f64", "Amount", "Amount", nullable=False),
    "k": Field("uint8", "K", "Counter", nullable=False),
})


@query("a11_migrate_or_refuse", """
SELECT event_id AS id, CASE WHEN event_id % 3 = 1 THEN NULL ELSE value END AS amount, event_id % 3 = 0 AS migrated,
       CASE WHEN event_id % 3 = 1 THEN 'no rule from ffff' END AS reason FROM events WHERE event_type = 'purchase'""")
def migrate_or_refuse(spark, sf):
    age = F.col("id") % 3
    old, new = F.struct("payload.value", "payload.k"), F.struct(F.col("payload.value").alias("amount"), "payload.k")
    mixed = event_log(spark, sf).filter(F.col("edge") == "purchase").withColumns({
        "schema_hash": F.when(age == 0, OLD_HASH).when(age == 1, "ffff").otherwise(AMOUNT.schema_hash),
        "payload": F.when(age == 2, F.to_variant_object(new)).otherwise(F.to_variant_object(old)),
    })
    rename = lambda p: F.struct(F.variant_get(p, "$.value", "double").alias("amount"),
                                F.variant_get(p, "$.k", "smallint").alias("k"))
    ok, refused = ops.migrate_or_refuse(mixed, AMOUNT, {OLD_HASH: rename})
    return ok.select("id", "payload.amount", "migrated", F.lit(None).cast("string").alias("reason")).unionByName(
        refused.select("id", F.lit(None).cast("double").alias("amount"), F.lit(False).alias("migrated"), "reason"))


PROFILE = Edge("Profile", fields={
    "event_type": Field("utf8", "Type", "Event type", nullable=False, measure="nominal"),
    "value": Field("f64", "Value", "Amount", nullable=False, measure="quantitative"),
    "user_id": Field("uint32", "User", "User", nullable=False, measure="ordinal"),
})


@query("a12_field_dictionary", """
SELECT 'event_type' AS field, 'nominal' AS measure, count(*) AS rows, count(*) - count(event_type) AS nulls,
       count(DISTINCT event_type) AS distinct_values, NULL AS lowest, NULL AS highest FROM events
UNION ALL SELECT 'value', 'quantitative', count(*), count(*) - count(value), count(DISTINCT value),
       CAST(min(value) AS VARCHAR), CAST(max(value) AS VARCHAR) FROM events
UNION ALL SELECT 'user_id', 'ordinal', count(*), count(*) - count(user_id), count(DISTINCT user_id),
       CAST(min(user_id) AS VARCHAR), CAST(max(user_id) AS VARCHAR) FROM events""")
def field_dictionary(spark, sf):
    report = ops.field_dictionary(read(spark, sf, "events"), PROFILE, exact=True)
    return report.select("field", "measure", "rows", "nulls", F.col("distinct").alias("distinct_values"), "lowest", "highest")


@query("a12_top_values", """
SELECT event_type AS value, count(*) AS instances FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3""")
def top_values(spark, sf):
    return ops.top_values(read(spark, sf, "events"), "event_type", 3)
