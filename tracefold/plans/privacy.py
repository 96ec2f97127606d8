"""Scopes, redaction and audits over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracefold.operators import privacy as ops
from tracefold.plans.fixtures import LOG, event_log, read
from tracefold.plans.registry import query
from tracefold.sources.log import identity

SALT = ops.Key("s1")


def token_sql(field: str, value: str) -> str:
    """The token in SQL: HMAC-SHA256 over length-prefixed parts."""
    inner, outer = (pad.hex() for pad in SALT.pads())
    return (f"'tok_k1_' || sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || "
            f"encode('{len(field)}:{field}' || strlen({value}) || ':' || {value}))))")



def people(spark, sf):
    who = identity(F.col("c_name"), scopes=F.array(F.concat(F.lit("read:Person:"), F.lower("c_mktsegment"))))
    return read(spark, sf, "customer").withColumn("identity", who)


@query("i1_scope_gate", f"""
WITH {LOG}
SELECT CASE WHEN edge = 'purchase' THEN CAST(id AS VARCHAR) ELSE sha256(id || '|scope_gate|Failed<' || edge || '>|0') END AS id,
       CASE WHEN edge = 'purchase' THEN edge ELSE 'Failed<' || edge || '>' END AS edge, corr AS correlation_id,
       CASE WHEN edge = 'purchase' THEN step ELSE step + 1 END AS step, value,
       CASE WHEN edge <> 'purchase' THEN 'missing scope read:Event:purchase' END AS reason FROM log""")
def scope_gate(spark, sf):
    """Events behind the grant to read purchases; each event's identity holds the grant for its own kind."""
    ok, refused = ops.scope_gate(event_log(spark, sf), "read:Event:purchase")
    return ok.select(F.col("id").cast("string").alias("id"), "edge", "correlation_id", "step", "payload.value",
                     F.lit(None).cast("string").alias("reason")).unionByName(
        refused.select("id", "edge", "correlation_id", "step", "payload.input.value", "payload.reason"))


@query("i2_scope_narrow", "SELECT c_name AS sub FROM customer")
def scope_narrow(spark, sf):
    return ops.scope_narrow(people(spark, sf), ["read:Identity:sub"], {"Identity": "identity"})


@query("i3_grant_audit", """
SELECT DISTINCT 'read:Event:' || event_type AS scope, 'undeclared' AS finding FROM events WHERE event_type = 'error'
UNION ALL SELECT 'read:Event:refund', 'unused'""")
def grant_audit(spark, sf):
    declared = [(f"read:Event:{e}",) for e in ("click", "purchase", "signup", "view", "refund")]
    return ops.grant_audit(event_log(spark, sf), spark.createDataFrame(declared, "scope string"))


@query("i4_scope_rows", """
SELECT o_orderkey AS order_key FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 7)""")
def scope_rows(spark, sf):
    mine = read(spark, sf, "customer").filter(F.col("c_nationkey") == 7).select(F.col("c_custkey").alias("o_custkey"))
    return ops.scope_rows(read(spark, sf, "orders"), mine, ["o_custkey"]).select(F.col("o_orderkey").alias("order_key"))


FIELDS = ["c_name", "c_mktsegment"]


def redacted(spark, sf):
    return ops.redact(read(spark, sf, "customer").select("c_custkey", *FIELDS), FIELDS, SALT)


@query("i5_redact", f"""
SELECT c_custkey, {token_sql("c_name", "c_name")} AS c_name, {token_sql("c_mktsegment", "c_mktsegment")} AS c_mktsegment
FROM customer""")
def redact(spark, sf):
    return redacted(spark, sf)[0]


@query("i5_token_map", f"""
SELECT DISTINCT {token_sql("c_name", "c_name")} AS token, 'c_name' AS field, c_name AS value FROM customer
UNION ALL SELECT DISTINCT {token_sql("c_mktsegment", "c_mktsegment")}, 'c_mktsegment', c_mktsegment FROM customer""")
def token_map(spark, sf):
    return redacted(spark, sf)[1]


@query("i6_rehydrate", "SELECT c_custkey, c_name, c_mktsegment FROM customer")
def rehydrate(spark, sf):
    rows, names = redacted(spark, sf)
    return ops.rehydrate(rows, names, FIELDS)


@query("i7_token_join", f"""
SELECT {token_sql("name", "c_name")} AS name, c_custkey AS id, count(*) AS orders
FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2""")
def token_join(spark, sf):
    """Two tables redacted apart meet on the tokens of the customer's name."""
    customer = read(spark, sf, "customer").select("c_custkey", F.col("c_name").alias("name"))
    buyers = read(spark, sf, "orders").join(customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "name")
    left, _ = ops.redact(customer, ["name"], SALT)
    right, _ = ops.redact(buyers, ["name"], SALT)
    return ops.token_join(left, right, "name").groupBy("name", F.col("c_custkey").alias("id")).agg(
        F.count(F.lit(1)).alias("orders"))


@query("i8_check_tokens", """
SELECT c_custkey AS id, CASE WHEN c_custkey % 10 = 0 THEN 'mangled' ELSE 'unknown' END AS finding FROM customer
WHERE c_custkey % 10 = 0 OR c_custkey % 11 = 0""")
def check_tokens(spark, sf):
    rows, names = redacted(spark, sf)
    i = F.col("c_custkey")
    stranger = ops.token("c_name", i.cast("string"), "other")
    worked = rows.withColumn("c_name", F.when(i % 10 == 0, F.upper("c_name")).when(i % 11 == 0, stranger).otherwise(F.col("c_name")))
    return ops.check_tokens(worked, names, "c_name").select(i.alias("id"), "finding")


EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"


@query("i9_leak_audit", rf"""
SELECT doc_id, 'text' AS leaked FROM documents WHERE regexp_matches(text, '{EMAIL}') AND source NOT IN ('client')""")
def leak_audit(spark, sf):
    docs = read(spark, sf, "documents")
    return ops.leak_audit(docs, {"text": EMAIL}, F.col("source"), ["client"]).select(
        "doc_id", F.array_join("leaked", ",").alias("leaked"))


ZONES = {"click": "client", "view": "client", "signup": "server", "purchase": "payment", "error": "server"}
_ZONE = "CASE {} WHEN 'click' THEN 'client' WHEN 'view' THEN 'client' WHEN 'purchase' THEN 'payment' ELSE 'server' END"


@query("i10_zone_hops", f"""
WITH {LOG}
SELECT {_ZONE.format('p.edge')} AS from_zone, {_ZONE.format('c.edge')} AS to_zone, count(*) AS hops FROM log c JOIN log p ON c.cause = p.id
GROUP BY 1, 2 HAVING from_zone <> to_zone""")
def zone_hops(spark, sf):
    return ops.zone_hops(event_log(spark, sf), ZONES)


@query("i11_erase_subject", """
SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN c_name END AS c_name, c_mktsegment FROM customer""")
def erase_subject(spark, sf):
    rows, names = redacted(spark, sf)
    gone = read(spark, sf, "customer").filter(F.col("c_acctbal") < 0).select(F.col("c_name").alias("value"))
    return ops.rehydrate(rows, ops.erase_subject(names, gone), FIELDS)


@query("i11_erase_by_subject", """
SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN c_nationkey END AS c_nationkey, CASE WHEN c_acctbal >= 0 THEN c_mktsegment END AS c_mktsegment FROM customer""")
def erase_by_subject(spark, sf):
    """Values that many customers share go for the erased ones only, and numbers come back as numbers."""
    customer = read(spark, sf, "customer")
    fields = ["c_nationkey", "c_mktsegment"]
    table = customer.select("c_custkey", *fields)
    rows, names = ops.redact(table, fields, SALT, subject="c_custkey")
    gone = customer.filter(F.col("c_acctbal") < 0).select(F.col("c_custkey").alias("subject"))
    kept = ops.erase_subject(names, gone, "subject")
    return ops.rehydrate(rows, kept, fields, types={"c_nationkey": table.schema["c_nationkey"].dataType.simpleString()}, subject="c_custkey")


@query("i12_exit_filter", "SELECT event_id AS id FROM events WHERE event_type = 'purchase' AND user_id % 2 = 0")
def exit_filter(spark, sf):
    log = event_log(spark, sf)
    grants = log.filter((F.col("user_id") % 2 == 0) & (F.col("edge") == "purchase")).select("edge", "user_id").distinct()
    return ops.exit_filter(log, grants, ["edge", "user_id"]).select("id")


@query("i13_declassify", "SELECT c_custkey, c_name, c_mktsegment FROM customer")
def declassify(spark, sf):
    return ops.declassify(read(spark, sf, "customer"), ["c_custkey", "c_name", "c_mktsegment"])


@query("i14_type_gate_audit", f"""
WITH {LOG}
SELECT id FROM log WHERE edge = 'purchase' AND (cause IS NULL OR cause NOT IN (SELECT id FROM log WHERE edge = 'view'))""")
def type_gate_audit(spark, sf):
    return ops.type_gate_audit(event_log(spark, sf), "purchase", "view", "emit_view").select("id")
