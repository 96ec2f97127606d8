"""Failure handling and state over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracefold.contract import Edge, Field
from tracefold.functions.columns import cents
from tracefold.operators import failure, state
from tracefold.operators.boundary import boundary as run_boundary
from tracefold.operators.nodes import Node
from tracefold.plans.fixtures import EVENT, EVENTS, LOG, PLACED, event_log, placed, read
from tracefold.plans.registry import query

RATIO = Edge("Ratio", "Ratio", "Value over a remainder", {"ratio": Field("f64", "Ratio", "Ratio", nullable=False)})


@query("e1_failed_rows", """
SELECT sha256(sha256(o_orderkey || '|origin_placed|Placed|0') || '|reject|Failed<Placed>|0') AS id, o_orderkey AS correlation_id,
       'Failed<Placed>' AS edge, o_custkey AS customer, 'status ' || o_orderstatus AS reason FROM orders WHERE o_orderstatus = 'P'""")
def failed_rows(spark, sf):
    bad = placed(spark, sf).filter(F.col("payload.status") == "P")
    rows = failure.failed_rows(bad, PLACED, F.concat(F.lit("status "), "payload.status"), "reject")
    return rows.select("id", "correlation_id", "edge", "payload.input.customer", "payload.reason")


@query("e2_guard", f"""
WITH {LOG}
SELECT CAST(id AS VARCHAR) AS causation_id, CASE WHEN k % 3 = 0 THEN 'Failed<view>' ELSE 'Ratio' END AS edge,
       CASE WHEN k % 3 <> 0 THEN value / (k % 3) END AS ratio, CASE WHEN k % 3 = 0 THEN 'no value for ratio' END AS reason
FROM log WHERE edge = 'view'""")
def guard(spark, sf):
    node = Node("ratio", EVENTS["view"], RATIO, lambda p: {"ratio": p["value"] / (p["k"] % 3)})
    ok, failed = failure.guard(node, event_log(spark, sf))
    return ok.select("causation_id", "edge", "payload.ratio", F.lit(None).cast("string").alias("reason")).unionByName(
        failed.select("causation_id", "edge", F.lit(None).cast("double").alias("ratio"), "payload.reason"))


MODEST = Edge("Modest", "Modest event", "An event of at most 150", {
    "value": Field("f64", "Value", "Amount", nullable=False, max=150), "k": EVENTS["view"].fields["k"]})
SMALL_RATIO = Edge("SmallRatio", "Ratio", "Value over a remainder", {"ratio": Field("f64", "Ratio", "Ratio", nullable=False, max=60)})


@query("e2_boundary", f"""
WITH {LOG}, staged AS (
  SELECT *, CASE WHEN user_id % 5 = 0 THEN 'scope' WHEN value > 150 THEN 'input' WHEN k % 3 = 0 THEN 'body' WHEN value / (k % 3) > 60 THEN 'output' END AS stage
  FROM log WHERE edge = 'view')
SELECT CAST(id AS VARCHAR) AS causation_id, step + 1 AS step, CASE WHEN stage IS NULL THEN 'SmallRatio' ELSE 'Failed<Modest>' END AS edge, stage,
       CASE WHEN stage IS NULL THEN value / (k % 3) END AS ratio, CASE WHEN stage IS NOT NULL THEN value END AS input,
       CASE stage WHEN 'scope' THEN 'missing scope read' WHEN 'body' THEN 'no value for ratio' END AS reason FROM staged""")
def boundary(spark, sf):
    """Every stage of the boundary stops some rows; the body divides plainly."""
    views = event_log(spark, sf).filter(F.col("edge") == "view").withColumn("edge", F.lit("Modest"))
    grants = F.when(F.col("user_id") % 5 != 0, F.array(F.lit("read"))).otherwise(F.array().cast("array<string>"))
    node = Node("ratio", MODEST, SMALL_RATIO, lambda p: {"ratio": p["value"] / (p["k"] % 3)})
    ok, failed = run_boundary(node, views.withColumn("identity", F.col("identity").withField("scopes", grants)), scope="read")
    text = F.lit(None).cast("string")
    return ok.select("causation_id", "step", "edge", text.alias("stage"), "payload.ratio", F.lit(None).cast("double").alias("input"),
                     text.alias("reason")).unionByName(
        failed.select("causation_id", "step", "edge", "payload.stage", F.lit(None).cast("double").alias("ratio"), F.col("payload.input.value").alias("input"),
                      F.when(F.col("payload.stage").isin("scope", "body"), F.col("payload.reason")).alias("reason")))


@query("e3_fail_where", f"""
WITH {LOG}
SELECT id, CASE WHEN value > 100 THEN 'Failed<purchase>' ELSE 'purchase' END AS edge, CASE WHEN value > 100 THEN 'too much' END AS reason
FROM log WHERE edge = 'purchase'""")
def fail_where(spark, sf):
    log = event_log(spark, sf).filter(F.col("edge") == "purchase")
    on, failed = failure.fail_where(log, F.col("payload.value") > 100, EVENTS["purchase"], F.lit("too much"), "limit")
    return on.select("id", "edge", F.lit(None).cast("string").alias("reason")).unionByName(
        failed.select(F.col("causation_id").cast("bigint").alias("id"), "edge", "payload.reason"))


EVENT_K = Edge("Retried", "Retried", "A counter that another attempt gave", {"k": Field("uint8", "K", "Counter", nullable=False)})


def retried(spark, sf):
    """Events above 50 fail, and are tried again with bounds 100, 200 and 300."""
    failed = failure.failed_rows(event_log(spark, sf).filter(F.col("payload.value") > 50), EVENT, F.lit("above 50"), "limit")
    node = Node("again", EVENT, EVENT_K, lambda p, attempt: {"k": F.when(p["value"] <= 100 * attempt, p["k"] + attempt)})
    return failure.retry(failed, node, 3)


def _hop(k: int) -> str:
    return f"sha256(f{k - 1} || CASE WHEN value <= {100 * k} THEN '|again|Retried|0' ELSE '|again|Failed<Event>|0' END) AS f{k}"


TRIED = f"""{LOG}, t0 AS (SELECT step, value, k, sha256(id || '|limit|Failed<Event>|0') AS f0 FROM log WHERE value > 50),
t1 AS (SELECT *, {_hop(1)} FROM t0), t2 AS (SELECT *, {_hop(2)} FROM t1), t3 AS (SELECT *, {_hop(3)} FROM t2)"""


def _tries(k: int) -> str:
    return f"""SELECT f{k} AS id, f{k - 1} AS causation_id, step + {k + 1} AS step, CASE WHEN value <= {100 * k} THEN 'Retried' ELSE 'Failed<Event>' END AS edge,
       CASE WHEN value <= {100 * k} THEN k + {k} END AS k, CASE WHEN value > {100 * k} THEN 'attempt {k}: no value for k' END AS reason
FROM t3 WHERE value > {100 * (k - 1)}"""


@query("e4_retry", f"WITH {TRIED} {' UNION ALL '.join(map(_tries, (1, 2, 3)))}")
def retry(spark, sf):
    """Every attempt as a log row, with what caused it."""
    _, attempts, _ = retried(spark, sf)
    return attempts.select("id", "causation_id", "step", "edge", F.try_variant_get("payload", "$.k", "int").alias("k"),
                           F.try_variant_get("payload", "$.reason", "string").alias("reason"))


@query("e4_retry_outputs", f"""
WITH {TRIED}
SELECT CASE WHEN value <= 100 THEN f1 WHEN value <= 200 THEN f2 ELSE f3 END AS id, CASE WHEN value <= 100 THEN 1 WHEN value <= 200 THEN 2 ELSE 3 END AS attempts
FROM t3 WHERE value <= 300""")
def retry_outputs(spark, sf):
    worked, _, _ = retried(spark, sf)
    return worked.select("id", "attempts")


@query("e5_dead_letter", f"WITH {TRIED} SELECT f3 AS id, f2 AS causation_id, value FROM t3 WHERE value > 300")
def dead_letter(spark, sf):
    _, _, dead = retried(spark, sf)
    return dead.select("id", "causation_id", "payload.input.value")


@query("e6_unhandled_failures", f"""
WITH {LOG}
SELECT id FROM log WHERE edge = 'error' AND id NOT IN (SELECT cause FROM log WHERE cause IS NOT NULL)""")
def unhandled_failures(spark, sf):
    return failure.unhandled_failures(event_log(spark, sf), F.col("edge") == "error").select("id")


@query("e7_failure_stats", f"""
WITH {LOG}, r AS (SELECT day(ts) AS d, edge, CASE WHEN value > 100 THEN 'remainder ' || (k % 3) END AS reason, count(*) AS n FROM log GROUP BY 1, 2, 3),
g AS (SELECT d, edge, grouping(d) * 2 + grouping(edge) AS level, reason, sum(n) AS n FROM r GROUP BY GROUPING SETS ((d, edge, reason), (d, reason), (reason))),
s AS (SELECT d AS day, edge, level, CAST(sum(n) AS BIGINT) AS instances, CAST(coalesce(sum(n) FILTER (reason IS NOT NULL), 0) AS BIGINT) AS failures,
             arg_min(reason, {{'n': -n, 'r': reason}}) FILTER (reason IS NOT NULL) AS reason FROM g GROUP BY 1, 2, 3)
SELECT *, failures * 1000000 // instances AS rate FROM s""")
def failure_stats(spark, sf):
    log = event_log(spark, sf).withColumn("day", F.dayofmonth("ts"))
    reason = F.concat(F.lit("remainder "), (F.col("payload.k") % 3).cast("string"))
    return failure.failure_stats(log, F.col("payload.value") > 100, ["day", "edge"], reason)


def signed():
    """Purchases count up, errors count down."""
    amount = cents(F.col("payload.value"))
    return F.when(F.col("edge") == "purchase", amount).when(F.col("edge") == "error", -amount).otherwise(F.lit(0))


SIGNED_SQL = """(CASE edge WHEN 'purchase' THEN CAST(round(value * 100) AS BIGINT) WHEN 'error' THEN -CAST(round(value * 100) AS BIGINT) ELSE 0 END)"""


@query("f1_fold", f"""
WITH {LOG}
SELECT corr AS correlation_id, CAST(sum({SIGNED_SQL}) AS BIGINT) AS balance, count(*) AS instances FROM log GROUP BY 1""")
def fold(spark, sf):
    return state.fold(event_log(spark, sf), balance=F.sum(signed()), instances=F.count(F.lit(1)))


@query("f1_ordered_fold", f"""
WITH RECURSIVE {LOG}, moves AS (SELECT corr, step, {SIGNED_SQL} AS d FROM log),
walk AS (SELECT corr, step, greatest(d, 0) AS balance FROM moves WHERE step = 0
         UNION ALL SELECT m.corr, m.step, greatest(walk.balance + m.d, 0) FROM walk JOIN moves m ON m.corr = walk.corr AND m.step = walk.step + 1)
SELECT corr AS correlation_id, max_by(balance, step) AS balance FROM walk GROUP BY 1""")
def ordered_fold(spark, sf):
    """A balance that never falls below zero: x -> max(floor, x + shift) composes."""
    lift = F.struct(F.lit(0).cast("bigint").alias("floor"), signed().cast("bigint").alias("shift"))
    merge = lambda a, b: F.struct(F.greatest(b["floor"], a["floor"] + b["shift"]).alias("floor"),
                                  (a["shift"] + b["shift"]).alias("shift"))
    folded = state.ordered_fold(event_log(spark, sf), lift, merge)
    return folded.select("correlation_id", F.greatest("state.floor", "state.shift").alias("balance"))


@query("f2_running_fold", f"""
WITH {LOG}
SELECT id, CAST(sum(k) OVER w AS BIGINT) AS total, max(k) OVER w AS highest, last_value(CASE WHEN edge = 'purchase' THEN id END IGNORE NULLS) OVER w AS last_purchase
FROM log WINDOW w AS (PARTITION BY corr ORDER BY step ROWS UNBOUNDED PRECEDING)""")
def running_fold(spark, sf):
    rows = state.running_fold(event_log(spark, sf), {
        "total": ("sum", F.col("payload.k")), "highest": ("max", F.col("payload.k")),
        "last_purchase": ("last", F.when(F.col("edge") == "purchase", F.col("id")))})
    return rows.select("id", "total", "highest", "last_purchase")


@query("f3_current_state", """
SELECT user_id, max(event_id) AS id, max_by(event_type, event_id) AS edge, max_by(value, event_id) AS value FROM events GROUP BY 1""")
def current_state(spark, sf):
    return state.current_state(event_log(spark, sf), ["user_id"], ["id"]).select("user_id", "id", "edge", "payload.value")


@query("f4_state_at", """
SELECT user_id, max(event_id) AS id, max_by(event_type, event_id) AS edge FROM events WHERE ts <= TIMESTAMP '2024-01-15 00:00:00' GROUP BY 1""")
def state_at(spark, sf):
    until = F.col("ts") <= F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")
    return state.state_at(event_log(spark, sf), until, ["user_id"], ["id"]).select("user_id", "id", "edge")


@query("f5_refresh", """
SELECT event_type AS edge, count(*) AS instances, max(event_id) AS last_id FROM events GROUP BY 1""")
def refresh(spark, sf):
    log = event_log(spark, sf)
    def view(rows):
        return rows.groupBy("edge").agg(F.count(F.lit(1)).alias("instances"), F.max("id").alias("last_id"))
    early = F.dayofmonth("ts") <= 15
    return state.refresh(view(log.filter(early)), view(log.filter(~early)), ["edge"], {"instances": "sum", "last_id": "max"})


@query("f5_refresh_state", "SELECT user_id, max(event_id) AS id FROM events GROUP BY 1")
def refresh_state(spark, sf):
    log = event_log(spark, sf).select("user_id", "id", "edge")
    early = state.current_state(log.filter(F.col("id") % 2 == 0), ["user_id"], ["id"])
    return state.refresh_state(early, log.filter(F.col("id") % 2 == 1), ["user_id"], ["id"]).select("user_id", "id")


@query("f6_scoped_view", """
SELECT o_orderstatus AS status, count(*) AS orders, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS total FROM orders
WHERE o_custkey IN (SELECT c_custkey FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_name = 'NATION_7') GROUP BY 1""")
def scoped_view(spark, sf):
    nation = read(spark, sf, "nation").filter(F.col("n_name") == "NATION_7")
    mine = read(spark, sf, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left_semi").select(
        F.col("c_custkey").alias("customer"))
    rows = placed(spark, sf).select("payload.*")
    return state.scoped_view(rows, mine, ["customer"], ["status"], orders=F.count(F.lit(1)), total=F.sum(cents(F.col("price"))))


@query("f7_growth_watch", f"""
WITH {LOG} SELECT corr AS correlation_id, count(*) AS instances FROM log GROUP BY 1 HAVING count(*) > 5""")
def growth_watch(spark, sf):
    return state.growth_watch(event_log(spark, sf), 5)
