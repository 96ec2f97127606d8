"""Replay, effects and causal closure over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracefold.operators import replay as ops
from tracefold.operators.nodes import Node, apply, check_output
from tracefold.plans.fixtures import LOG, SIZED, SIZED_SQL, event_log, sized
from tracefold.plans.nodes import BIRTHDAY
from tracefold.plans.registry import query

LEAP = Node("birthday", SIZED, SIZED, lambda p: {"size": p["size"] + F.when(p["size"] > 25, 2).otherwise(1)}, version="2")


def recorded(spark, sf):
    """Inputs and the recorded outputs of ``birthday``, typed by its contract."""
    inputs = sized(spark, sf)
    return inputs, check_output(apply(BIRTHDAY, inputs), SIZED)[0]


@query("g1_replay", f"""
WITH {SIZED_SQL} SELECT sha256(id || '|birthday|Sized|0') AS id, id AS causation_id, size + 1 AS size FROM sized""")
def replay(spark, sf):
    inputs, outputs = recorded(spark, sf)
    return ops.replay(inputs.unionByName(outputs), BIRTHDAY).select("id", "causation_id", "payload.size")


@query("g2_replay_diff", f"""
WITH {SIZED_SQL}
SELECT id AS causation_id, CASE WHEN corr % 13 = 0 THEN 'extra' WHEN corr % 11 = 0 THEN 'missing' WHEN size > 25 THEN 'changed' ELSE 'same' END AS status,
       CASE WHEN corr % 11 <> 0 THEN size + 1 END AS recorded,
       CASE WHEN corr % 13 <> 0 THEN size + CASE WHEN size > 25 THEN 2 ELSE 1 END END AS recomputed
FROM sized WHERE NOT (corr % 11 = 0 AND corr % 13 = 0)""")
def replay_diff(spark, sf):
    """A changed implementation against a log that lost some inputs and some outputs."""
    inputs, outputs = recorded(spark, sf)
    log = inputs.filter(F.col("correlation_id") % 13 != 0).unionByName(
        outputs.filter(F.col("correlation_id") % 11 != 0))
    rows = ops.replay_diff(log, LEAP)
    return rows.select("causation_id", "status", F.col("recorded.size").cast("int").alias("recorded"),
                       F.col("recomputed.size").cast("int").alias("recomputed"))


@query("g2_replay_repeat", f"""
WITH {SIZED_SQL}
SELECT 'same' AS status, count(*) * 3 AS instances FROM sized""")
def replay_repeat(spark, sf):
    """A node fed by its own output three times, replayed unchanged."""
    inputs = sized(spark, sf)
    stages, last = [inputs], inputs
    for _ in range(3):
        last = check_output(apply(BIRTHDAY, last), SIZED)[0]
        stages.append(last)
    log = stages[0].unionByName(stages[1]).unionByName(stages[2]).unionByName(stages[3])
    return ops.replay_diff(log, BIRTHDAY).groupBy("status").agg(F.count(F.lit(1)).alias("instances"))


@query("g3_replay_pinned", f"""
WITH {SIZED_SQL}
SELECT id AS causation_id, CASE corr % 2 WHEN 0 THEN '1' ELSE '2' END AS impl_version,
       size + CASE WHEN corr % 2 = 1 AND size > 25 THEN 2 ELSE 1 END AS recorded,
       size + CASE WHEN corr % 2 = 1 AND size > 25 THEN 2 ELSE 1 END AS recomputed FROM sized""")
def replay_pinned(spark, sf):
    inputs = sized(spark, sf)
    odd = F.col("correlation_id") % 2 == 1
    outputs = apply(BIRTHDAY, inputs.filter(~odd)).unionByName(apply(LEAP, inputs.filter(odd)))
    pins = outputs.select(F.col("causation_id").alias("id"), "impl_version")
    rows = ops.replay_pinned(inputs, outputs, {"1": BIRTHDAY, "2": LEAP}, pins)
    return rows.select("causation_id", "impl_version", F.col("recorded.size").alias("recorded"),
                       F.col("recomputed.size").alias("recomputed"))


@query("g4_effects_resolve", f"""
WITH {LOG}
SELECT r.id AS id, s.id AS result_id, s.k AS k FROM log r LEFT JOIN log s ON s.cause = r.id AND s.edge = 'purchase' WHERE r.edge = 'view'""")
def effects_resolve(spark, sf):
    log = event_log(spark, sf)
    rows = ops.effects_resolve(log.filter(F.col("edge") == "view"), log.filter(F.col("edge") == "purchase"))
    return rows.select("id", "result_id", "result.k")


@query("g5_effects_pending", f"""
WITH {LOG}
SELECT id FROM log WHERE edge = 'view' AND id NOT IN (SELECT cause FROM log WHERE edge = 'purchase' AND cause IS NOT NULL)""")
def effects_pending(spark, sf):
    log = event_log(spark, sf)
    return ops.effects_pending(log.filter(F.col("edge") == "view"), log.filter(F.col("edge") == "purchase")).select("id")


@query("g6_ancestors", f"""
WITH {LOG}, tip AS (SELECT corr, max(step) AS last, max_by(id, step) AS seed FROM log GROUP BY 1)
SELECT seed, id, last - step AS depth FROM log JOIN tip USING (corr)""")
def ancestors(spark, sf):
    log = event_log(spark, sf)
    tips = log.groupBy("correlation_id").agg(F.max_by("id", "step").alias("id"))
    return ops.ancestors(log, tips)


@query("g6_descendants", f"""
WITH {LOG}, tip AS (SELECT corr, min_by(id, step) AS seed FROM log GROUP BY 1)
SELECT seed, id, step AS depth FROM log JOIN tip USING (corr)""")
def descendants(spark, sf):
    log = event_log(spark, sf)
    return ops.descendants(log, log.filter(F.col("causation_id").isNull()))


@query("g6_ancestors_of_one", f"""
WITH {LOG}, tip AS (SELECT corr, step AS last, id AS seed FROM log ORDER BY step DESC, id LIMIT 1)
SELECT seed, id, last - step AS depth FROM log JOIN tip USING (corr) WHERE step <= last""")
def ancestors_of_one(spark, sf):
    """The causes of the one row that has the most of them."""
    log = event_log(spark, sf)
    return ops.ancestors(log, log.orderBy(F.desc("step"), "id").limit(1))


_CHECK_SQL = """
SELECT 'orphan_cause' AS fault, count(*) AS faults FROM t c WHERE cause IS NOT NULL AND cause NOT IN (SELECT id FROM t)
UNION ALL SELECT 'step_not_after_cause', count(*) FROM t c JOIN t p ON c.cause = p.id WHERE c.step <= p.step
UNION ALL SELECT 'correlation_changed', count(*) FROM t c JOIN t p ON c.cause = p.id WHERE c.corr <> p.corr
UNION ALL SELECT 'several_roots', count(*) FROM (SELECT corr FROM t WHERE cause IS NULL GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'step_gap', count(*) FROM (SELECT corr FROM t GROUP BY 1 HAVING count(DISTINCT step) <> max(step) - min(step) + 1)"""


@query("g7_check_causation", f"WITH {LOG}, t AS (SELECT * FROM log) {_CHECK_SQL}")
def check_causation(spark, sf):
    return ops.check_causation(event_log(spark, sf))


@query("g7_check_causation_seeded", f"""
WITH {LOG}, t AS (SELECT id, CASE WHEN id % 83 = 0 THEN corr + 1 ELSE corr END AS corr,
  CASE WHEN id % 97 = 0 THEN -1 - id WHEN id % 79 = 0 THEN NULL ELSE cause END AS cause,
  CASE WHEN id % 89 = 0 THEN 0 ELSE step END AS step FROM log) {_CHECK_SQL}""")
def check_causation_seeded(spark, sf):
    i = F.col("id")
    bad = event_log(spark, sf).withColumns({
        "correlation_id": F.when(i % 83 == 0, F.col("correlation_id") + 1).otherwise(F.col("correlation_id")),
        "causation_id": F.when(i % 97 == 0, -1 - i).when(i % 79 == 0, F.lit(None)).otherwise(F.col("causation_id")),
        "step": F.when(i % 89 == 0, 0).otherwise(F.col("step")),
    })
    return ops.check_causation(bad)


@query("g8_version_audit", f"""
WITH {LOG}
SELECT 'emit_' || edge AS node, CASE WHEN step < 2 THEN '1' ELSE '2' END AS impl_version, count(*) AS instances,
       strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_ts, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_ts,
       step < 2 OR edge = 'view' AS accepted FROM log GROUP BY 1, 2, 6""")
def version_audit(spark, sf):
    log = event_log(spark, sf).withColumn("impl_version", F.when(F.col("step") < 2, "1").otherwise("2"))
    known = [(f"emit_{e}", "1") for e in ("click", "error", "purchase", "signup", "view")] + [("emit_view", "2")]
    accepted = spark.createDataFrame(known, "node string, impl_version string")
    rows = ops.version_audit(log, accepted)
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return rows.select("node", "impl_version", "instances", stamp("first_ts"), stamp("last_ts"), "accepted")


@query("g9_promote_examples", f"""
WITH {LOG}
SELECT c.id AS id, c.k AS given_k, e.k AS expect_k FROM log c JOIN log e ON e.cause = c.id WHERE c.edge = 'view' AND e.edge = 'purchase'
ORDER BY sha256(CAST(c.id AS VARCHAR)), c.id LIMIT 20""")
def promote_examples(spark, sf):
    rows = ops.promote_examples(event_log(spark, sf), "view", "purchase", 20)
    return rows.select("id", F.col("given.k").alias("given_k"), F.col("expect.k").alias("expect_k"))
