"""Run statistics over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracefold.functions.columns import whole_seconds
from tracefold.operators import lineage as ops
from tracefold.plans.fixtures import EVENTS, LOG, event_log
from tracefold.plans.nodes import ACTIVITY, activity, decided
from tracefold.plans.registry import query


@query("j1_edge_stats", f"""
WITH {LOG}
SELECT edge, 'emit_' || edge AS node, count(*) AS instances, count(DISTINCT corr) AS correlations, 1 AS hashes,
       strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_ts, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_ts FROM log GROUP BY 1""")
def edge_stats(spark, sf):
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return ops.edge_stats(event_log(spark, sf)).select("edge", "node", "instances", "correlations", "hashes",
                                                       stamp("first_ts"), stamp("last_ts"))


_PAIRS = f"""{LOG}, pairs AS (SELECT p.edge AS source, c.edge AS target, count(*) AS instances FROM log c JOIN log p ON c.cause = p.id GROUP BY 1, 2)"""


@query("j2_transitions", f"""
WITH {_PAIRS}
SELECT source, target, instances, CAST(instances * 1000000 // sum(instances) OVER (PARTITION BY source) AS BIGINT) AS share_ppm FROM pairs""")
def transitions(spark, sf):
    return ops.transitions(event_log(spark, sf))


@query("j3_reachable", f"""
WITH {LOG}
SELECT b.edge, min(b.step - a.step) AS distance, count(DISTINCT b.corr) AS correlations FROM log a JOIN log b ON a.corr = b.corr AND b.step > a.step
WHERE a.edge = 'signup' GROUP BY 1""")
def reachable(spark, sf):
    return ops.reachable(event_log(spark, sf), "signup")


@query("j4_orphans", """
SELECT 'refund' AS edge, 'unobserved' AS finding UNION ALL SELECT DISTINCT event_type, 'undeclared' FROM events WHERE event_type = 'error'""")
def orphans(spark, sf):
    return ops.orphans(["click", "purchase", "signup", "view", "refund"], event_log(spark, sf))


_RUN = f"""{LOG}, a AS (SELECT corr, min(step) AS sa FROM log WHERE edge = 'signup' GROUP BY 1),
  run AS (SELECT corr, sa, min(step) AS sb FROM log JOIN a USING (corr) WHERE edge = 'purchase' AND step > sa GROUP BY 1, 2)"""


@query("j5_must_pass", f"""
WITH {_RUN}, total AS (SELECT count(*) AS runs FROM run)
SELECT edge, count(DISTINCT corr) AS passing, max(runs) AS runs, CAST(count(DISTINCT corr) * 1000000 // max(runs) AS BIGINT) AS share_ppm
FROM log JOIN run USING (corr), total WHERE step > sa AND step < sb GROUP BY 1""")
def must_pass(spark, sf):
    return ops.must_pass(event_log(spark, sf), "signup", "purchase")


@query("j6_bypass", f"""
WITH {LOG}
SELECT id FROM log p WHERE edge = 'purchase' AND NOT EXISTS (SELECT 1 FROM log v WHERE v.corr = p.corr AND v.edge = 'view' AND v.step < p.step)""")
def bypass(spark, sf):
    return ops.bypass(event_log(spark, sf), "purchase", "view").select("id")


_ROUTES = f"""{LOG}, r AS (SELECT corr, string_agg(edge, '>' ORDER BY step) AS route, count(*) AS steps,
  max(CASE WHEN edge = 'purchase' THEN 1 ELSE 0 END) AS ok FROM log GROUP BY 1)"""


@query("j7_routes", f"WITH {_ROUTES} SELECT route, steps, count(*) AS runs, CAST(sum(ok) AS BIGINT) AS successes FROM r GROUP BY 1, 2")
def routes(spark, sf):
    return ops.routes(event_log(spark, sf), success=F.col("edge") == "purchase", chained=True).drop("digest")


@query("j7_routes_top", f"""
WITH {_ROUTES} SELECT route, steps, count(*) AS runs, CAST(sum(ok) AS BIGINT) AS successes FROM r GROUP BY 1, 2 ORDER BY 3 DESC, 1 LIMIT 10""")
def routes_top(spark, sf):
    return ops.routes(event_log(spark, sf), top_k=10, success=F.col("edge") == "purchase").drop("digest")


@query("j8_rank_routes", f"""
WITH {_RUN}, paths AS (SELECT corr, sb - sa AS depth, string_agg(edge, '>' ORDER BY step) AS route,
    max(CASE WHEN edge = 'error' THEN 1 ELSE 0 END) = 1 AS lossy, max(CASE WHEN edge = 'purchase' THEN 1 ELSE 0 END) = 1 AS effectful,
    list({"CASE edge WHEN 'click' THEN 'client' WHEN 'view' THEN 'client' WHEN 'purchase' THEN 'payment' ELSE 'server' END"} ORDER BY step) AS z
  FROM log JOIN run USING (corr) WHERE step >= sa AND step <= sb AND sb - sa <= 4 GROUP BY 1, 2),
best AS (SELECT route, depth, lossy, effectful, z, count(*) AS runs FROM paths GROUP BY 1, 2, 3, 4, 5 ORDER BY 6 DESC, 2, 1 LIMIT 10)
SELECT route, depth, runs, lossy, effectful, len(list_filter(range(1, len(z)), lambda i: z[i] <> z[i + 1])) AS zone_hops FROM best""")
def rank_routes(spark, sf):
    flags = spark.createDataFrame([
        ("click", False, False, "client"), ("view", False, False, "client"), ("signup", False, False, "server"),
        ("purchase", False, True, "payment"), ("error", True, False, "server"),
    ], "edge string, lossy boolean, effectful boolean, zone string")
    return ops.rank_routes(event_log(spark, sf), "signup", "purchase", 4, 10, flags)


@query("j9_next_edges", f"""
WITH {_PAIRS}, s AS (SELECT source, target, instances, CAST(instances * 1000000 // sum(instances) OVER (PARTITION BY source) AS BIGINT) AS share_ppm FROM pairs)
SELECT * FROM s WHERE source = 'click' ORDER BY instances DESC, target LIMIT 3""")
def next_edges(spark, sf):
    return ops.next_edges(event_log(spark, sf), "click", 3)


@query("j10_terminal_audit", f"""
WITH {LOG}
SELECT corr AS correlation_id, max_by(edge, step) AS last_edge, max(step) AS last_step FROM log GROUP BY 1 HAVING max_by(edge, step) <> 'purchase'""")
def terminal_audit(spark, sf):
    return ops.terminal_audit(event_log(spark, sf), ["purchase"])


@query("j11_branch_stats", """
WITH g AS (SELECT CASE WHEN o_totalprice > 300000 THEN 'Big' WHEN o_totalprice > 100000 THEN 'Medium' ELSE 'Small' END AS edge,
           count(*) AS instances FROM orders WHERE o_totalprice > 10000 GROUP BY 1)
SELECT edge, instances, CAST(instances * 1000000 // sum(instances) OVER () AS BIGINT) AS share_ppm FROM g""")
def branch_stats(spark, sf):
    return ops.branch_stats(decided(spark, sf)[0])


@query("j12_latency", f"""
WITH {LOG}, d AS (SELECT p.edge AS source, c.edge AS target, CAST(floor(date_diff('microsecond', p.ts, c.ts) / 1000000) AS BIGINT) AS s
  FROM log c JOIN log p ON c.cause = p.id),
n AS (SELECT *, row_number() OVER (PARTITION BY source, target ORDER BY s) AS r, count(*) OVER (PARTITION BY source, target) AS c FROM d)
SELECT source, target, count(*) AS instances, CAST(sum(s) // count(*) AS BIGINT) AS mean_s,
       max(s) FILTER (r = (c * 500 + 999) // 1000) AS p50, max(s) FILTER (r = (c * 900 + 999) // 1000) AS p90,
       max(s) FILTER (r = (c * 990 + 999) // 1000) AS p99 FROM n GROUP BY 1, 2""")
def latency(spark, sf):
    return ops.latency(event_log(spark, sf), whole_seconds)


@query("j13_lossy_audit", """
SELECT event_type AS source_edge, count(*) AS instances, 'value' AS lost_fields FROM events GROUP BY 1""")
def lossy_audit(spark, sf):
    return ops.lossy_audit(activity(spark, sf), EVENTS.values(), ACTIVITY)
