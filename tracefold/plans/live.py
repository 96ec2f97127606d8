"""Streaming forms, fed in several batches that mix early and late rows, and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracefold.plans.contracts import SOLVENT
from tracefold.plans.fanin import FIRE
from tracefold.plans.fixtures import LOG, event_log, read
from tracefold.plans.outcomes import SIGNED_SQL, signed
from tracefold.plans.registry import query
from tracefold.session import scratch_path
from tracefold.streaming import operators as ops
from tracefold.streaming.tables import CurrentTable

PARTS = 3
DAY = 24 * 3600 * 1000


def _few_partitions(spark, run):
    """No more state partitions than twice the task slots."""
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(int(before), 2 * spark.sparkContext.defaultParallelism)))
    try:
        run()
    finally:
        spark.conf.set(key, before)


def feed(spark, rows, start, order=None, parts: int = PARTS, silence: str | None = None):
    """Append ``rows`` in parts, and after each run the stream that ``start(stream)`` gives to the end of what is there.

    ``order`` says which part a row is in (default: by a hash, so that every part spans the whole time).  ``silence`` is how long
    the log then stays silent, which a heartbeat tells.
    """
    path = scratch_path(spark, "feed")
    part = F.pmod(F.hash(*rows.columns[:1]), F.lit(parts)) if order is None else order

    def run():
        for i in range(parts):
            rows.filter(part == i).write.mode("append").parquet(path)
            start(ops.stream_log(spark, path, rows.schema)).awaitTermination()
        if silence is not None:
            last = spark.read.schema(rows.schema).parquet(path).agg(F.max("ts") + F.expr(f"INTERVAL {silence}")).first()[0]
            ops.heartbeat(spark, path, rows.schema, last)
            start(ops.stream_log(spark, path, rows.schema)).awaitTermination()
    _few_partitions(spark, run)


def _folders(spark, *names):
    return [scratch_path(spark, n) for n in names]


@query("k1_stream_conform", """
SELECT c_custkey AS id, c_acctbal >= 0 AS passed FROM customer""")
def stream_conform(spark, sf):
    out, state = _folders(spark, "conformed", "checkpoint")
    feed(spark, read(spark, sf, "customer"), lambda s: ops.stream_conform(s, SOLVENT, out, state))
    ok, failed = ops.conformed(spark, out)
    return ok.select("id", F.lit(True).alias("passed")).unionByName(
        failed.select(F.col("input.c_custkey").alias("id"), F.lit(False).alias("passed")))


def _fired(spark, out, edges):
    rows = spark.read.schema(ops.every_schema(edges, "bigint")).parquet(out)
    return rows.select("correlation_id", "step", F.col("id_0").cast("bigint").alias("signup_id"),
                       F.col("id_1").cast("bigint").alias("purchase_id"), F.col("body_1").cast("int").alias("k"))


@query("k2_stream_every", FIRE)
def stream_every(spark, sf):
    """The log in one go, then silence."""
    out, state = _folders(spark, "every", "checkpoint")
    edges, log = ["signup", "purchase"], event_log(spark, sf)
    feed(spark, log, lambda s: ops.stream_every(s, edges, out, state, "1 hour", DAY, F.col("payload.k")), parts=1, silence="3 DAYS")
    return _fired(spark, out, edges)


@query("k2_stream_every_any_order", FIRE)
def stream_every_any_order(spark, sf):
    """Later steps come in earlier batches: steps from 2 on, then step 0, then step 1."""
    out, state = _folders(spark, "every", "checkpoint")
    edges, log = ["signup", "purchase"], event_log(spark, sf)
    order = F.when(F.col("step") >= 2, 0).when(F.col("step") == 0, 1).otherwise(2)
    feed(spark, log, lambda s: ops.stream_every(s, edges, out, state, "40 days", DAY, F.col("payload.k")), order, silence="43 DAYS")
    return _fired(spark, out, edges)


@query("k3_stream_fold", f"""
WITH {LOG}
SELECT corr AS correlation_id, CAST(sum({SIGNED_SQL}) AS BIGINT) AS balance, count(*) AS instances FROM log GROUP BY 1""")
def stream_fold(spark, sf):
    out, state = _folders(spark, "fold", "checkpoint")
    aggregates = {"balance": F.sum(signed()), "instances": F.count(F.lit(1))}
    feed(spark, event_log(spark, sf), lambda s: ops.stream_fold(s, ["correlation_id"], aggregates, out, state, compact_after=2))
    return CurrentTable(spark, out, ["correlation_id"]).read()


@query("k4_stream_dedupe", "SELECT event_id AS id FROM events")
def stream_dedupe(spark, sf):
    """The event log with a tenth of its rows delivered again in a later batch."""
    out, state = _folders(spark, "dedupe", "checkpoint")
    events = read(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"))
    twice = events.withColumn("part", F.pmod(F.col("id"), F.lit(2)).cast("int")).unionByName(
        events.filter(F.col("id") % 10 == 0).withColumn("part", F.lit(2)))
    feed(spark, twice, lambda s: ops.stream_dedupe(s.select("id", "ts"), out, state, "40 days"), F.col("part"))
    return spark.read.schema(events.schema).parquet(out).select("id")


@query("k5_stream_append", f"WITH {LOG} SELECT edge, count(*) AS instances, CAST(sum(k) AS BIGINT) AS k FROM log GROUP BY 1")
def stream_append(spark, sf):
    out, state = _folders(spark, "appended", "checkpoint")
    log = event_log(spark, sf)
    feed(spark, log, lambda s: ops.stream_append(s, out, state))
    return spark.read.schema(log.schema).parquet(out).groupBy("edge").agg(
        F.count(F.lit(1)).alias("instances"), F.sum("payload.k").alias("k"))


@query("k6_stream_view", """
SELECT user_id, max(event_id) AS id, max_by(event_type, event_id) AS edge FROM events GROUP BY 1""")
def stream_view(spark, sf):
    out, state = _folders(spark, "view", "checkpoint")
    rows = event_log(spark, sf).select("id", "user_id", "edge")
    feed(spark, rows, lambda s: ops.stream_view(s, ["user_id"], ["id"], out, state, compact_after=2))
    return CurrentTable(spark, out, ["user_id"], ["id"]).read()


@query("k7_timeout_race", f"""
WITH {LOG}, f AS (SELECT corr, min(ts) AS start, min(ts) FILTER (edge = 'signup') AS a, min(ts) FILTER (edge = 'purchase') AS b
  FROM log WHERE edge IN ('signup', 'purchase') GROUP BY 1)
SELECT corr AS correlation_id, CASE WHEN greatest(a, b) <= start + INTERVAL 6 HOUR AND a IS NOT NULL AND b IS NOT NULL THEN 'Ready' ELSE 'TimedOut' END AS outcome
FROM f""")
def timeout_race(spark, sf):
    out, state = _folders(spark, "race", "checkpoint")
    # a correlation's rows come in one batch: a race is decided when both edges are there
    feed(spark, event_log(spark, sf), lambda s: ops.timeout_race(s, ["signup", "purchase"], DAY // 4, out, state, "40 days", DAY),
         F.pmod(F.col("correlation_id"), F.lit(PARTS)), silence="43 DAYS")
    return spark.read.schema("correlation_id bigint, outcome string").parquet(out)


@query("k8_stream_effects", f"""
WITH {LOG}
SELECT r.id AS request_id, s.id AS result_id FROM log r LEFT JOIN log s ON s.cause = r.id AND s.edge = 'purchase' AND s.ts >= r.ts AND s.ts <= r.ts + INTERVAL 12 HOUR
WHERE r.edge = 'view'""")
def stream_effects(spark, sf):
    """Views as requests, purchases as results; a request nobody answered comes out alone once silence proves it."""
    out, state = _folders(spark, "effects", "checkpoint")
    feed(spark, event_log(spark, sf), lambda s: ops.stream_effects(
        s, F.col("edge") == "view", F.col("edge") == "purchase", "12 HOURS", "40 days", out, state), silence="43 DAYS")
    return spark.read.schema("request_id bigint, request_ts timestamp, result_id bigint, result_ts timestamp").parquet(
        out).select("request_id", "result_id")
