"""One query through the whole library: check, wait for all inputs, compute, log."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracefold.contract import Edge, Field
from tracefold.functions.columns import cents
from tracefold.operators.conform import is_valid, violations
from tracefold.operators.failure import failed_rows
from tracefold.operators.fanin import apply_every
from tracefold.plans.fixtures import EVENT, LOG, event_log
from tracefold.plans.registry import query

BOUNDED = Edge("Bounded", "Bounded event", "An event of at most 100", {
    "value": Field("f64", "Value", "Amount", nullable=False, max=100), "k": EVENT.fields["k"]})
PAIRED = Edge("Paired", "Paired", "Sum of a signup and a purchase", {
    "cents": Field("uint32", "Cents", "Sum in cents", nullable=False)})


@query("flagship", f"""
WITH {LOG}, good AS (SELECT * FROM log WHERE value <= 100), bag AS (
  SELECT corr, max_by(value, step) FILTER (edge = 'signup') AS s, max_by(value, step) FILTER (edge = 'purchase') AS p,
         max(step) AS step, max_by(id, step) AS cause
  FROM good WHERE edge IN ('signup', 'purchase') GROUP BY 1 HAVING count(DISTINCT edge) = 2)
SELECT sha256(cause || '|add|Paired|0') AS id, corr AS correlation_id, CAST(cause AS VARCHAR) AS causation_id, step + 1 AS step, 'Paired' AS edge,
       CAST(round(s * 100) AS BIGINT) + CAST(round(p * 100) AS BIGINT) AS cents, CAST(NULL AS VARCHAR) AS reason FROM bag
UNION ALL
SELECT sha256(id || '|add|Failed<Bounded>|0'), corr, CAST(id AS VARCHAR), step + 1, 'Failed<Bounded>', NULL, 'value:max'
FROM log WHERE value > 100""")
def flagship(spark, sf):
    log = event_log(spark, sf)
    fits = is_valid(log, BOUNDED, "domain", "payload")
    paired = apply_every(
        log.filter(fits), ["signup", "purchase"], "add", PAIRED,
        lambda bag: {"cents": cents(bag["signup"]["value"]) + cents(bag["purchase"]["value"])})
    columns = ["id", "correlation_id", "causation_id", "step", "edge"]
    why = F.transform(violations(log, BOUNDED, "domain", "payload"), lambda v: F.concat(v["path"], F.lit(":"), v["rule"]))
    failed = failed_rows(log.filter(~F.coalesce(fits, F.lit(False))), BOUNDED, F.array_join(why, ","), "add")
    return paired.select(*columns, "payload.cents", F.lit(None).cast("string").alias("reason")).unionByName(
        failed.select(*columns, F.lit(None).cast("bigint").alias("cents"), "payload.reason"))
