"""Failures as rows: catching, retrying, dead letters, statistics."""

from __future__ import annotations

import inspect
from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracefold.contract import Edge
from tracefold.functions.columns import share
from tracefold.functions.outcomes import settle
from tracefold.operators.boundary import checked, failed_struct, missing_values, ok_struct
from tracefold.operators.nodes import PAYLOAD, Node
from tracefold.sources.log import child_envelope, unified


def failed_rows(log: DataFrame, edge: Edge, reason: Column, node: str) -> DataFrame:
    """``Failed<edge>`` rows caused by ``log``: payload {input, reason}."""
    return log.select(
        *child_envelope(node, F.lit(edge.failed()), F.lit(None).cast("string")),
        F.struct(F.col(PAYLOAD).alias("input"), reason.cast("string").alias("reason")).alias(PAYLOAD))


def guard(node: Node, log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Apply a node with ordinary errors caught: (output rows, ``Failed`` rows).  No row aborts the job; the log is read once.

    The body's own operators give null where they would raise, and a null in a non-nullable output field marks a caught
    error.  What else could raise (a plain ``/`` on the result of a function) is refused before anything runs.
    """
    inputs = checked(node, log.filter(F.col("edge") == node.input.name))
    broken, which = missing_values(node.output)
    reason = F.concat(F.lit("no value for "), which)
    return settle(inputs, ~broken, ok_struct(node), failed_struct(node.input.failed(), node.name, reason), "guard")


def fail_where(log: DataFrame, condition: Column, edge: Edge, reason: Column, node: str) -> tuple[DataFrame, DataFrame]:
    """The author's own failure: (rows that go on, Failed rows with this reason)."""
    hit = F.coalesce(condition, F.lit(False))
    return log.filter(~hit), failed_rows(log.filter(hit), edge, reason, node)


def retry(failed: DataFrame, node: Node, n: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Feed the inputs of ``Failed`` rows to ``node`` again, up to ``n`` times: (outputs, all attempts, dead letters).

    Every attempt is a log row caused by the failure it answers: an output row where it worked, else a new ``Failed`` row, which
    the next attempt answers.  Attempts only read what is still failed.  A body that takes ``attempt`` is told its
    number, from 1.  Outputs carry ``attempts``; dead letters are the ``Failed`` rows of the last attempt, or of those given if n is 0.
    """
    takes_number = "attempt" in inspect.signature(node.body).parameters
    left, outputs, tried = failed, [], []
    for k in range(1, n + 1):
        this = replace(node, closure={**node.closure, "attempt": k}) if takes_number else node
        inputs = left.withColumn("__failed", F.col(PAYLOAD)).withColumn(PAYLOAD, F.col(f"{PAYLOAD}.input"))
        rows = checked(this, inputs)
        broken, which = missing_values(node.output)
        bad = failed_struct(node.input.failed(), node.name, F.concat(F.lit(f"attempt {k}: no value for "), which))
        ok, left = settle(rows, ~broken, ok_struct(node), bad, "retry")
        outputs.append(ok.withColumn("attempts", F.lit(k)))
        tried += [ok, left]
        if left.isEmpty():
            break
    outcome = node.output.struct_type()
    none = failed.limit(0).select(*child_envelope(node.name, F.lit(node.output.name), F.lit(node.output.schema_hash)),
                                  F.lit(None).cast(outcome.simpleString()).alias(PAYLOAD), F.lit(0).alias("attempts"))
    worked = reduce(DataFrame.unionByName, outputs) if outputs else none
    attempts = unified(tried) if tried else unified([failed.limit(0)])
    return worked, attempts, left


def retry_inline(failed: DataFrame, attempt: Callable[[int, Column], tuple[Column, Column]], n: int,
          value: str = PAYLOAD) -> DataFrame:
    """Try failed inputs up to n times in one pass.

    ``attempt(k, input)`` gives (succeeds?, result) of the k-th try, 1-based.
    Adds ``attempts``, ``succeeded`` and ``result``.
    """
    source = F.col(value)
    tries = [attempt(k, source) for k in range(1, n + 1)]
    at, result = None, None
    for k, (good, out) in enumerate(tries, 1):
        good = F.coalesce(good, F.lit(False))
        at = F.when(good, F.lit(k)) if at is None else at.when(good, F.lit(k))
        result = F.when(good, out) if result is None else result.when(good, out)
    return failed.withColumns({
        "attempts": F.coalesce(at, F.lit(n)),
        "succeeded": at.isNotNull(),
        "result": result,
    })


def dead_letter(retried: DataFrame) -> DataFrame:
    """Rows that no try of ``retry_inline`` could save."""
    return retried.filter(~F.col("succeeded")).drop("result")


def unhandled_failures(log: DataFrame, is_failure: Column) -> DataFrame:
    """Failure rows that caused nothing: nobody consumed them."""
    consumed = log.filter(F.col("causation_id").isNotNull()).select(F.col("causation_id").alias("id")).distinct()
    return log.filter(is_failure).join(consumed, "id", "left_anti")


def failure_stats(log: DataFrame, is_failure: Column, by: list[str], reason: Column | None = None) -> DataFrame:
    """Counts, failures and their rate (in millionths) with subtotals over the ``by`` columns, left to right.

    With ``reason`` the most frequent reason of each group's failures comes along (of equally frequent ones the smallest).
    """
    hit = F.coalesce(is_failure, F.lit(False))
    if reason is None:
        return (log.rollup(*by).agg(F.count(F.lit(1)).alias("instances"), F.count(F.when(hit, 1)).alias("failures"), F.grouping_id().alias("level"))
                .withColumn("rate", share(F.col("failures"), F.col("instances"))))
    # one row per group and reason first, so that the subtotals add up few rows
    narrow = log.select(*by, F.when(hit, F.coalesce(reason.cast("string"), F.lit("unknown"))).alias("__reason"))
    counted = narrow.groupBy(*by, "__reason").agg(F.count(F.lit(1)).alias("__n"))
    sets = [by[:i] for i in range(len(by) + 1)]
    marked = counted.select("*", F.explode(F.array(*[F.lit(len(s)) for s in sets])).alias("__depth"))
    kept = [F.when(F.col("__depth") > i, F.col(c)).alias(c) for i, c in enumerate(by)]
    per = marked.select(*kept, "__depth", "__reason", "__n").groupBy(*by, "__depth", "__reason").agg(F.sum("__n").alias("__n"))
    top = F.min(F.when(F.col("__reason").isNotNull(), F.struct((-F.col("__n")).alias("n"), F.col("__reason").alias("reason"))))
    whole = per.groupBy(*by, "__depth").agg(F.sum("__n").alias("instances"), F.coalesce(F.sum(F.when(F.col("__reason").isNotNull(), F.col("__n"))), F.lit(0)).alias("failures"),
                                           top.alias("__top"))
    ids = F.element_at(F.array(*[F.lit((1 << (len(by) - d)) - 1).cast("long") for d in range(len(by) + 1)]), F.col("__depth") + 1)
    return whole.select(*by, "instances", "failures", ids.alias("level"), share(F.col("failures"), F.col("instances")).alias("rate"),
                        F.col("__top.reason").alias("reason"))
