"""Replay from recorded inputs, effects, causal closure, and version records."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracefold.operators.nodes import PAYLOAD, Node, apply
from tracefold.session import materialize

CORR = "correlation_id"
#: A frontier of more than one in FEW links, or one that has gone STEPS links deep, is followed by doubling.
FEW, STEPS = 16, 32


def replay(log: DataFrame, node: Node, inputs: Column | None = None) -> DataFrame:
    """Outputs recomputed from the recorded inputs; nothing is inverted or performed.

    ``inputs`` tells which rows fed the node.  By default: rows of its input
    edge that it did not produce itself, and of its own rows those that a
    recorded row of it names as cause (a node fed by its own output).
    """
    if inputs is not None:
        return apply(node, log.filter(inputs), wired=True)
    own = F.col("node").eqNullSafe(node.name)
    rows = log.filter(F.col("edge") == node.input.name)
    causes = log.filter(own & F.col("causation_id").isNotNull()).select(F.col("causation_id").cast("string").alias("__fed"))
    again = rows.filter(own).join(causes, F.col("id").cast("string") == F.col("__fed"), "left_semi")
    return apply(node, rows.filter(~own).unionByName(again), wired=True)


def replay_diff(log: DataFrame, node: Node, inputs: Column | None = None,
                key: tuple[str, ...] = ("causation_id",)) -> DataFrame:
    """Each recorded or recomputed output as same, changed, missing or extra.

    ``missing``: recomputed but not in the log; ``extra``: in the log only.
    Nodes with several outputs per input need the ordinal in ``key``.
    """
    shape = log.schema[PAYLOAD].dataType.simpleString()
    recorded = log.filter(F.col("node") == node.name).select(
        *key, F.col(PAYLOAD).alias("recorded"), F.lit(True).alias("__r"))
    fresh = replay(log, node, inputs).select(
        *key, F.col(PAYLOAD).cast(shape).alias("recomputed"), F.lit(True).alias("__f"))
    status = (F.when(F.col("__r").isNull(), "missing").when(F.col("__f").isNull(), "extra")
              .when(F.col("recorded").eqNullSafe(F.col("recomputed")), "same").otherwise("changed"))
    return recorded.join(fresh, list(key), "full").select(*key, "recorded", "recomputed", status.alias("status"))


def replay_pinned(log: DataFrame, recorded: DataFrame, impls: Mapping[str, Node],
                  pins: DataFrame) -> DataFrame:
    """Recompute each row under the version it ran with.

    ``pins(id, impl_version)`` says which version consumed the input ``id``;
    rows under a version that is no longer known get a null payload.
    """
    inputs = log.join(pins.select("id", F.col("impl_version").alias("__pin")), "id")
    body = None
    for version, node in impls.items():
        hit, value = F.col("__pin") == version, node.payload(F.col(PAYLOAD))
        body = F.when(hit, value) if body is None else body.when(hit, value)
    again = inputs.select(F.col("id").cast("string").alias("causation_id"), "__pin", body.alias("recomputed"))
    return (recorded.select("causation_id", F.col(PAYLOAD).alias("recorded"))
            .join(again, "causation_id")
            .select("causation_id", F.col("__pin").alias("impl_version"), "recorded", "recomputed"))


# -- effects ----------------------------------------------------------------

def effects_resolve(requests: DataFrame, results: DataFrame) -> DataFrame:
    """Each request with its recorded result, if there is one."""
    found = results.select(F.col("causation_id").alias("id"), F.col("id").alias("result_id"),
                           F.col("ts").alias("result_ts"), F.col(PAYLOAD).alias("result"))
    return requests.join(found, "id", "left")


def effects_pending(requests: DataFrame, results: DataFrame) -> DataFrame:
    done = results.filter(F.col("causation_id").isNotNull()).select(F.col("causation_id").alias("id")).distinct()
    return requests.join(done, "id", "left_anti")


# -- causal closure ---------------------------------------------------------

def ancestors(log: DataFrame, seeds: DataFrame) -> DataFrame:
    """(seed, id, depth) for every seed and all its causes; the seed is depth 0."""
    return _closure(log, seeds, up=True)


def descendants(log: DataFrame, seeds: DataFrame) -> DataFrame:
    """(seed, id, depth) for every seed and all its effects; the seed is depth 0."""
    return _closure(log, seeds, up=False)


def _closure(log: DataFrame, seeds: DataFrame, up: bool) -> DataFrame:
    """Step by step from few seeds, by doubling from many.

    A step joins what was reached last with the links, so its cost follows the seeds: the links are scanned, and only a frontier
    that is itself large is shuffled.  Where the frontier is a large part of the log, or has walked STEPS links, jumps
    are doubled instead: a chain of depth d then needs log2(d) joins.  Both give the same rows.
    """
    links = materialize(log.filter(F.col("causation_id").isNotNull()).select("id", F.col("causation_id").cast(
        log.schema["id"].dataType).alias("above")), "links")
    all_links, steps = links.count(), 0
    frontier = materialize(seeds.select(F.col("id").alias("seed")).distinct().select("seed", F.col("seed").alias("id"), F.lit(0).alias("depth")), "reach")
    pieces, moving = [frontier], frontier.count()
    while moving and moving * FEW <= all_links and steps < STEPS:
        frontier = materialize(_hop(frontier, links, up, 1), "reach")
        pieces.append(frontier)
        moving, steps = frontier.count(), steps + 1
    if moving:
        pieces = [*pieces[:-1], *_doubled(links, frontier, up)]
    return reduce(DataFrame.unionByName, pieces)


def _hop(reach: DataFrame, jump: DataFrame, up: bool, far: int) -> DataFrame:
    here, there = ("id", "above") if up else ("above", "id")
    hop = jump.select(F.col(here).alias("__at"), F.col(there).alias("__to"))
    return reach.join(hop, reach["id"] == hop["__at"]).select("seed", F.col("__to").alias("id"), (F.col("depth") + far).alias("depth"))


def _doubled(jump: DataFrame, start: DataFrame, up: bool) -> list[DataFrame]:
    """Everything reached from ``start``, by jumps that double in every round."""
    pieces, left, k = [start], jump.count(), 0
    while left:
        pieces.append(materialize(_hop(reduce(DataFrame.unionByName, pieces), jump, up, 1 << k), "reach"))
        upper = jump.select(F.col("id").alias("above"), F.col("above").alias("__up"))
        jump = materialize(jump.join(upper, "above").select("id", F.col("__up").alias("above")), "jump")
        # Rows near a root drop out in every round, unless there is no root.
        before, left, k = left, jump.count(), k + 1
        if left >= before:
            raise ValueError("causes contain a cycle")
    return pieces


def check_causation(log: DataFrame) -> DataFrame:
    """One row per kind of fault, with the number of rows or correlations that have it."""
    rows = log.select("id", CORR, "causation_id", "step")
    parents = log.select(F.col("id").alias("causation_id"), F.col(CORR).alias("__corr"), F.col("step").alias("__step"),
                         F.lit(True).alias("__known"))
    children = rows.filter(F.col("causation_id").isNotNull()).join(parents, "causation_id", "left")

    def count(cond: Column) -> Column:
        return F.coalesce(F.sum(F.when(cond, 1).otherwise(0)), F.lit(0)).cast("bigint")

    links = children.agg(
        count(F.col("__known").isNull()).alias("orphan_cause"),
        count(F.col("step") <= F.col("__step")).alias("step_not_after_cause"),
        count(F.col(CORR) != F.col("__corr")).alias("correlation_changed"))
    groups = rows.groupBy(CORR).agg(
        F.sum(F.when(F.col("causation_id").isNull(), 1).otherwise(0)).alias("roots"),
        F.countDistinct("step").alias("steps"), F.max("step").alias("last"), F.min("step").alias("first"))
    wholes = groups.agg(
        count(F.col("roots") > 1).alias("several_roots"),
        count(F.col("steps") != F.col("last") - F.col("first") + 1).alias("step_gap"))
    def listed(df: DataFrame) -> DataFrame:
        return df.select(F.inline(F.array(*[
            F.struct(F.lit(k).alias("fault"), F.col(k).alias("faults")) for k in df.columns])))
    return listed(links).unionByName(listed(wholes))


def version_audit(log: DataFrame, accepted: DataFrame) -> DataFrame:
    """Rows and time range per node, version and hash; ``accepted`` tells known versions."""
    seen = log.groupBy("node", "impl_version", "schema_hash").agg(
        F.count(F.lit(1)).alias("instances"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    known = accepted.select("node", "impl_version").distinct().withColumn("__known", F.lit(True))
    return seen.join(known, ["node", "impl_version"], "left").select(
        *seen.columns, F.col("__known").isNotNull().alias("accepted"))


def promote_examples(log: DataFrame, source: str, target: str, n: int) -> DataFrame:
    """n given/expect pairs from recorded cause and effect, chosen by a hash of the cause id.

    The limit is the feature; Spark keeps only n rows per task on the way.
    """
    given = log.filter(F.col("edge") == source).select("id", F.col(PAYLOAD).alias("given"))
    expect = log.filter(F.col("edge") == target).select(F.col("causation_id").alias("id"),
                                                        F.col(PAYLOAD).alias("expect"))
    return given.join(expect, "id").orderBy(F.sha2(F.col("id").cast("string"), 256), "id").limit(n)
