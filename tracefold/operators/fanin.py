"""Fan-in: readiness by correlation, latest instances, lookups along relations."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracefold.contract import Edge
from tracefold.functions.columns import all_true
from tracefold.functions.outcomes import settle
from tracefold.functions.ordered import Ordered
from tracefold.operators.conform import is_valid, violations
from tracefold.operators.nodes import PAYLOAD, collect_many
from tracefold.session import materialize
from tracefold.sources.log import child_envelope

CORR = "correlation_id"


def _at() -> Column:
    """Order inside a correlation; the id settles ties."""
    return F.struct("step", "id")


def latest(log: DataFrame, edge: str | None = None) -> DataFrame:
    """The last instance per (correlation, edge); merged before the shuffle."""
    rows = log if edge is None else log.filter(F.col("edge") == edge)
    rest = [c for c in rows.columns if c not in (CORR, "edge")]
    return (rows.groupBy(CORR, "edge").agg(F.max_by(F.struct(*rest), _at()).alias("__row"))
                .select(CORR, "edge", "__row.*"))


def _picked(carry: tuple[str, ...]) -> Column:
    return F.struct("id", "step", *carry)


def _latest_bag(rows: DataFrame, edges: list[str], carry: tuple[str, ...]) -> DataFrame:
    bag = rows.groupBy(CORR).agg(*[
        F.max_by(_picked(carry), F.when(F.col("edge") == e, _at())).alias(e) for e in edges])
    return bag.filter(all_true([F.col(f"`{e}`").isNotNull() for e in edges]))


def _firing_bag(rows: DataFrame, edges: list[str], carry: tuple[str, ...]) -> DataFrame:
    """The last values seen per edge, at the first step where none is lacking.

    One ordered pass; each edge is tested by itself, since greatest() skips nulls.
    """
    held = Ordered(rows, [CORR], ["step", "id"]).running({
        f"__{i}": ("last", F.when(F.col("edge") == e, _picked(carry))) for i, e in enumerate(edges)})
    ready = held.df.filter(all_true([F.col(f"__{i}").isNotNull() for i in range(len(edges))]))
    first = F.struct(-F.col("step"), "id")  # the last row of the first ready step
    return ready.groupBy(CORR).agg(*[
        F.max_by(F.col(f"__{i}"), first).alias(e) for i, e in enumerate(edges)])


def every(log: DataFrame, edges: list[str], at: str = "latest", carry: tuple[str, ...] = (PAYLOAD,)) -> DataFrame:
    """One row per correlation in which all ``edges`` are present.

    Each edge becomes a column {id, step, payload}; ``carry`` names what to
    take along.  ``at="latest"`` reads the last instances; ``at="fire"`` reads
    them as they stood when the last missing edge first arrived.  ``step`` is
    the step at which that holds, ``causation_id`` the latest contributing
    row, ``parents`` all of them.
    """
    readings = {"latest": _latest_bag, "fire": _firing_bag}
    if at not in readings:
        raise ValueError(f"unknown reading {at!r}")
    bag = readings[at](log.filter(F.col("edge").isin(*edges)), edges, carry)
    parents = F.sort_array(F.array(*[F.struct(F.col(f"`{e}`.step"), F.col(f"`{e}`.id")) for e in edges]))
    return bag.select(CORR, *[F.col(f"`{e}`") for e in edges],
                      F.element_at(parents, -1)["step"].alias("step"),
                      F.element_at(parents, -1)["id"].alias("causation_id"),
                      F.transform(parents, lambda p: p["id"]).alias("parents"))


def apply_every(log: DataFrame, edges: list[str], node: str, output: Edge,
                body: Callable[[Mapping[str, Column]], Mapping[str, Column]], at: str = "latest",
                impl_version: str = "1") -> DataFrame:
    """A multi-input node: one output row per ready correlation.

    ``body`` gets the payload columns keyed by edge name.  The latest
    contributing row is the cause; ``parents`` lists all of them.
    """
    bag = every(log, edges, at, (PAYLOAD, "ts", "identity"))
    out = body({e: F.col(f"`{e}`.{PAYLOAD}") for e in edges})
    last = F.element_at(F.sort_array(F.array(*[
        F.struct(F.col(f"`{e}`.step"), F.col(f"`{e}`.id"), F.col(f"`{e}`.ts"), F.col(f"`{e}`.identity")) for e in edges])), -1)
    caused = bag.withColumns({"id": F.col("causation_id"), "ts": last["ts"], "identity": last["identity"]})
    return caused.select(
        *child_envelope(node, F.lit(output.name), F.lit(output.schema_hash), impl_version=impl_version),
        F.struct(*[out[n].alias(n) for n in output.fields]).alias(PAYLOAD), "parents")


def not_ready(log: DataFrame, edges: list[str]) -> DataFrame:
    """Correlations with some but not all of ``edges``, and which are missing."""
    seen = (log.filter(F.col("edge").isin(*edges)).groupBy(CORR).agg(*[
        F.max(F.when(F.col("edge") == e, F.lit(1))).alias(e) for e in edges]))
    lacking = F.array_compact(F.array(*[F.when(F.col(f"`{e}`").isNull(), F.lit(e)) for e in edges]))
    return seen.select(CORR, lacking.alias("missing")).filter(F.size("missing") > 0)


def every_checked(log: DataFrame, contracts: Mapping[str, Edge],
                  level: str = "shape") -> tuple[DataFrame, DataFrame]:
    """``every`` whose inputs are validated: (valid bags, Failed rows with reasons)."""
    bag = every(log, list(contracts))
    parts = {}
    for name, contract in contracts.items():
        inner = bag.select(F.col(f"`{name}`.{PAYLOAD}").alias(PAYLOAD))
        parts[name] = (violations(inner, contract, level, PAYLOAD), is_valid(inner, contract, level, PAYLOAD))
    opened = bag
    for name in contracts:
        opened = opened.withColumn(PAYLOAD, F.col(f"`{name}`.{PAYLOAD}"))
        found, good = parts[name]
        opened = opened.withColumns({f"__ok_{name}": F.coalesce(good, F.lit(False)),
                                     f"__bad_{name}": _prefixed(found, name)})
    opened = opened.drop(PAYLOAD)
    fine = all_true([F.col(f"`__ok_{n}`") for n in contracts])
    helpers = [f"__{k}_{n}" for n in contracts for k in ("ok", "bad")]
    ok = F.struct(*[F.col(f"`{c}`") for c in opened.columns if c not in helpers])
    failed = F.struct(
        CORR, "causation_id", "step", F.lit("Failed<every>").alias("edge"),
        F.struct(F.struct(*[F.col(f"`{n}`") for n in contracts]).alias("input"),
                 F.concat(*[F.col(f"`__bad_{n}`") for n in contracts]).alias("reason")).alias(PAYLOAD))
    return settle(opened, fine, ok, failed, "every-checked")


def _prefixed(found: Column, name: str) -> Column:
    return F.transform(found, lambda v: F.struct(
        F.concat(F.lit(name + "."), v["path"]).alias("path"), v["rule"].alias("rule"), v["actual"].alias("actual")))


def any_of(log: DataFrame, edges: list[str]) -> DataFrame:
    """The earliest instance per correlation among several edges."""
    rows = log.filter(F.col("edge").isin(*edges))
    rest = [c for c in rows.columns if c != CORR]
    return rows.groupBy(CORR).agg(F.min_by(F.struct(*rest), _at()).alias("__row")).select(CORR, "__row.*")


def first(log: DataFrame, edge: str) -> DataFrame:
    return any_of(log, [edge])


def each(log: DataFrame, edge: str) -> DataFrame:
    return log.filter(F.col("edge") == edge)


# -- relations --------------------------------------------------------------

def lookup(df: DataFrame, key: str, other: DataFrame, other_key: str) -> tuple[DataFrame, DataFrame]:
    """many:1 enrichment: (matched rows, Failed rows whose key has no match, or more than one).

    One left join decides both sides.  The other side is reduced to a row per key before it meets the join, so a key
    that is there several times cannot multiply a row: it is a broken relation, and the reason says so.
    Whether the other side is broadcast is left to Spark's own size check.
    """
    theirs = F.struct(*[F.col(f"`{c}`") for c in other.columns])
    single = (other.filter(F.col(other_key).isNotNull()).groupBy(F.col(other_key).alias("__key"))
              .agg(F.first(theirs).alias("__row"), F.count(F.lit(1)).alias("__found")))
    both = df.join(single, F.col(key) == F.col("__key"), "left")
    shown = F.concat(F.lit(f"{key}="), F.coalesce(F.col(key).cast("string"), F.lit("null")))
    reason = F.when(F.col("__found").isNull(), F.concat(F.lit("no match for "), shown)).otherwise(
        F.concat(F.col("__found").cast("string"), F.lit(" matches for "), shown))
    mine = [F.col(f"`{c}`") for c in df.columns]
    ok = F.struct(*mine, *[F.col("__row")[c].alias(c) for c in other.columns])
    return settle(both, F.col("__found") == 1, ok, F.struct(F.struct(*mine).alias("input"), reason.alias("reason")), "lookup")


def lookup_many(df: DataFrame, key: str, other: DataFrame, other_key: str, order: list[str],
                element: Column, field: str) -> DataFrame:
    """1:many fetch: the related rows as an ordered array."""
    return collect_many(df, key, other, other_key, order, element, field)


def lookup_via(left: DataFrame, left_key: str, junction: DataFrame, to_left: str, to_right: str,
               right: DataFrame, right_key: str) -> DataFrame:
    """many:many through a junction table: one row per distinct related pair."""
    pairs = junction.select(to_left, to_right).distinct()
    return (pairs.join(left, pairs[to_left] == left[left_key])
                 .join(right, pairs[to_right] == right[right_key])
                 .drop(to_left, to_right))


# -- dependency depth -------------------------------------------------------

def pulse(instances: DataFrame, deps: DataFrame) -> DataFrame:
    """Earliest pulse per instance: 1 without inputs, else 1 + the largest input pulse.

    ``instances(id)``, ``deps(id, parent)``.  Runs of single-input instances
    are shortened by doubling (log2 of their length in joins), so the rounds
    that follow number only the levels of true multi-input instances.  A null
    parent is no dependency; an instance that rests, however far, on a parent
    that is no instance has a null pulse.
    """
    deps = deps.filter(F.col("parent").isNotNull())
    counted = deps.groupBy("id").agg(F.count(F.lit(1)).alias("inputs"), F.first("parent").alias("only"))
    chain = materialize(counted.filter(F.col("inputs") == 1).select(
        "id", F.col("only").alias("anchor"), F.lit(1).alias("dist")), "pulse-chain")
    before = None
    while True:
        up = chain.select(F.col("id").alias("anchor"), F.col("anchor").alias("__up"), F.col("dist").alias("__d"))
        moving = chain.join(up.select("anchor"), "anchor", "left_semi").count()
        if moving == 0:
            break
        if before is not None and moving >= before:
            raise ValueError("dependencies contain a cycle")
        before = moving
        chain = materialize(chain.join(up, "anchor", "left").select(
            "id", F.coalesce("__up", "anchor").alias("anchor"),
            (F.col("dist") + F.coalesce("__d", F.lit(0))).alias("dist")), "pulse-chain")

    roots = instances.join(counted.select("id"), "id", "left_anti").select("id", F.lit(1).alias("pulse"))
    unknown = (deps.select(F.col("parent").alias("id")).distinct().join(instances.select("id"), "id", "left_anti")
               .select("id", F.lit(None).cast("int").alias("pulse")))
    joints = counted.filter(F.col("inputs") > 1).select("id")
    hop = chain.select(F.col("id").alias("parent"), "anchor", "dist")
    edges = (deps.join(joints, "id", "left_semi").join(hop, "parent", "left")
             .select("id", F.coalesce("anchor", "parent").alias("anchor"),
                     (F.coalesce("dist", F.lit(0)) + 1).alias("w"))
             .groupBy("id", "anchor").agg(F.max("w").alias("w")))
    def solved_by(table: DataFrame, known: DataFrame) -> DataFrame:
        found = known.select(F.col("id").alias("anchor"), F.col("pulse").alias("__new"), F.lit(True).alias("__hit"))
        return table.join(found, "anchor", "left").select(
            "id", "anchor", "w", F.coalesce("p", "__new").alias("p"), (F.col("met") | F.col("__hit").isNotNull()).alias("met"))

    pieces = [roots, unknown]
    start = edges.withColumns({"p": F.lit(None).cast("int"), "met": F.lit(False)})
    waiting = materialize(solved_by(start, roots.unionByName(unknown)), "pulse-edges")
    while not waiting.isEmpty():
        # An instance is solved once all its anchors are; each round meets only the last one's results.
        height = F.when(~F.max(F.col("p").isNull()), F.max(F.col("w") + F.col("p")))
        solved = materialize(
            waiting.groupBy("id").agg(height.alias("pulse"), F.min("met").alias("all_met"))
                   .filter("all_met").select("id", "pulse"), "pulse-round")
        if solved.isEmpty():
            raise ValueError("dependencies contain a cycle")
        pieces.append(solved)
        waiting = materialize(solved_by(waiting.join(solved, "id", "left_anti"), solved), "pulse-edges")
    known = pieces[0]
    for piece in pieces[1:]:
        known = known.unionByName(piece)
    along = (chain.join(known.select(F.col("id").alias("anchor"), "pulse"), "anchor", "left")
             .select("id", (F.col("pulse") + F.col("dist")).alias("pulse")))
    return known.join(unknown.select("id"), "id", "left_anti").unionByName(along)


def transitive_gaps(log: DataFrame, earlier: str, later: str) -> DataFrame:
    """Correlations that hold ``later`` without the ``earlier`` it needs."""
    seen = log.filter(F.col("edge").isin(earlier, later)).groupBy(CORR).agg(
        F.max(F.when(F.col("edge") == earlier, F.lit(1))).alias("e"),
        F.max(F.when(F.col("edge") == later, F.lit(1))).alias("l"))
    return seen.filter(F.col("l").isNotNull() & F.col("e").isNull()).select(CORR)
