"""Statistics over recorded runs: transitions, routes, bypasses, latency."""

from __future__ import annotations

from collections.abc import Iterable
from decimal import Decimal
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracefold.contract import Edge
from tracefold.functions.columns import share
from tracefold.functions.ordered import Ordered
from tracefold.session import materialize

CORR = "correlation_id"
ORDER = ["step", "id"]


def edge_stats(log: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Instances, correlations, hashes and time range per edge (and node)."""
    return log.groupBy(*(by or ["edge", "node"])).agg(
        F.count(F.lit(1)).alias("instances"), F.countDistinct(CORR).alias("correlations"),
        F.size(F.collect_set("schema_hash")).alias("hashes"),  # one entry per contract version
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def transitions(log: DataFrame) -> DataFrame:
    """Cause-to-effect pairs of edges: count and share (millionths) per source.

    Effects are counted per (cause, edge) before the join.
    """
    effects = (log.filter(F.col("causation_id").isNotNull())
               .groupBy("causation_id", F.col("edge").alias("target")).agg(F.count(F.lit(1)).alias("n")))
    causes = log.select(F.col("id").alias("causation_id"), F.col("edge").alias("source"))
    pairs = (effects.join(causes, "causation_id").groupBy("source", "target").agg(F.sum("n").alias("instances")))
    whole = F.sum("instances").over(Window.partitionBy("source"))  # one row per pair of edges
    return pairs.select("source", "target", "instances", share(F.col("instances"), whole).alias("share_ppm"))


def next_edges(log: DataFrame, current: str, k: int) -> DataFrame:
    """The k most frequent recorded next steps after an edge."""
    return (transitions(log).filter(F.col("source") == current)
            .orderBy(F.desc("instances"), "target").limit(k))


def _steps(log: DataFrame) -> DataFrame:
    """One row per step of a run with the set of its edges, so siblings of a fan-out stand side by side."""
    return log.groupBy(CORR, "step").agg(F.collect_set("edge").alias("edges"))  # at most one entry per edge type


def reachable(log: DataFrame, start: str) -> DataFrame:
    """Edges ever seen downstream of ``start`` in a run, with the least distance in steps.

    The nearest start of a smaller step decides the distance, so one running
    maximum replaces a pairing of rows.
    """
    at = F.when(F.array_contains("edges", start), F.col("step"))
    seen = Ordered(_steps(log), [CORR], ["step"]).running({"__from": ("max", at)}, inclusive=False)
    hits = seen.df.filter(F.col("__from").isNotNull()).select(CORR, "step", "__from", F.explode("edges").alias("edge"))
    return hits.groupBy("edge").agg(F.min(F.col("step") - F.col("__from")).alias("distance"),
                                    F.countDistinct(CORR).alias("correlations"))


def orphans(edges: Iterable[str], log: DataFrame) -> DataFrame:
    """Declared edges never observed, and observed edges never declared."""
    declared = log.sparkSession.createDataFrame([(e,) for e in edges], "edge string")
    seen = log.select("edge").distinct()
    return (declared.join(seen, "edge", "left_anti").withColumn("finding", F.lit("unobserved"))
            .unionByName(seen.join(declared, "edge", "left_anti").withColumn("finding", F.lit("undeclared"))))


def _runs(log: DataFrame, start: str, end: str) -> DataFrame:
    """Steps from the first ``start`` to the first step after it that holds ``end``.

    Adds ``__start`` (step of the first start) and ``__done`` (whether this is the end's step).
    """
    done = F.array_contains("edges", end) & (F.col("step") > F.col("__start"))
    rows = Ordered(_steps(log), [CORR], ["step"])
    rows = rows.running({"__start": ("min", F.when(F.array_contains("edges", start), F.col("step")))})
    rows = rows.transform(lambda d: d.filter(F.col("__start").isNotNull()).withColumn("__done", done))
    rows = rows.running({"__end": ("min", F.when(F.col("__done"), F.col("step")))}, inclusive=False)
    return rows.df.filter(F.col("__end").isNull())


def must_pass(log: DataFrame, start: str, end: str) -> DataFrame:
    """Per edge: how many start-to-end runs pass it in between; share 1 is a pinch point.

    Siblings at the step of either end are not in between.
    """
    inside = _runs(log, start, end).select(CORR, "step", "__start", "__done", F.explode("edges").alias("edge"))
    between = (F.col("step") > F.col("__start")) & ~F.col("__done")
    per_run = inside.groupBy(CORR).agg(
        F.max("__done").alias("complete"),
        F.collect_set(F.when(between, F.col("edge"))).alias("passed"))  # at most one entry per edge type
    # The null entry of every run counts the runs themselves.
    marked = F.concat("passed", F.array(F.lit(None).cast("string")))
    counted = (per_run.filter(F.col("complete")).select(F.explode(marked).alias("edge"))
               .groupBy("edge").agg(F.count(F.lit(1)).alias("passing")))
    every_run = Window.partitionBy(F.lit(1))  # one row per edge type
    runs = F.max(F.when(F.col("edge").isNull(), F.col("passing"))).over(every_run)
    return (counted.withColumn("runs", runs).filter(F.col("edge").isNotNull())
            .select("edge", "passing", "runs", share(F.col("passing"), F.col("runs")).alias("share_ppm")))


def bypass(log: DataFrame, target: str, guard: str) -> DataFrame:
    """Target rows reached with no guard earlier in their run.

    The first guard per run is enough to decide; it is a plain aggregate.
    """
    first_guard = (log.filter(F.col("edge") == guard).groupBy(CORR)
                   .agg(F.min("step").alias("__guard")))
    return (log.filter(F.col("edge") == target).join(first_guard, CORR, "left")
            .filter(F.col("__guard").isNull() | (F.col("__guard") >= F.col("step"))).drop("__guard"))


def routes(log: DataFrame, max_depth: int = 32, top_k: int | None = None,
           success: Column | None = None, chained: bool = False) -> DataFrame:
    """Recorded step sequences with their frequency and successes.

    A route is identified over its whole length by ``digest``, made of sums of
    two hashes of every (step, edge), so nothing cancels; only its printed form
    stops after ``max_depth`` steps, and routes that print alike differ in it.  Equal edges at one step
    of a run count once, so fan-out does not lengthen a route.  ``chained``
    states that steps are unique in a run, which saves that merge.
    """
    ok = F.coalesce(F.lit(False) if success is None else success, F.lit(False))
    steps = (log.select(CORR, "step", "edge", ok.alias("__ok")) if chained
             else log.groupBy(CORR, "step", "edge").agg(F.max(ok).alias("__ok")))
    shown = F.sort_array(F.collect_list(F.when(F.col("step") < max_depth, F.struct("step", "edge"))))
    runs = steps.groupBy(CORR).agg(
        *[F.sum(F.xxhash64("step", "edge", F.lit(i)).cast("decimal(38,0)")).alias(f"__sum{i}") for i in (1, 2)],
        F.max("step").alias("__last"),
        shown.alias("__shown"), F.max("__ok").alias("__ok"))
    label = F.concat(F.array_join(F.transform("__shown", lambda s: s["edge"]), ">"),
                     F.when(F.col("__last") >= max_depth, ">…").otherwise(""))
    digest = F.sha2(F.concat_ws(":", F.col("__sum1").cast("string"), F.col("__sum2").cast("string"), F.col("__last").cast("string")), 256)
    found = (runs.withColumn("route", label).groupBy(digest.alias("digest"), "__last", "route")
             .agg(F.count(F.lit(1)).alias("runs"), F.sum(F.col("__ok").cast("int")).alias("successes"))
             .select("route", (F.col("__last") + 1).alias("steps"), "runs", "successes", "digest"))
    return found if top_k is None else found.orderBy(F.desc("runs"), "route", "digest").limit(top_k)


def rank_routes(log: DataFrame, start: str, end: str, max_depth: int, top_k: int,
                flags: DataFrame | None = None) -> DataFrame:
    """Start-to-end routes of bounded depth, ranked by runs, then depth.

    ``flags(edge, lossy, effectful, zone)`` annotates each route with what the
    catalog knows about its edges.  Rows beyond the depth are filtered before
    anything is collected.
    """
    inside = _runs(log, start, end).filter(F.col("step") - F.col("__start") <= max_depth)
    shown = (F.when(F.col("step") == F.col("__start"), F.array(F.lit(start))).when(F.col("__done"), F.array(F.lit(end)))
             .otherwise(F.sort_array("edges")))  # siblings of the two ends lie beside the route
    runs = inside.groupBy(CORR).agg(
        F.max(F.when(F.col("__done"), F.col("step") - F.col("__start"))).alias("depth"),
        F.sort_array(F.collect_list(F.struct("step", shown.alias("edges")))).alias("__path"))
    found = (runs.filter(F.col("depth").isNotNull())
             .withColumn("__edges", F.flatten(F.transform("__path", lambda s: s["edges"])))
             .groupBy("__edges", "depth").agg(F.count(F.lit(1)).alias("runs")))
    best = found.withColumn("route", F.array_join("__edges", ">")).orderBy(
        F.desc("runs"), "depth", "route").limit(top_k)
    if flags is None:
        return best.drop("__edges")
    at = best.select("route", "depth", "runs", F.posexplode("__edges").alias("__i", "edge"))
    known = at.join(flags, "edge", "left")
    order = Window.partitionBy("route").orderBy("__i")  # at most top_k routes of bounded depth
    hop = F.when(F.col("zone") != F.lag("zone").over(order), 1).otherwise(0)
    return (known.withColumn("__hop", hop).groupBy("route", "depth", "runs").agg(
        F.max(F.coalesce("lossy", F.lit(False))).alias("lossy"),
        F.max(F.coalesce("effectful", F.lit(False))).alias("effectful"),
        F.sum("__hop").alias("zone_hops")))


def terminal_audit(log: DataFrame, accepted: Iterable[str]) -> DataFrame:
    """Runs whose last row is not an accepted terminal edge."""
    last = log.groupBy(CORR).agg(F.max_by("edge", F.struct("step", "id")).alias("last_edge"),
                                 F.max("step").alias("last_step"))
    return last.filter(~F.col("last_edge").isin(*accepted))


def branch_stats(chosen: DataFrame, by: str = "edge") -> DataFrame:
    """How often each branch of a decision fired."""
    counted = chosen.groupBy(by).agg(F.count(F.lit(1)).alias("instances"))
    whole = F.sum("instances").over(Window.partitionBy(F.lit(1)))  # one row per branch
    return counted.select(by, "instances", share(F.col("instances"), whole).alias("share_ppm"))


def latency(log: DataFrame, seconds, quantiles: Iterable[float] = (0.5, 0.9, 0.99)) -> DataFrame:
    """Time from cause to effect per pair of edges: mean and exact quantiles.

    ``seconds(effect_ts, cause_ts)`` gives whole units.  Equal values are
    counted together first, so quantiles come from a compact histogram: the
    smallest value whose cumulative count reaches q of the pair.
    """
    causes = log.select(F.col("id").alias("causation_id"), F.col("edge").alias("source"), F.col("ts").alias("__t"))
    effects = log.filter(F.col("causation_id").isNotNull()).select("causation_id", F.col("edge").alias("target"), "ts")
    hist = materialize(effects.join(causes, "causation_id")
                       .groupBy("source", "target", seconds(F.col("ts"), F.col("__t")).alias("s"))
                       .agg(F.count(F.lit(1)).alias("n")), "latency")
    upto = Ordered(hist, ["source", "target"], ["s"]).running({"__cum": ("sum", F.col("n"))}).df
    total = hist.groupBy("source", "target").agg(F.sum("n").alias("instances"), F.sum(F.col("n") * F.col("s")).alias("sum_s"))
    joined = upto.join(total, ["source", "target"])
    def rank(q: float) -> Column:  # ceil(q * instances) in whole numbers
        exact = Fraction(str(q))
        scaled = F.col("instances") * exact.numerator + (exact.denominator - 1)
        return ((scaled - scaled % exact.denominator) / exact.denominator).cast("bigint")
    names = {q: _percent(q) for q in quantiles}
    picks = [F.min(F.when(F.col("__cum") >= rank(q), F.col("s"))).alias(n) for q, n in names.items()]
    return joined.groupBy("source", "target", "instances", "sum_s").agg(*picks).select(
        "source", "target", "instances", F.floor(F.col("sum_s") / F.col("instances")).alias("mean_s"), *names.values())


def _percent(q: float) -> str:
    """The column of a quantile: p50 for 0.5, p99_95 for 0.9995."""
    text = f"{Decimal(str(q)) * 100:f}"
    return "p" + (text.rstrip("0").rstrip(".") if "." in text else text).replace(".", "_")


def lossy_audit(erased: DataFrame, catalog: Iterable[Edge], into: Edge) -> DataFrame:
    """Instances that passed a converging node, with the fields that were lost."""
    kept = set(into.fields)
    lost = [(e.name, ",".join(sorted(set(e.fields) - kept))) for e in catalog]
    fields = log_map(lost)
    counted = erased.groupBy("source_edge").agg(F.count(F.lit(1)).alias("instances"))
    return counted.select("source_edge", "instances", fields[F.col("source_edge")].alias("lost_fields")).filter(
        F.coalesce("lost_fields", F.lit("")) != "")


def log_map(pairs: list[tuple[str, str]]) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs for x in pair])
