"""Nodes: pure functions from one contract to another, applied to log rows.

A node body is a function of the payload column that returns output columns,
so applying it is a projection that Catalyst can fuse and prune.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field, replace

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracefold.contract import ContractError, Edge
from tracefold.functions.outcomes import settle
from tracefold.operators.conform import is_valid, violations
from tracefold.sources.log import child_envelope, with_envelope

PAYLOAD = "payload"


@dataclass(frozen=True)
class Node:
    name: str
    input: Edge
    output: Edge
    body: Callable[..., Mapping[str, Column]]
    closure: Mapping = field(default_factory=dict)
    version: str = "1"

    def payload(self, p: Column) -> Column | None:
        """The output payload for the input payload ``p``."""
        out = self.body(p, **self.closure)
        if not self.output.fields:
            return None
        return F.struct(*[out[n].alias(n) for n in self.output.fields])


def closure(node: Node, **fixed) -> Node:
    """The node with some parameters baked in."""
    return replace(node, closure={**node.closure, **fixed})


def apply(node: Node, log: DataFrame, wired: bool = False) -> DataFrame:
    """One row out per input row; rows of other edges are not touched.

    ``wired`` takes every row as input: the caller has chosen the wire.
    """
    inputs = log if wired else log.filter(F.col("edge") == node.input.name)
    return with_envelope(inputs, node.payload(F.col(PAYLOAD)), node.name, node.output,
                         impl_version=node.version)


def env_apply(log: DataFrame, node: str, output: Edge, body: Callable[[DataFrame], Column]) -> DataFrame:
    """A node that also reads the envelope (routers, dedupers): ``body`` sees whole rows."""
    return with_envelope(log, body(log), node, output)


def _check_wires(nodes) -> None:
    for before, after in zip(nodes, nodes[1:]):
        if not after.input.accepts(before.output):
            raise ContractError(f"{before.name} gives {before.output.name}, which {after.name} cannot take")


def compose(name: str, *nodes: Node) -> Node:
    """A chain as one node: the first input, the last output, nothing logged between."""
    _check_wires(nodes)

    def body(p: Column) -> Mapping[str, Column]:
        for node in nodes:
            p = node.payload(p)
        return {n: p[n] for n in nodes[-1].output.fields}
    return Node(name, nodes[0].input, nodes[-1].output, body)


def pipe(log: DataFrame, *nodes: Node, opaque: bool = False) -> DataFrame:
    """Run nodes in sequence.  Every stage is logged, or only the last if ``opaque``.

    Neighbours must fit by shape; names may differ, since the wire is explicit.  The input is read once: each row carries
    its stages along and is then unfolded into one row per stage.
    """
    _check_wires(nodes)
    current = log.filter(F.col("edge") == nodes[0].input.name)
    stages: list[str] = []
    for i, node in enumerate(nodes):
        body = node.payload(F.col(PAYLOAD))
        row = F.struct(*child_envelope(node.name, F.lit(node.output.name), F.lit(node.output.schema_hash), impl_version=node.version),
                       *([] if body is None else [body.alias(PAYLOAD)]))
        name = f"__stage_{i}"
        current = current.select(*stages, row.alias(name)).select(*stages, name, f"{name}.*")
        stages.append(name)
    if opaque:
        return current.select(f"{stages[-1]}.*")
    return current.select(F.inline(F.array(*_alike(current, stages, nodes))))


def _alike(df: DataFrame, stages: list[str], nodes) -> list[Column]:
    """The stages' rows as structs of one type; payloads of different shapes become VARIANT."""
    shapes = {df.schema[s].dataType[PAYLOAD].dataType.simpleString() for s, n in zip(stages, nodes) if n.output.fields}
    envelope = [f.name for f in df.schema[stages[0]].dataType.fields if f.name != PAYLOAD]
    if not shapes:
        return [F.col(s) for s in stages]
    kind = shapes.pop() if len(shapes) == 1 else "variant"
    out = []
    for s, n in zip(stages, nodes):
        if not n.output.fields:
            body = F.lit(None).cast(kind)
        else:
            body = F.to_variant_object(F.col(s)[PAYLOAD]) if kind == "variant" else F.col(s)[PAYLOAD]
        out.append(F.struct(*[F.col(s)[c].alias(c) for c in envelope], body.alias(PAYLOAD)))
    return out


def repeat(node: Node, log: DataFrame, n: int) -> DataFrame:
    """n forward applications; each has its own log rows."""
    return pipe(log, *[node] * n)


def parallel(pairs: Iterable[tuple[Node, DataFrame]]) -> list[DataFrame]:
    """Independent nodes over independent inputs; Spark is free to run them side by side."""
    return [apply(node, log) for node, log in pairs]


def copy(log: DataFrame, *consumers: Callable[[DataFrame], DataFrame]) -> list[DataFrame]:
    """Wire one edge to several consumers."""
    return [consumer(log) for consumer in consumers]


def discard(log: DataFrame, edge: str) -> DataFrame:
    """What later stages see once an edge is dropped; the log itself keeps it."""
    return log.filter(F.col("edge") != edge)


# -- output modes -----------------------------------------------------------

def one_of(log: DataFrame, tag: Column, branches: Iterable[str], node: str,
           refined: Edge) -> tuple[DataFrame, DataFrame]:
    """Exactly one branch per row, named by ``tag``; the payload shape is kept.

    Rows with a null or undeclared tag become ``Failed`` rows.
    """
    known = list(branches)
    tagged = log.withColumn("__tag", tag)
    hit = F.coalesce(F.col("__tag").isin(*known), F.lit(False))
    hashes = F.create_map(*[x for b in known for x in (F.lit(b), F.lit(refined.spread(b).schema_hash))])
    chosen = F.struct(*child_envelope(node, F.col("__tag"), hashes[F.col("__tag")]), F.col(PAYLOAD))
    failed = F.struct(
        *child_envelope(node, F.lit(refined.failed()), F.lit(None).cast("string")),
        F.struct(F.col(PAYLOAD).alias("input"),
                 F.concat(F.lit("undeclared branch "), F.coalesce(F.col("__tag"), F.lit("null"))).alias("reason"),
                 ).alias(PAYLOAD))
    return settle(tagged, hit, chosen, failed, "one-of")


def branch(chosen: DataFrame, name: str) -> DataFrame:
    return chosen.filter(F.col("edge") == name)


def all_of(log: DataFrame, branches: Mapping[Edge, Callable[[Column], Mapping[str, Column]]],
           node: str) -> DataFrame:
    """Every branch fires for every row; siblings share their cause.

    One pass over the input.  Branches of different shapes get VARIANT payloads.
    """
    bodies = {}
    for e, fn in branches.items():
        out = fn(F.col(PAYLOAD))
        bodies[e] = F.struct(*[out[n].alias(n) for n in e.fields]) if e.fields else None
    shapes = {e.struct_type().simpleString() for e in branches if e.fields}
    mixed = len(shapes) > 1 or (shapes and any(b is None for b in bodies.values()))
    arms = []
    for e, b in bodies.items():
        parts = [F.lit(e.name).alias("edge"), F.lit(e.schema_hash).alias("schema_hash")]
        if shapes:
            value = F.lit(None).cast("variant") if b is None else (F.to_variant_object(b) if mixed else b)
            parts.append(value.alias(PAYLOAD))
        arms.append(F.struct(*parts))
    fanned = log.withColumn("__arm", F.explode(F.array(*arms)))
    return fanned.select(*child_envelope(node, F.col("__arm.edge"), F.col("__arm.schema_hash")),
                         *([F.col(f"__arm.{PAYLOAD}")] if shapes else []))


def many(log: DataFrame, items: Callable[[Column], Column], node: str, output: Edge) -> DataFrame:
    """N rows of one edge per input row (N may be 0); the ordinal is part of the id."""
    fanned = log.select("*", F.posexplode(items(F.col(PAYLOAD))).alias("ordinal", "__item"))
    return fanned.select(
        *child_envelope(node, F.lit(output.name), F.lit(output.schema_hash), F.col("ordinal")),
        F.col("ordinal"), F.col("__item").alias(PAYLOAD))


def collect_many(parents: DataFrame, key: str, children: DataFrame, child_key: str,
                 order: list[str], element: Column, field: str) -> DataFrame:
    """Parents with their children as an ordered array (empty when there are none): one row per parent.

    Children without a key or without a parent go before anything is grouped.
    An array is one value, so a parent whose children do not fit a row fails
    the job; ``reduce_many`` serves where the children are only added up.
    """
    known = parents.select(F.col(key).alias("__parent"))
    rows = (children.filter(F.col(child_key).isNotNull())
            .select(F.col(child_key).alias("__key"), F.struct(*order, element.alias("__element")).alias("__item"))
            .join(known, F.col("__key") == F.col("__parent"), "left_semi"))
    packed = rows.groupBy("__key").agg(F.sort_array(F.collect_list("__item")).alias("__packed"))
    empty = F.array().cast(f"array<{rows.schema['__item'].dataType['__element'].dataType.simpleString()}>")
    return (parents.withColumn("__parent", F.col(key)).join(packed, F.col("__parent") == F.col("__key"), "left")
            .withColumn(field, F.coalesce(F.transform("__packed", lambda x: x["__element"]), empty))
            .drop("__parent", "__key", "__packed"))


def reduce_many(parents: DataFrame, key: str, children: DataFrame, child_key: str, **totals: Column) -> DataFrame:
    """Parents with aggregates over their children (null when there are none); no array is built.

    Merged before the shuffle, so a parent with very many children costs no more than another.
    """
    reduced = (children.filter(F.col(child_key).isNotNull()).groupBy(F.col(child_key).alias("__key"))
               .agg(*[c.alias(n) for n, c in totals.items()]))
    return (parents.withColumn("__parent", F.col(key)).join(reduced, F.col("__parent") == F.col("__key"), "left")
            .drop("__parent", "__key"))


def append_to_many(parents: DataFrame, key: str, field: str, children: DataFrame, child_key: str,
                   order: list[str], element: Column) -> DataFrame:
    """Each parent's array with the new children added at its end."""
    grown = collect_many(parents, key, children, child_key, order, element, "__new")
    return grown.withColumn(field, F.concat(field, "__new")).drop("__new")


# -- shaping payloads -------------------------------------------------------

def read_nested(column: str, *path: str) -> Column:
    c = F.col(column)
    for p in path:
        c = c.getField(p)
    return c


def write_nested(column: str, path: str, value: Column) -> Column:
    """The struct with one nested field replaced and the rest untouched."""
    return F.col(column).withField(path, value)


def spread(df: DataFrame, struct: str, **extra: Column) -> DataFrame:
    """Flatten a struct into the row and add fields."""
    rest = [c for c in df.columns if c != struct]
    return df.select(*rest, f"{struct}.*", *[c.alias(n) for n, c in extra.items()])


def pin(df: DataFrame, **fixed: Column) -> DataFrame:
    """Ignore the caller's values for some fields and use the pinned ones."""
    return df.withColumns(fixed)


def erase(logs: Iterable[DataFrame], shared: list[str], into: Edge, node: str) -> DataFrame:
    """Many specific edges to one general edge; ``source_edge`` remembers which."""
    whole = None
    for log in logs:
        body = F.struct(*[F.col(f"{PAYLOAD}.{n}").alias(n) for n in shared])
        rows = log.select(
            *child_envelope(node, F.lit(into.name), F.lit(into.schema_hash)),
            body.alias(PAYLOAD), F.col("edge").alias("source_edge"))
        whole = rows if whole is None else whole.unionByName(rows)
    return whole


# -- checks and the Python escape hatch -------------------------------------

def check_output(log: DataFrame, edge: Edge, level: str = "domain") -> tuple[DataFrame, DataFrame]:
    """Split rows by whether their payload meets the output contract."""
    good = is_valid(log, edge, level, PAYLOAD)
    ok = F.struct(*[F.col(PAYLOAD).cast(edge.struct_type().simpleString()).alias(PAYLOAD) if c == PAYLOAD else F.col(c) for c in log.columns])
    failed = F.struct(
        *child_envelope("check_output", F.lit(edge.failed()), F.lit(None).cast("string")),
        F.struct(F.col(PAYLOAD).alias("input"), violations(log, edge, level, PAYLOAD).alias("reason")).alias(PAYLOAD))
    return settle(log, good, ok, failed, "check-output")


def python_node(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], output: str,
                keep: list[str], inputs: list[str]) -> DataFrame:
    """A body that needs Python, run on Arrow batches.

    ``fn`` maps a frame of ``inputs`` to a frame of the output columns.  A batch
    that raises is halved until the rows at fault stand alone; such a row keeps
    its ``keep`` columns, gets null outputs, and the message in ``reason``.
    """
    names = [part.strip().split()[0] for part in output.split(",")]
    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*keep).schema.fields)

    def attempt(rows: pd.DataFrame) -> list[pd.DataFrame]:
        try:
            return [fn(rows.reset_index(drop=True))[names].assign(reason=None)]
        except Exception as e:  # any fault of the body becomes data
            if len(rows) == 1:
                return [pd.DataFrame({n: [None] for n in names} | {"reason": [f"{type(e).__name__}: {e}"]})]
            middle = len(rows) // 2
            return attempt(rows.iloc[:middle]) + attempt(rows.iloc[middle:])

    def run(batches):
        for batch in batches:
            out = pd.concat(attempt(batch[inputs]), ignore_index=True)
            out["reason"] = out["reason"].astype(object)
            yield pd.concat([batch[keep].reset_index(drop=True), out], axis=1)

    columns = keep + [c for c in inputs if c not in keep]
    return df.select(*columns).mapInPandas(run, f"{kept}, {output}, reason string")
