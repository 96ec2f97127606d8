"""The boundary of a node: scope, input check, body, output check, in one pass over its inputs.

Whatever stops a row becomes a ``Failed`` row that names the stage and the reason; no row aborts the job and none is lost.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracefold.contract import ContractError, Edge, Field
from tracefold.functions.columns import any_true
from tracefold.functions.outcomes import settle
from tracefold.functions.safe import SafeColumn, raising
from tracefold.operators.conform import is_valid, violations
from tracefold.operators.nodes import PAYLOAD, Node
from tracefold.sources.log import child_envelope

OUT = "__out"
STAGES = ("scope", "input", "body", "output")


def safe(node: Node) -> Node:
    """The node with a body whose operators give null instead of raising."""
    return replace(node, body=lambda p, **fixed: node.body(SafeColumn(p), **fixed))


def checked(node: Node, log: DataFrame) -> DataFrame:
    """``log`` with the node's output in ``__out``; a body that could still abort the job is refused here, before it runs."""
    out = safe(node).payload(F.col(PAYLOAD))
    out = F.lit(True) if out is None else out
    left = raising(log.select(out.alias(OUT)))
    if left:
        raise ContractError(f"{node.name}: these parts of the body raise on some values, use their try_ forms: {left}")
    return log.withColumn(OUT, out)


def missing_values(output: Edge) -> tuple[Column, Column]:
    """(whether a field that may not be null has no value, their names): how an error caught in a body shows."""
    strict = [n for n, f in output.fields.items() if not (isinstance(f, Field) and f.optional)]
    absent = {n: F.col(OUT)[n].isNull() for n in strict}
    return any_true(list(absent.values())), F.concat_ws(",", *[F.when(c, F.lit(n)) for n, c in absent.items()])


def failed_struct(edge: str, node: str, reason: Column, stage: Column | None = None) -> Column:
    """A whole ``Failed`` row caused by the row at hand."""
    body = [F.col(PAYLOAD).alias("input"), reason.cast("string").alias("reason")]
    if stage is not None:
        body.append(stage.alias("stage"))
    return F.struct(*child_envelope(node, F.lit(edge), F.lit(None).cast("string")), F.struct(*body).alias(PAYLOAD))


def ok_struct(node: Node) -> Column:
    body = [] if not node.output.fields else [F.col(OUT).cast(node.output.struct_type().simpleString()).alias(PAYLOAD)]
    return F.struct(*child_envelope(node.name, F.lit(node.output.name), F.lit(node.output.schema_hash), impl_version=node.version), *body)


def listed(found: Column) -> Column:
    """Violations as text: ``path rule (value)``, joined by commas."""
    return F.array_join(F.transform(found, lambda v: F.concat_ws(" ", v["path"], v["rule"], F.concat(F.lit("("), v["actual"], F.lit(")")))), ", ")


def boundary(node: Node, log: DataFrame, scope: str | None = None, level: str = "domain") -> tuple[DataFrame, DataFrame]:
    """Run a node behind its boundary: (output rows, ``Failed`` rows with {input, reason, stage}).

    A row goes through ``scope`` (its identity must hold the grant), ``input`` (its payload meets the input contract),
    ``body`` (every field that may not be null has a value) and ``output`` (the result meets the output contract); the
    first stage that stops it gives the reason.  The log is read once.
    """
    rows = checked(node, log.filter(F.col("edge") == node.input.name))
    held = F.lit(True) if scope is None else F.coalesce(F.array_contains("identity.scopes", scope), F.lit(False))
    fits = F.lit(True) if not node.input.fields else is_valid(rows, node.input, level, PAYLOAD)
    broken, which = missing_values(node.output)
    made = F.lit(True) if not node.output.fields else is_valid(rows, node.output, level, OUT)
    no = lambda c: ~F.coalesce(c, F.lit(False))
    stops = [(no(held), "scope", F.lit(f"missing scope {scope}")),
             (no(fits), "input", listed(violations(rows, node.input, level, PAYLOAD)) if node.input.fields else F.lit("")),
             (broken, "body", F.concat(F.lit("no value for "), which)),
             (no(made), "output", listed(violations(rows, node.output, level, OUT)) if node.output.fields else F.lit(""))]
    stage, reason = F.lit(None).cast("string"), F.lit(None).cast("string")
    for stop, name, why in reversed(stops):
        stage, reason = F.when(stop, F.lit(name)).otherwise(stage), F.when(stop, why).otherwise(reason)
    rows = rows.withColumn("__stage", stage)
    return settle(rows, F.col("__stage").isNull(), ok_struct(node),
                  failed_struct(node.input.failed(), node.name, reason, F.col("__stage")), "boundary")
