"""The append-only log: envelopes, roots, files, redelivery, the unified view."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefold.contract import Edge, Field, Many
from tracefold.functions.columns import instance_id, row_digest
from tracefold.operators.conform import payload as payload_of

IDENTITY = "struct<sub:string,iss:string,scopes:array<string>>"
ENVELOPE = ["id", "correlation_id", "causation_id", "ts", "step", "node", "impl_version",
            "identity", "schema_hash", "edge"]


def identity(sub: Column | str = "system", iss: str = "local", scopes: Column | None = None) -> Column:
    sub = F.lit(sub) if isinstance(sub, str) else sub
    scopes = F.array().cast("array<string>") if scopes is None else scopes
    return F.struct(sub.cast("string").alias("sub"), F.lit(iss).alias("iss"), scopes.alias("scopes"))


def origin(df: DataFrame, edge: Edge, correlation: Column, source_key: Column, ts: Column,
           node: str = "origin", who: Column | None = None, impl_version: str = "1") -> DataFrame:
    """Wrap a table as root instances: step 0, no cause.

    ``source_key`` identifies a row of the table and makes its id; no shuffle.
    Rows without a key are told apart by all their values, so only rows that are
    equal throughout share an id.
    """
    body = payload_of(df, edge)
    return df.select(
        instance_id(F.coalesce(source_key.cast("string"), F.concat(F.lit("row:"), row_digest(df.columns))),
                    F.lit(node), F.lit(edge.name), F.lit(0)).alias("id"),
        correlation.alias("correlation_id"),
        F.lit(None).cast("string").alias("causation_id"),
        ts.alias("ts"),
        F.lit(0).alias("step"),
        F.lit(node).alias("node"),
        F.lit(impl_version).alias("impl_version"),
        (identity() if who is None else who).alias("identity"),
        F.lit(edge.schema_hash).alias("schema_hash"),
        F.lit(edge.name).alias("edge"),
        *([body.alias("payload")] if edge.fields else []))


def origins(df: DataFrame, edges: Mapping[Edge, Column], **envelope) -> dict[str, DataFrame]:
    """One external event populates several root edges of a correlation at once.

    ``edges`` maps each contract to the condition under which a row provides it.
    """
    return {e.name: origin(df.filter(cond), e, **envelope) for e, cond in edges.items()}


def literal(spark: SparkSession, edge: Edge, rows: Iterable[Mapping]) -> DataFrame:
    """Rows of fixed values written in the program."""
    data = [tuple(r[n] for n in edge.fields) for r in rows]
    return spark.createDataFrame(data, edge.struct_type())


def child_envelope(node: str, edge: Column, schema_hash: Column, ordinal: Column | None = None,
                   impl_version: str = "1") -> list[Column]:
    """Envelope columns of rows caused by the row at hand."""
    ordinal = F.lit(0) if ordinal is None else ordinal
    return [
        instance_id(F.col("id"), F.lit(node), edge, ordinal).alias("id"),
        F.col("correlation_id"),
        F.col("id").cast("string").alias("causation_id"),
        F.col("ts"),
        (F.col("step") + 1).cast("int").alias("step"),
        F.lit(node).alias("node"),
        F.lit(impl_version).alias("impl_version"),
        F.col("identity"),
        schema_hash.alias("schema_hash"),
        edge.alias("edge"),
    ]


def with_envelope(parents: DataFrame, body: Column | None, node: str, edge: Edge,
                  ordinal: Column | None = None, impl_version: str = "1") -> DataFrame:
    """Child rows: same correlation and identity, caused by the parent, one step later."""
    return parents.select(
        *child_envelope(node, F.lit(edge.name), F.lit(edge.schema_hash), ordinal, impl_version),
        *([] if body is None else [body.alias("payload")]))


def append_log(log: DataFrame, path: str) -> None:
    """Append rows, one folder per edge; existing files are never touched.

    The rebalance hint sizes the files and splits a hot edge over several
    writers; sorting by correlation lets reads of one correlation skip groups.
    """
    (log.hint("rebalance", "edge")
        .sortWithinPartitions("edge", "correlation_id")
        .write.mode("append").partitionBy("edge").parquet(path))


def read_log(spark: SparkSession, path: str, edges: Iterable[str] | None = None,
             correlations: Iterable | None = None) -> DataFrame:
    """Read the log, or only some edges (folder pruning) or correlations (row-group pruning)."""
    df = spark.read.parquet(path)
    if edges is not None:
        df = df.filter(F.col("edge").isin(*edges))
    if correlations is not None:
        df = df.filter(F.col("correlation_id").isin(*correlations))
    return df


def dedupe(log: DataFrame) -> DataFrame:
    """One row per id.  Redelivered copies are merged before the shuffle."""
    return log.dropDuplicates(["id"])


def unified(logs: Iterable[DataFrame]) -> DataFrame:
    """All edges in one table; payloads of different shapes become VARIANT."""
    def one(df):
        body = (F.to_variant_object("payload") if "payload" in df.columns
                else F.lit(None).cast("variant"))
        return df.select(
            F.col("id").cast("string").alias("id"), F.col("correlation_id").cast("string").alias("correlation_id"),
            F.col("causation_id").cast("string").alias("causation_id"),
            *ENVELOPE[3:], body.alias("payload"))
    frames = [one(df) for df in logs]
    whole = frames[0]
    for f in frames[1:]:
        whole = whole.unionByName(f)
    return whole


def typed_view(log: DataFrame, edge: Edge) -> DataFrame:
    """Rows of one edge out of the unified table, with the typed payload back."""
    def ddl(f):
        if isinstance(f, Many):
            return f"array<{f.edge.struct_type().simpleString()}>"
        return (f.spark_type if isinstance(f, Field) else f.struct_type()).simpleString()
    body = F.struct(*[F.variant_get("payload", f"$.{n}", ddl(f)).alias(n) for n, f in edge.fields.items()])
    return log.filter(F.col("edge") == edge.name).withColumn("payload", body)
