"""The operators on live logs, as Structured Streaming queries.

Every function starts a query and returns it.  ``foreachBatch`` sinks write one
folder per batch that a retried batch overwrites, or a table that knows its
last batch, so each batch counts once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tracefold.contract import Edge
from tracefold.functions.outcomes import batch_sides, settle_batch
from tracefold.operators.conform import judged
from tracefold.streaming.processors import EveryProcessor, TimeoutProcessor
from tracefold.streaming.tables import CurrentTable

CORR = "correlation_id"
AVAILABLE_NOW = {"availableNow": True}
#: Groups that the correlations of a stateful stream are dealt into; a running checkpoint keeps to its number.
GROUPS = 4096
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_log(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int | None = None,
               pattern: str | None = None) -> DataFrame:
    """A log folder as an unbounded source.  The schema is stated, never inferred."""
    reader = spark.readStream.schema(schema)
    if pattern is not None:
        reader = reader.option("pathGlobFilter", pattern)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def _with_rocksdb(spark: SparkSession, start: Callable[[], StreamingQuery]) -> StreamingQuery:
    """Start a query whose state needs column families."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, ROCKSDB)
    try:
        return start()
    finally:
        spark.conf.set(key, before)


def _to_table(df: DataFrame, path: str, checkpoint: str, trigger) -> StreamingQuery:
    return (df.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
            .option("path", path).trigger(**(trigger or AVAILABLE_NOW)).start())


def stream_conform(stream: DataFrame, edge: Edge, path: str, checkpoint: str,
                   level: str = "domain", keep: tuple[str, ...] = (), trigger=None) -> StreamingQuery:
    """Valid and ``Failed`` rows, judged once per batch; ``conformed`` reads either side."""
    def write(batch: DataFrame, number: int) -> None:
        settle_batch(*judged(batch, edge, level, keep), path, number)
    return (stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or AVAILABLE_NOW)).start())


def conformed(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(valid rows, ``Failed`` rows) that ``stream_conform`` has written."""
    return batch_sides(spark, path)


def stream_append(stream: DataFrame, path: str, checkpoint: str, trigger=None) -> StreamingQuery:
    """Append to the log folder; the file sink commits each batch once."""
    return (stream.writeStream.format("parquet").partitionBy("edge").outputMode("append")
            .option("checkpointLocation", checkpoint).option("path", path)
            .trigger(**(trigger or AVAILABLE_NOW)).start())


def stream_dedupe(stream: DataFrame, path: str, checkpoint: str, delay: str, ts: str = "ts",
                  trigger=None) -> StreamingQuery:
    """One row per id among copies that arrive within the delay."""
    once = stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(["id"])
    return _to_table(once, path, checkpoint, trigger)


def stream_fold(stream: DataFrame, keys: list[str], aggregates: dict[str, Column], path: str,
                checkpoint: str, trigger=None, compact_after: int = 8) -> StreamingQuery:
    """Incremental state per key, kept as a table: each batch adds the keys it changed (``CurrentTable``)."""
    state = stream.groupBy(*keys).agg(*[c.alias(n) for n, c in aggregates.items()])
    return _kept(state.writeStream.outputMode("update"), CurrentTable(stream.sparkSession, path, keys, compact_after=compact_after), checkpoint, trigger)


def stream_view(stream: DataFrame, key: list[str], order: list[str], path: str, checkpoint: str,
                trigger=None, compact_after: int = 8) -> StreamingQuery:
    """Keep a last-write-per-key table; ``CurrentTable(...).read()`` gives one row per key.

    Rows may arrive in any order and any number of times.  No state is held beside the table.
    """
    table = CurrentTable(stream.sparkSession, path, key, order, compact_after)
    return _kept(stream.writeStream.outputMode("append"), table, checkpoint, trigger)


def _kept(writer, table: CurrentTable, checkpoint: str, trigger) -> StreamingQuery:
    return (writer.foreachBatch(table.apply).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or AVAILABLE_NOW)).start())


def heartbeat(spark: SparkSession, path: str, schema: T.StructType, ts) -> None:
    """Append a row that only says how late it is, so that a log that fell silent still passes its deadlines.

    Its ids are ``0`` and not null: joins drop rows without a key before they could move the watermark.
    """
    values = {"edge": F.lit("heartbeat"), "ts": F.lit(ts)} | {c: F.lit("0") for c in ("id", CORR, "causation_id")}
    (spark.range(1).select(*[values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])
        .write.mode("append").parquet(path))


def of_edges(stream: DataFrame, edges: list[str], delay: str) -> DataFrame:
    """Rows of some edges; rows of all edges move the watermark.

    The condition names ``ts`` so that it stays above the watermark.
    """
    marked = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    return marked.filter(F.when(F.col("ts").isNotNull(), F.col("edge").isin(*edges)))


def stream_every(stream: DataFrame, edges: list[str], path: str, checkpoint: str, delay: str = "1 hour",
                 lifetime_ms: int | None = None, body: Column | None = None, trigger=None) -> StreamingQuery:
    """Emit once per correlation, when all edges are there: the same rows as ``every(at="fire")``.

    Rows may arrive in any order within ``delay``, over any number of batches; inside a correlation ``ts`` must not fall
    while ``step`` rises.  A firing is emitted once the watermark has passed it.  ``lifetime_ms`` is the longest
    span of a correlation: so long after its firing, or its last row, its state leaves.  ``body`` is what to carry per
    row, as text (default: the payload as JSON).
    """
    rows = of_edges(stream, edges, delay).select(
        CORR, "edge", F.col("step").cast("int").alias("step"), "ts", F.unix_micros("ts").alias("micros"), F.col("id").cast("string").alias("id"),
        (F.to_json("payload") if body is None else body.cast("string")).alias("body"))
    key = stream.schema[CORR].dataType.simpleString()
    ready = _grouped(rows).transformWithState(
        statefulProcessor=EveryProcessor(tuple(edges), lifetime_ms), outputStructType=every_schema(edges, key),
        outputMode="append", timeMode="EventTime")
    return _with_rocksdb(stream.sparkSession, lambda: _to_table(ready, path, checkpoint, trigger))


def _grouped(rows: DataFrame):
    """The rows by group of correlations: each group has one value of state and one timer."""
    return rows.withColumn("__group", F.pmod(F.xxhash64(CORR), F.lit(GROUPS))).groupBy("__group")


def every_schema(edges: list[str], key_type: str) -> str:
    columns = ", ".join(f"id_{i} string, step_{i} int, body_{i} string" for i in range(len(edges)))
    return f"{CORR} {key_type}, step int, {columns}"


def timeout_race(stream: DataFrame, edges: list[str], within_ms: int, path: str, checkpoint: str,
                 delay: str, lifetime_ms: int | None = None, trigger=None) -> StreamingQuery:
    """Per correlation: ``Ready`` if all edges arrive within the span, else ``TimedOut``.

    The span starts at the earliest row among the edges, in event time.  With ``lifetime_ms`` a decided
    correlation is forgotten that long after its span.
    """
    rows = of_edges(stream, edges, delay).select(CORR, "edge", "ts", F.unix_micros("ts").alias("micros"))
    key = stream.schema[CORR].dataType.simpleString()
    decided = _grouped(rows).transformWithState(
        statefulProcessor=TimeoutProcessor(tuple(edges), within_ms, lifetime_ms), outputStructType=f"{CORR} {key}, outcome string",
        outputMode="append", timeMode="EventTime")
    return _with_rocksdb(stream.sparkSession, lambda: _to_table(decided, path, checkpoint, trigger))


def stream_effects(stream: DataFrame, request: Column, result: Column, bound: str, delay: str, path: str, checkpoint: str,
                   how: str = "left", trigger=None) -> StreamingQuery:
    """Requests of a log with the results that name them as cause within ``bound``.

    ``request`` and ``result`` say which rows are which.  With ``how="left"`` a request without a result is emitted once
    the watermark, which all rows of the log move, proves that none can come.
    """
    def side(condition: Column, ts: str, **columns: str) -> DataFrame:
        marked = stream.withColumn(ts, F.col("ts").cast("timestamp")).withWatermark(ts, delay)
        chosen = marked.filter(F.when(F.col(ts).isNotNull(), condition))  # stays above the watermark
        return chosen.select(*[F.col(c).alias(n) for n, c in columns.items()], ts)

    left = side(request, "request_ts", request_id="id")
    right = side(result, "result_ts", for_id="causation_id", result_id="id")
    near = ((F.col("for_id") == F.col("request_id")) & (F.col("result_ts") >= F.col("request_ts"))
            & (F.col("result_ts") <= F.col("request_ts") + F.expr(f"INTERVAL {bound}")))
    joined = left.join(right, near, "leftOuter" if how == "left" else "inner").drop("for_id")
    joined = joined.select("request_id", "request_ts", "result_id", "result_ts")
    return _to_table(joined, path, checkpoint, trigger)
