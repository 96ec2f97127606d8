"""Session settings and the shared scratch folder."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Runtime settings the operators rely on; none of them changes a result.
RUNTIME_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot join key even where that costs one more exchange afterwards.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


BROADCAST, ADAPTIVE_BROADCAST = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
#: A file's size says little about derived rows, which may be fifty times as large (hashes for small numbers), and every task
#: of a join holds a whole broadcast side: above this only sizes measured in a shuffle lead to a broadcast.
BROADCAST_BY_FILE = 256 << 10
#: A task sorts several sides of a join at once, and rows take several times their shuffled size.
ADVISORY, PARTITION = "spark.sql.adaptive.advisoryPartitionSizeInBytes", 16 << 20


def tune(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    # limits on what one task holds; smaller ones that the session names stay
    limit = _bytes(spark, BROADCAST)
    if limit > BROADCAST_BY_FILE:
        if spark.conf.get(ADAPTIVE_BROADCAST, None) is None:
            spark.conf.set(ADAPTIVE_BROADCAST, str(limit))
        spark.conf.set(BROADCAST, str(BROADCAST_BY_FILE))
    if _bytes(spark, ADVISORY) > PARTITION:
        spark.conf.set(ADVISORY, str(PARTITION))
    return spark


def _bytes(spark: SparkSession, key: str) -> int:
    value = spark.conf.get(key)
    return -1 if value.strip().startswith("-") else spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(value)


def scratch_root(spark: SparkSession) -> str:
    """The folder the cluster shares for intermediate tables.

    ``spark.checkpoint.dir`` names it.  A local session that leaves it unset
    gets a temporary folder; a cluster must name one that all machines share.
    """
    conf = spark.sparkContext.getConf()
    root = conf.get("spark.checkpoint.dir", None) or spark.conf.get("tracefold.scratch.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        root = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("tracefold.scratch.dir", root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage of iterative jobs.  The rows live in shared storage, so
    losing an executor does not lose the step.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    for made in _recorders:
        made.append(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._scratch = path
    return back


_recorders: list[list[str]] = []


@contextmanager
def recorded():
    """The paths of all tables that ``materialize`` writes meanwhile."""
    made: list[str] = []
    _recorders.append(made)
    try:
        yield made
    finally:
        _recorders.remove(made)


def remove(spark: SparkSession, paths: Iterable[str]) -> None:
    """Delete scratch tables that nothing reads any more."""
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for path in paths:
        at = fs_path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def discard(*tables: DataFrame) -> None:
    """Delete materialised tables after their last reader."""
    for table in tables:
        remove(table.sparkSession, [table._scratch])


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of jobs whose results nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
