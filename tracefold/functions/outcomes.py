"""Two outcomes of one pass: every row is judged once, written under its outcome, and read back per side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefold.session import scratch_path

PASSED = "__passed"


def settle(df: DataFrame, passed: Column, ok: Column, failed: Column, name: str = "outcomes") -> tuple[DataFrame, DataFrame]:
    """(rows that passed, as the fields of the struct ``ok``; the others, as those of ``failed``).

    The source is read once and each row computed once, whatever later reads either side.  A null verdict has not passed.
    """
    spark, tagged = df.sparkSession, _tagged(df, passed, ok, failed)
    path = scratch_path(spark, name)
    _write(tagged, path)
    return _sides(spark.read.schema(tagged.schema).parquet(path))


def settle_batch(df: DataFrame, passed: Column, ok: Column, failed: Column, path: str, batch: int) -> None:
    """The same for one batch of a stream; a repeated batch replaces its own rows."""
    tagged = _tagged(df, passed, ok, failed)
    _write(tagged, f"{path}/batch={batch}", "overwrite")


def batch_sides(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Both sides of all batches written."""
    return _sides(spark.read.parquet(path))


def _tagged(df: DataFrame, passed: Column, ok: Column, failed: Column) -> DataFrame:
    judged = df.withColumn(PASSED, F.coalesce(passed, F.lit(False)))
    return judged.select(F.when(F.col(PASSED), ok).alias("ok"), F.when(~F.col(PASSED), failed).alias("failed"), PASSED)


def _write(tagged: DataFrame, path: str, mode: str = "errorifexists") -> None:
    # both files of a task stay open, so nothing is sorted by outcome
    key, spark = "spark.sql.maxConcurrentOutputFileWriters", tagged.sparkSession
    before = spark.conf.get(key)
    spark.conf.set(key, "2")
    try:
        tagged.write.mode(mode).partitionBy(PASSED).parquet(path)
    finally:
        spark.conf.set(key, before)


def _sides(written: DataFrame) -> tuple[DataFrame, DataFrame]:
    passed = F.col(PASSED).cast("boolean")
    return written.filter(passed).select("ok.*"), written.filter(~passed).select("failed.*")
