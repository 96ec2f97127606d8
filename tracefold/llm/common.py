"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACE = "[\\x20\\x09-\\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else; pure ASCII texts take the faster built-in."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words(text: Column, separators: str) -> Column:
    """What lies between runs of ``separators`` (a regex class), as an array; empty for null."""
    return F.coalesce(F.array_remove(F.split(text, separators + "+"), ""), F.array().cast("array<string>"))


def remainder(key: Column, n: int) -> Column:
    """crc32 of the key as text, modulo ``n``; null for a null key."""
    return F.crc32(key.cast("string").cast("binary")) % n


def bounded(df: DataFrame, key: Column, cap: int) -> DataFrame:
    """About ``cap`` rows at most, chosen by a hash of ``key``: the same rows every time.

    The bound is on the fit of a model only; every operator still reads all rows.
    """
    n = df.count()
    if n <= cap:
        return df
    return df.filter(F.pmod(F.xxhash64(key, F.lit(7)), F.lit(1 << 20)) < int((1 << 20) * cap / n))


def fixed(values, kind: str) -> Column:
    """A constant array, passed as one literal."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def extended(df: DataFrame, held: list[str], ddl: str) -> StructType:
    """The schema of the columns ``held`` with the fields of ``ddl`` behind them."""
    return StructType([*df.select(held).schema.fields, *StructType.fromDDL(ddl).fields])
