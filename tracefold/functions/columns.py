"""Small column builders shared by the operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def all_true(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def any_true(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def cents(amount: Column) -> Column:
    """Money as a whole number of cents: sums stay exact in any row order."""
    return F.round(amount * 100).cast("bigint")


def whole_seconds(later: Column, earlier: Column) -> Column:
    """Elapsed seconds, rounded down."""
    return F.floor(F.timestamp_diff("MICROSECOND", earlier, later) / F.lit(1_000_000)).cast("bigint")


def instance_id(cause: Column, node: Column, edge: Column, ordinal: Column) -> Column:
    """Deterministic row id, so that a replay gives the same ids."""
    return F.sha2(joined([cause.cast("string"), node, edge, ordinal.cast("string")]), 256)


def joined(parts: list[Column]) -> Column:
    """The parts joined by ``|``; different parts give different texts.

    A backslash or ``|`` inside a part is marked by a backslash, a null is ``\\N``.
    """
    marked = [F.coalesce(F.replace(F.replace(p, F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|")), F.lit("\\N")) for p in parts]
    return F.concat_ws("|", *marked)


def row_digest(columns: list[str]) -> Column:
    """SHA-256 of a row's values by name; nulls are left out of the digested text."""
    return F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in columns])), 256)


def share(part: Column, whole: Column, scale: int = 1_000_000) -> Column:
    """part/whole in units of 1/scale, rounded down, by whole-number arithmetic."""
    scaled = part.cast("bigint") * F.lit(scale)
    return F.round((scaled - scaled % whole) / whole).cast("bigint")
