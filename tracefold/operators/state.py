"""State as a fold over the log, and tables as views of it."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracefold.functions.ordered import Ordered

CORR = "correlation_id"
ORDER = ["step", "id"]


def fold(log: DataFrame, keys: list[str] | None = None, **aggregates: Column) -> DataFrame:
    """State per correlation for folds that are plain aggregates."""
    return log.groupBy(*(keys or [CORR])).agg(*[c.alias(n) for n, c in aggregates.items()])


def ordered_fold(log: DataFrame, lift: Column, merge, into: str = "state",
                 keys: list[str] | None = None) -> DataFrame:
    """State per correlation where the order matters.

    ``lift`` turns a row into a summary and ``merge(a, b)`` joins neighbouring
    summaries (associative), so a long correlation is folded in segments.
    """
    return Ordered(log, keys or [CORR], ORDER).fold(lift, merge, into)


def running_fold(log: DataFrame, columns: Mapping[str, tuple[str, Column]],
                 keys: list[str] | None = None) -> DataFrame:
    """State after every instance: running sums, minima, maxima, last values."""
    return Ordered(log, keys or [CORR], ORDER).running(columns).df


def current_state(log: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Last write per key."""
    rest = [c for c in log.columns if c not in key]
    return (log.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__row"))
               .select(*key, "__row.*"))


def state_at(log: DataFrame, until: Column, key: list[str], order: list[str]) -> DataFrame:
    """The table as it was: rows satisfying ``until`` only."""
    return current_state(log.filter(until), key, order)


def refresh(view: DataFrame, delta: DataFrame, keys: list[str], merges: Mapping[str, str]) -> DataFrame:
    """Merge two partial aggregates; ``merges`` names sum, min or max per column."""
    fns = {"sum": F.sum, "min": F.min, "max": F.max}
    both = view.select(*keys, *merges).unionByName(delta.select(*keys, *merges))
    return both.groupBy(*keys).agg(*[fns[m](c).alias(c) for c, m in merges.items()])


def refresh_state(view: DataFrame, delta: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Merge a last-write-per-key table with newer rows."""
    return current_state(view.unionByName(delta), key, order)


def scoped_view(log: DataFrame, entitlement: DataFrame, on: list[str], by: list[str],
                **aggregates: Column) -> DataFrame:
    """A view built only from entitled rows, so the derived table cannot leak."""
    return (log.join(entitlement, on, "left_semi").groupBy(*by)
               .agg(*[c.alias(n) for n, c in aggregates.items()]))


def growth_watch(log: DataFrame, bound: int) -> DataFrame:
    """Correlations with more instances than the bound."""
    return log.groupBy(CORR).agg(F.count(F.lit(1)).alias("instances")).filter(F.col("instances") > bound)
