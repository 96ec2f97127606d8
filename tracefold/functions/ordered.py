"""Ordered work inside groups, when one group may hold a large part of all rows.

A plain window sends a whole group to one task.  Here groups above
``HOT_ROWS`` rows are cut into order-preserving segments by a range shuffle;
each segment is processed on its own and a small per-segment summary carries
state across the cuts.  Logs without a hot group get the plain window.
"""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracefold.functions.columns import all_true
from tracefold.session import materialize

HOT_ROWS = 1_000_000      # a group of this size still fits one task
HOT_GROUPS = 10_000       # most keys that are broadcast
SEGMENT_ROWS = 500_000    # aimed size of a segment
PROBE = 2_000             # rows by which a group of the limit's size shows in the sample

_SEG = "__segment"


@dataclass(frozen=True)
class HotGroups:
    """The keys of large groups, and how to tell their rows from the others."""

    keys: list[str]
    table: DataFrame  # the keys, with the (estimated) ``rows`` per group
    few: bool         # whether the table is known to be small

    def _met(self, df: DataFrame, how: str) -> DataFrame:
        marks = self.table.select(*[F.col(k).alias(f"__h{i}") for i, k in enumerate(self.keys)])
        same = all_true([F.col(k).eqNullSafe(F.col(f"__h{i}")) for i, k in enumerate(self.keys)])  # a null key is a group too
        return df.join(F.broadcast(marks) if self.few else marks, same, how)

    def of(self, df: DataFrame) -> DataFrame:
        return self._met(df, "left_semi")

    def others(self, df: DataFrame) -> DataFrame:
        return self._met(df, "left_anti")

    def total(self) -> int:
        return self.table.agg(F.sum("rows")).first()[0]


def hot_groups(df: DataFrame, keys: list[str], rows: int | None = None) -> HotGroups | None:
    """The groups larger than ``rows``, or None when there are none.

    Above PROBE rows a group shows in a sample of its keys, so only few rows
    are shuffled for the count; half the limit is asked of the estimate.  A
    wrong guess changes the plan, never the result.  Up to HOT_GROUPS keys come
    to the driver and are broadcast; more are written out and joined as a table.
    """
    limit = HOT_ROWS if rows is None else rows
    part = min(1.0, PROBE / limit)
    probe = df.select(*keys)
    if part < 1.0:
        probe, limit = probe.filter(F.rand(seed=limit) < part), limit // 2
    size = F.round(F.count(F.lit(1)) / F.lit(part)).cast("bigint")
    counts = probe.groupBy(*keys).agg(size.alias("rows")).filter(F.col("rows") > limit)
    found = counts.limit(HOT_GROUPS + 1).collect()
    if not found:
        return None
    if len(found) > HOT_GROUPS:
        return HotGroups(keys, materialize(counts, "hot-groups"), few=False)
    return HotGroups(keys, df.sparkSession.createDataFrame(found, counts.schema), few=True)


class Ordered:
    """A table seen as ordered groups.

    ``order`` must be unique inside a group.
    """

    def __init__(self, df: DataFrame, keys: list[str], order: list[str], *, _parts=None):
        self.keys, self.order = list(keys), list(order)
        self._cold, self._hot = _parts if _parts is not None else self._split(df)

    def _split(self, df):
        hot = hot_groups(df, self.keys)
        if hot is None:
            return df, None
        segments = max(2, math.ceil(hot.total() / SEGMENT_ROWS))
        rows = (hot.of(df).repartitionByRange(segments, *self.keys, *self.order)
                .withColumn(_SEG, F.spark_partition_id()))
        # Written out: the range bounds are sampled anew by every execution.
        return hot.others(df), materialize(rows, "segments")

    @property
    def df(self) -> DataFrame:
        if self._hot is None:
            return self._cold
        return self._cold.unionByName(self._hot.drop(_SEG))

    def _next(self, cold, hot) -> "Ordered":
        return Ordered(None, self.keys, self.order, _parts=(cold, hot))

    def transform(self, fn) -> "Ordered":
        """Apply a row-wise step (columns, filters) to every row."""
        return self._next(fn(self._cold), None if self._hot is None else fn(self._hot))

    def running(self, columns: Mapping[str, tuple[str, Column]], inclusive: bool = True) -> "Ordered":
        """Add running values: ``name -> (kind, column)``.

        Kinds: ``sum``, ``min``, ``max`` and ``last`` (latest non-null value).
        ``inclusive=False`` looks at earlier rows only.
        """
        frame_end = Window.currentRow if inclusive else -1
        window = (Window.partitionBy(*self.keys).orderBy(*self.order)
                  .rowsBetween(Window.unboundedPreceding, frame_end))
        cold = self._cold.withColumns({n: _fold(k, c).over(window) for n, (k, c) in columns.items()})
        if self._hot is None:
            return self._next(cold, None)

        # 1. inside each segment
        inside = (Window.partitionBy(*self.keys, _SEG).orderBy(*self.order)
                  .rowsBetween(Window.unboundedPreceding, frame_end))
        hot = self._hot.withColumns({n: _fold(k, c).over(inside) for n, (k, c) in columns.items()})
        # 2. one row per segment, then the value carried into each segment
        where = [*self.keys, _SEG]
        totals = self._hot.groupBy(*where).agg(*[
            _summary(k, c, self.order).alias(f"__c_{n}") for n, (k, c) in columns.items()])
        across = (Window.partitionBy(*self.keys).orderBy(_SEG)
                  .rowsBetween(Window.unboundedPreceding, -1))
        carried = totals.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(where)], *[
            _fold(k, F.col(f"__c_{n}")).over(across).alias(f"__c_{n}") for n, (k, _) in columns.items()])
        # 3. combine
        same = all_true([F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(where)])
        hot = hot.join(carried, same, "left").withColumns({
            n: _merge(k, F.col(f"__c_{n}"), F.col(n)) for n, (k, _) in columns.items()
        }).drop(*[f"__c_{n}" for n in columns], *[f"__k{i}" for i in range(len(where))])
        return self._next(cold, hot)

    def numbered(self, position: str, previous: Mapping[str, str] | None = None) -> "Ordered":
        """Add a 0-based position and, per ``new: column``, the previous row's value."""
        previous = previous or {}
        boxed = {new: ("last", F.struct(F.col(old).alias("v"))) for new, old in previous.items()}
        if self._hot is None:
            w = Window.partitionBy(*self.keys).orderBy(*self.order)
            return self._next(self._cold.withColumns({
                position: F.row_number().over(w) - 1,
                **{new: F.lag(old).over(w) for new, old in previous.items()},
            }), None)
        step = self.running({position: ("sum", F.lit(1)), **boxed}, inclusive=False)
        return step.transform(lambda d: d.withColumns({
            position: F.coalesce(F.col(position), F.lit(0)).cast("int"),
            **{new: F.col(new)["v"] for new in previous},
        }))

    def fold(self, lift: Column, merge, into: str) -> DataFrame:
        """One value per group: ``merge`` the lifted rows in order.

        ``merge(left, right)`` must be associative over columns of the lifted
        type; that is what lets segments be folded apart and joined later.
        """
        def combine(rows: Column) -> Column:
            values = F.transform(F.sort_array(rows), lambda r: r["v"])
            return F.aggregate(F.slice(values, 2, F.size(values)), F.element_at(values, 1), merge)

        entry = F.collect_list(F.struct(*self.order, lift.alias("v")))
        cold = self._cold.groupBy(*self.keys).agg(combine(entry).alias(into))
        if self._hot is None:
            return cold
        parts = self._hot.groupBy(*self.keys, _SEG).agg(combine(entry).alias("__v"))
        hot = parts.groupBy(*self.keys).agg(
            combine(F.collect_list(F.struct(F.col(_SEG), F.col("__v").alias("v")))).alias(into))
        return cold.unionByName(hot)


def _fold(kind: str, c: Column) -> Column:
    return {"sum": F.sum, "min": F.min, "max": F.max,
            "last": lambda x: F.last(x, ignorenulls=True)}[kind](c)


def _summary(kind: str, c: Column, order: list[str]) -> Column:
    if kind == "last":
        at = F.when(c.isNotNull(), F.struct(*order))
        return F.max_by(c, at)
    return _fold(kind, c)


def _merge(kind: str, before: Column, inside: Column) -> Column:
    if kind == "sum":
        return F.when(before.isNull(), inside).when(inside.isNull(), before).otherwise(before + inside)
    if kind == "last":
        return F.coalesce(inside, before)
    return (F.least if kind == "min" else F.greatest)(before, inside)
