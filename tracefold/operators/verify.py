"""Checks on data: expectations, examples, generated cases, properties."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefold.contract import INTEGER_RANGES, TEXT, Edge, Field, Many
from tracefold.functions.columns import all_true, any_true
from tracefold.operators.nodes import PAYLOAD, Node, compose

# Domain used where a contract declares no bound of its own.
FLOAT_RANGE = (-1.0e6, 1.0e6)
TEXT_LENGTH = (0, 40)
MANY_LENGTH = (0, 4)
EPOCH_RANGE = (0, 2_000_000_000)
ALPHABET = "abcdefghijklmnopqrstuvwxyz"


def expect(df: DataFrame, literal: Mapping[str, object], mode: str = "named", column: str | None = None) -> DataFrame:
    """Add ``verdict`` Pass/Fail.  ``named`` compares the given fields only; ``full`` all of them."""
    names = df.schema[column].dataType.names if column else df.columns
    wanted = list(literal) if mode == "named" else names
    if mode == "full" and set(literal) != set(names):
        raise ValueError(f"full comparison needs exactly the fields {names}")
    get = (lambda n: F.col(column)[n]) if column else F.col
    same = all_true([get(n).eqNullSafe(F.lit(literal[n])) for n in wanted])
    return df.withColumn("verdict", F.when(same, "Pass").otherwise("Fail"))


def run_examples(node: Node, examples: DataFrame) -> DataFrame:
    """Rows of a (given, expect) table that the node does not reproduce."""
    got = examples.withColumn("got", node.payload(F.col("given")))
    differs = any_true([~F.col("got")[n].eqNullSafe(F.col("expect")[n]) for n in node.output.fields])
    return got.filter(differs)


# -- generation -------------------------------------------------------------

def generate(spark: SparkSession, edge: Edge, n: int, seed: int = 0, null_share: float = 0.1,
             templates: Mapping[str, list[str]] | None = None, edges: bool = False) -> DataFrame:
    """n rows drawn from the contract's own domain, the same for a given seed.

    Every value is a hash of (row, seed, path), so partitions need no state.
    Fields with a pattern take their values from ``templates[field]``.  With
    ``edges`` the boundary rows come first (their number is fixed by the contract).
    """
    rows = generate_for(spark.range(n), "id", edge, seed, null_share, templates).select("generated.*")
    return boundary_rows(spark, edge, templates).unionByName(rows) if edges else rows


def generate_for(df: DataFrame, key: str, edge: Edge, seed: int = 0, null_share: float = 0.1,
                 templates: Mapping[str, list[str]] | None = None) -> DataFrame:
    """Add a ``generated`` payload to every row of a table, drawn from its key."""
    draw = _Draw(seed, null_share, templates or {})
    body = F.struct(*[draw.value(f, name, F.col(key)).alias(name) for name, f in edge.fields.items()])
    return df.withColumn("generated", body)


def boundary_rows(spark: SparkSession, edge: Edge, templates=None) -> DataFrame:
    """For each field one row per boundary value; the other fields sit at their lowest."""
    domains = {n: _boundaries(f, n, templates or {}) for n, f in edge.fields.items()}
    arms = []
    for name, values in domains.items():
        for v in values:
            arms.append(F.struct(*[(v if m == name else domains[m][0]).alias(m) for m in domains]))
    return spark.range(1).select(F.inline(F.array(*arms))).distinct()


def bounds(f: Field) -> tuple[float, float]:
    low, high = INTEGER_RANGES.get(f.type, FLOAT_RANGE)
    return (low if f.min is None else f.min, high if f.max is None else f.max)


def lengths(f: Field) -> tuple[int, int]:
    low = TEXT_LENGTH[0] if f.min_length is None else f.min_length
    high = max(low, TEXT_LENGTH[1]) if f.max_length is None else f.max_length
    return low, high


def _boundaries(f, name, templates) -> list[Column]:
    if isinstance(f, Edge):
        inner = {n: _boundaries(x, n, templates) for n, x in f.fields.items()}
        return [F.struct(*[v[i if i < len(v) else 0].alias(n) for n, v in inner.items()])
                for i in range(max(len(v) for v in inner.values()))]
    if isinstance(f, Many):
        item = _boundaries(f.edge, name, templates)
        return [F.slice(F.array(item[0]), 1, 0), F.array(*item)]
    kind = f.spark_type
    if f.type == "bool":
        return [F.lit(False), F.lit(True)]
    if f.type == "datetime":
        values = [F.timestamp_seconds(F.lit(s)) for s in EPOCH_RANGE]
    elif f.enum is not None:
        values = [F.lit(v) for v in f.enum]
    elif f.type in TEXT:
        if f.pattern is not None:
            values = [F.lit(v) for v in _template(templates, name)]
        else:
            values = [F.lit(ALPHABET[0] * size) for size in lengths(f)]
    else:
        values = [F.lit(v).cast(kind) for v in bounds(f)]
    return values + ([F.lit(None).cast(kind)] if f.optional else [])


def _template(templates, name) -> list[str]:
    if name not in templates:
        raise ValueError(f"field {name!r} has a pattern: give its values in templates")
    return templates[name]


class _Draw:
    def __init__(self, seed, null_share, templates):
        self.seed, self.null_share, self.templates = seed, null_share, templates

    def bits(self, path: Column | str, row: Column) -> Column:
        path = F.lit(path) if isinstance(path, str) else path
        return F.xxhash64(row, F.lit(self.seed), path)

    def below(self, path, row, n: int) -> Column:
        return F.pmod(self.bits(path, row), F.lit(n))

    def value(self, f, path: str, row: Column) -> Column:
        if isinstance(f, Edge):
            return F.struct(*[self.value(x, f"{path}.{n}", row).alias(n) for n, x in f.fields.items()])
        if isinstance(f, Many):
            low, high = MANY_LENGTH
            size = self.below(path + "#", row, high - low + 1) + low
            spots = F.filter(F.sequence(F.lit(0), F.lit(high)), lambda i: i < size)
            return F.transform(spots, lambda i: F.struct(*[
                self.value(x, f"{path}[].{n}", F.xxhash64(row, i)).alias(n) for n, x in f.edge.fields.items()]))
        drawn = self.scalar(f, path, row)
        if f.optional:
            drawn = F.when(self.below(path + "?", row, 1_000_000) >= int(self.null_share * 1_000_000), drawn)
        return drawn

    def scalar(self, f: Field, path: str, row: Column) -> Column:
        if f.type == "bool":
            return self.below(path, row, 2) == 1
        if f.type == "datetime":
            low, high = EPOCH_RANGE
            return F.timestamp_seconds(self.below(path, row, high - low + 1) + low)
        if f.enum is not None or f.pattern is not None:
            values = list(f.enum) if f.enum is not None else _template(self.templates, path.split(".")[-1])
            return F.element_at(F.array(*[F.lit(v) for v in values]), (self.below(path, row, len(values)) + 1).cast("int"))
        if f.type in TEXT:
            low, high = lengths(f)
            size = (self.below(path + "#", row, high - low + 1) + low).cast("int")
            spots = F.slice(F.sequence(F.lit(0), F.lit(max(high, 1))), F.lit(1), size)
            letter = lambda i: F.substring(F.lit(ALPHABET), (F.pmod(
                F.xxhash64(row, F.lit(self.seed), F.lit(path), i), F.lit(len(ALPHABET))) + 1).cast("int"), F.lit(1))
            return F.array_join(F.transform(spots, letter), "")
        low, high = bounds(f)
        if f.type in INTEGER_RANGES:
            return (self.below(path, row, int(high) - int(low) + 1) + int(low)).cast(f.spark_type)
        part = self.below(path, row, 1 << 30) / F.lit(float((1 << 30) - 1))
        return F.least(F.greatest(part * (high - low) + low, F.lit(float(low))), F.lit(float(high))).cast(f.spark_type)


# -- properties -------------------------------------------------------------

def check_property(node: Node, df: DataFrame, predicate: Callable[[Column, Column], Column],
                   column: str = PAYLOAD) -> DataFrame:
    """Counterexamples of ``for all p: predicate(p, node(p))``; a null verdict counts as one."""
    return (df.withColumn("output", node.payload(F.col(column)))
              .filter(~F.coalesce(predicate(F.col(column), F.col("output")), F.lit(False))))


def check_chain(nodes: list[Node], df: DataFrame, predicate, column: str = PAYLOAD) -> DataFrame:
    """The same for a chain of nodes taken as one node."""
    return check_property(compose("chain", *nodes), df, predicate, column)


def compare_impls(f: Node, g: Node, df: DataFrame, column: str = PAYLOAD) -> DataFrame:
    """Rows on which two implementations of one contract disagree."""
    return (df.withColumns({"first": f.payload(F.col(column)), "second": g.payload(F.col(column))})
              .filter(~F.col("first").eqNullSafe(F.col("second"))))
