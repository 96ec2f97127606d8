"""Contracts applied to tables: projection, validation, splitting, drift, profiles."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracefold.contract import INTEGER_RANGES, TEXT, ContractError, Edge, Field, Many, Relation
from tracefold.functions.columns import all_true
from tracefold.functions.outcomes import settle

LEVELS = ("shape", "domain")
VIOLATION = "struct<path:string,rule:string,actual:string>"
_NO_VIOLATIONS = f"array<{VIOLATION}>"


# -- raw columns ------------------------------------------------------------

def _raw_type(schema: T.StructType, name: str) -> T.DataType | None:
    for f in schema.fields:
        if f.name == name:
            return f.dataType
    return None


def _source(name: str, f) -> str:
    return f.source_key if isinstance(f, Field) and f.source_key else name


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _typed(raw: Column, f, raw_type: T.DataType | None, path: str) -> Column:
    """The raw value as the contract's Spark type; unfit values become null."""
    if raw_type is None:
        raise ContractError(f"column for {path} is missing")
    if isinstance(f, Many):
        if not isinstance(raw_type, T.ArrayType) or not isinstance(raw_type.elementType, T.StructType):
            raise ContractError(f"{path} must be an array of structs")
        return F.transform(raw, lambda x: _typed_struct(x, f.edge, raw_type.elementType, path))
    if isinstance(f, Edge):
        if not isinstance(raw_type, T.StructType):
            raise ContractError(f"{path} must be a struct")
        return _typed_struct(raw, f, raw_type, path)
    if f.type == "datetime" and isinstance(raw_type, T.StringType):
        return F.try_to_timestamp(raw)
    if raw_type == f.spark_type:
        return raw
    return raw.try_cast(f.spark_type)


def _typed_struct(raw: Column, edge: Edge, raw_type: T.StructType, path: str) -> Column:
    built = F.struct(*[
        _typed(raw[_source(n, f)], f, _raw_type(raw_type, _source(n, f)), f"{path}.{n}").alias(n)
        for n, f in edge.fields.items()])
    return F.when(raw.isNotNull(), built)


def apply_contract(df: DataFrame, edge: Edge, keep: Iterable[str] = ()) -> DataFrame:
    """Project to the declared fields, typed, renamed and annotated.

    ``keep`` names further columns to carry along unchanged.  A table lacking a
    declared column is refused when the plan is built.
    """
    return df.select(*[F.col(_quoted(k)) for k in keep], *_contract_columns(df, edge))


def _contract_columns(df: DataFrame, edge: Edge) -> list[Column]:
    columns = []
    for name, f in edge.fields.items():
        src = _source(name, f)
        value = _typed(F.col(_quoted(src)), f, _raw_type(df.schema, src), f"{edge.name}.{name}")
        columns.append(value.alias(name, metadata=f.metadata() if isinstance(f, Field) else {}))
    return columns


def payload(df: DataFrame, edge: Edge) -> Column:
    """The contract's payload struct, read from the columns of ``df``."""
    return F.struct(*[
        _typed(F.col(_quoted(_source(n, f))), f, _raw_type(df.schema, _source(n, f)), n).alias(n)
        for n, f in edge.fields.items()])


# -- checks -----------------------------------------------------------------

def _violation(path: Column, rule: str, actual: Column) -> Column:
    return F.struct(path.alias("path"), F.lit(rule).alias("rule"), actual.cast("string").alias("actual"))


def _is_numeric(t: T.DataType) -> bool:
    return isinstance(t, T.NumericType)


def _scalar_rules(raw: Column, f: Field, raw_type: T.DataType, level: str) -> list[tuple[str, Column]]:
    """(rule, condition that is true when a present value breaks the rule)."""
    rules: list[tuple[str, Column]] = []
    whole = f.type in INTEGER_RANGES
    if whole and _is_numeric(raw_type):
        if isinstance(raw_type, (T.FractionalType, T.DecimalType)):
            rules.append(("type", F.isnan(raw) | (F.floor(raw) != raw)
                          if isinstance(raw_type, T.FractionalType) and not isinstance(raw_type, T.DecimalType)
                          else F.floor(raw) != raw))
        if level == "domain":
            low, high = INTEGER_RANGES[f.type]
            if not _fits(raw_type, low, high):
                rules.append(("range", (raw < low) | (raw > high)))
        elif raw_type != f.spark_type:
            rules.append(("type", _typed(raw, f, raw_type, "").isNull()))
    elif f.type == "utf8" and not isinstance(raw_type, T.StringType):
        rules.append(("type", F.lit(True)))
    elif raw_type != f.spark_type:
        rules.append(("type", _typed(raw, f, raw_type, "").isNull()))
    if level == "shape":
        return rules

    value = raw if _is_numeric(raw_type) else _typed(raw, f, raw_type, "")
    if f.type in TEXT:
        text = raw if isinstance(raw_type, T.StringType) else raw.cast("string")
        if f.min_length is not None:
            rules.append(("minLength", F.char_length(text) < f.min_length))
        if f.max_length is not None:
            rules.append(("maxLength", F.char_length(text) > f.max_length))
        if f.pattern is not None:
            rules.append(("pattern", ~text.rlike(f.pattern)))
        if f.enum is not None:
            rules.append(("enumValues", ~text.isin(*f.enum)))
        return rules
    if whole and not _is_numeric(raw_type):
        low, high = INTEGER_RANGES[f.type]
        if not _fits(f.spark_type, low, high):
            rules.append(("range", (value < low) | (value > high)))
    if f.min is not None:
        rules.append(("min", value < f.min))
    if f.max is not None:
        rules.append(("max", value > f.max))
    return rules


def _fits(t: T.DataType, low: int, high: int) -> bool:
    """Whether every value of the integral type already lies in the range."""
    bits = {T.ByteType: 8, T.ShortType: 16, T.IntegerType: 32, T.LongType: 64}.get(type(t))
    return bits is not None and low <= -(1 << bits - 1) and (1 << bits - 1) - 1 <= high


def _check(raw: Column, f, raw_type: T.DataType | None, path: Column, level: str) -> tuple[Column, Column]:
    """(array of violations, predicate that holds exactly when there are none)."""
    none = F.array().cast(_NO_VIOLATIONS)
    if raw_type is None:
        return F.array(_violation(path, "missing", F.lit(None))), F.lit(False)

    if isinstance(f, (Edge, Many)):
        found, valid = _check_nested(raw, f, raw_type, path, level)
        absent = F.array(_violation(path, "null", F.lit(None)))
        return F.when(raw.isNull(), absent).otherwise(F.coalesce(found, none)), raw.isNotNull() & valid

    rules = _scalar_rules(raw, f, raw_type, level)
    entries = [F.when(raw.isNotNull() & broken, _violation(path, rule, raw)) for rule, broken in rules]
    valid = all_true([~broken for _, broken in rules])
    if f.optional:
        valid = raw.isNull() | valid
    else:
        entries.insert(0, F.when(raw.isNull(), _violation(path, "null", F.lit(None))))
        valid = raw.isNotNull() & valid
    return (F.array_compact(F.array(*entries)) if entries else none), valid


def _check_nested(raw, f, raw_type, path, level):
    if isinstance(f, Edge):
        if not isinstance(raw_type, T.StructType):
            return F.array(_violation(path, "type", raw)), F.lit(False)
        return _check_fields(lambda n: raw[n], f, raw_type, path, level)
    if not isinstance(raw_type, T.ArrayType) or not isinstance(raw_type.elementType, T.StructType):
        return F.array(_violation(path, "type", F.lit(None))), F.lit(False)
    element = raw_type.elementType

    def at(x, i):
        where = F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))
        found, _ = _check_fields(lambda n: x[n], f.edge, element, where, level)
        return F.when(x.isNull(), F.array(_violation(where, "null", F.lit(None)))).otherwise(found)

    def fits(x):
        return F.coalesce(x.isNotNull() & _check_fields(lambda n: x[n], f.edge, element, path, level)[1],
                          F.lit(False))

    return F.flatten(F.transform(raw, at)), F.forall(raw, fits)


def _check_fields(get: Callable[[str], Column], edge: Edge, schema: T.StructType, prefix: Column | None, level: str):
    found, valid = [], []
    for name, f in edge.fields.items():
        src = _source(name, f)
        path = F.lit(name) if prefix is None else F.concat(prefix, F.lit("." + name))
        raw_type = _raw_type(schema, src)
        v, ok = _check(None if raw_type is None else get(src), f, raw_type, path, level)
        found.append(v)
        valid.append(ok)
    if not found:
        return F.array().cast(_NO_VIOLATIONS), F.lit(True)
    return (found[0] if len(found) == 1 else F.concat(*found)), all_true(valid)


def _table_check(df: DataFrame, edge: Edge, level: str, column: str | None = None):
    if level not in LEVELS:
        raise ContractError(f"unknown level {level!r}")
    if column is None:
        return _check_fields(lambda n: F.col(_quoted(n)), edge, df.schema, None, level)
    schema = df.schema[column].dataType
    return _check_fields(lambda n: F.col(column)[n], edge.typed(), schema, None, level)


def violations(df: DataFrame, edge: Edge, level: str = "shape", column: str | None = None) -> Column:
    """All faults of each row as an array of {path, rule, actual}.

    ``shape``: missing columns, wrong types, nulls.  ``domain`` adds ranges and
    declared bounds.  ``column`` checks a payload struct (declared names) instead of the row.
    """
    return _table_check(df, edge, level, column)[0]


def is_valid(df: DataFrame, edge: Edge, level: str = "shape", column: str | None = None) -> Column:
    """Plain predicate form of ``violations(...) is empty``; reaches the scan."""
    return _table_check(df, edge, level, column)[1]


def conform(df: DataFrame, edge: Edge, level: str = "domain",
            keep: Iterable[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(valid typed rows, ``Failed`` rows holding the raw input and the reasons).  ``df`` is read once."""
    return settle(*judged(df, edge, level, keep), "conform")


def conforming(df: DataFrame, edge: Edge, level: str = "domain", keep: Iterable[str] = ()) -> DataFrame:
    """The valid rows only, as a plain filter that reaches the scan: for readers who leave the others."""
    return apply_contract(df.filter(is_valid(df, edge, level)), edge, keep)


def judged(df: DataFrame, edge: Edge, level: str, keep: Iterable[str] = ()) -> tuple[DataFrame, Column, Column, Column]:
    """What ``settle`` takes: the rows, whether one is valid, and its row on either side."""
    found, valid = _table_check(df, edge, level)
    missing = [n for n, f in edge.fields.items() if _raw_type(df.schema, _source(n, f)) is None]
    if missing:
        raise ContractError(f"{edge.name}: missing columns {missing}")
    kept = [F.col(_quoted(k)) for k in keep]
    failed = F.struct(*kept, F.lit(edge.failed()).alias("edge"), F.struct(*[F.col(_quoted(c)) for c in df.columns]).alias("input"),
                      found.alias("reason"))
    return df, valid, F.struct(*kept, *_contract_columns(df, edge)), failed


# -- keys and relations -----------------------------------------------------

def check_index(df: DataFrame, edge: Edge | None = None, keys: list[str] | None = None) -> DataFrame:
    """Identifiers that are null or occur more than once, with their counts."""
    keys = keys or [edge.index]
    some_null = F.lit(False)
    for k in keys:
        some_null = some_null | F.col(k).isNull()
    return (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("instances"))
              .filter(some_null | (F.col("instances") > 1)))


def check_relation(df: DataFrame, key: str, other: DataFrame, other_key: str, declared: str) -> DataFrame:
    """One row: orphans on either side and the observed against the declared cardinality.

    Both sides are counted per key first, so the join meets each key once.
    """
    left = (df.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("k"))
              .agg(F.count(F.lit(1)).alias("l")))
    right = (other.filter(F.col(other_key).isNotNull()).groupBy(F.col(other_key).alias("k"))
                  .agg(F.count(F.lit(1)).alias("r")))
    both = left.join(right, "k", "full")
    paired = F.col("l").isNotNull() & F.col("r").isNotNull()
    seen = both.agg(
        F.coalesce(F.sum(F.when(F.col("r").isNull(), F.col("l"))), F.lit(0)).alias("orphans"),
        F.coalesce(F.sum(F.when(F.col("l").isNull(), F.col("r"))), F.lit(0)).alias("unreferenced"),
        F.coalesce(F.max(F.when(paired, F.col("l"))), F.lit(0)).alias("max_left"),
        F.coalesce(F.max(F.when(paired, F.col("r"))), F.lit(0)).alias("max_right"))
    left_word, right_word = declared.split(":")
    many_left, many_right = F.col("max_left") > 1, F.col("max_right") > 1
    return seen.select(
        "orphans", "unreferenced",
        F.concat(F.when(many_left, "many").otherwise("1"), F.lit(":"),
                 F.when(many_right, "many").otherwise("1")).alias("observed"),
        F.lit(declared).alias("declared"),
        ((F.lit(left_word == "many") | ~many_left)
         & (F.lit(right_word == "many") | ~many_right)).alias("holds"))


def relation_of(edge: Edge, field: str) -> Relation:
    relation = edge.fields[field].relation
    if relation is None:
        raise ContractError(f"{edge.name}.{field} declares no relation")
    return relation


# -- fingerprints -----------------------------------------------------------

def stamp_schema_hash(df: DataFrame, edge: Edge, column: str = "schema_hash", short: bool = False) -> DataFrame:
    """Add the contract's fingerprint as a constant column."""
    return df.withColumn(column, F.lit(edge.short_hash if short else edge.schema_hash))


def catalog_table(df: DataFrame, edges: Iterable[Edge], short: bool = False) -> DataFrame:
    """The contracts as a table (edge, hash); one row per declared edge."""
    rows = [(e.name, e.short_hash if short else e.schema_hash) for e in edges]
    return df.sparkSession.createDataFrame(rows, "edge string, hash string")


def drift_report(log: DataFrame, edges: Iterable[Edge], short: bool = False) -> DataFrame:
    """Rows per (edge, recorded hash): current, stale, or unknown edge."""
    counted = log.groupBy("edge", "schema_hash").agg(F.count(F.lit(1)).alias("instances"))
    known = catalog_table(log, edges, short)
    return (counted.join(F.broadcast(known), "edge", "left")  # one row per declared contract
            .select("edge", "schema_hash", "instances",
                    F.when(F.col("hash").isNull(), "unknown")
                     .when(F.col("hash") == F.col("schema_hash"), "current")
                     .otherwise("stale").alias("status")))


def migrate_or_refuse(log: DataFrame, edge: Edge, rules: Mapping[str, Callable[[Column], Column]],
                      body: str = "payload") -> tuple[DataFrame, DataFrame]:
    """Bring stale rows of one edge to its current contract.

    ``rules`` maps an old hash to ``fn(old payload) -> new payload struct``.
    Current rows pass through their fields; hashes with no rule are refused.
    """
    current = edge.schema_hash
    shape = edge.struct_type().simpleString()
    old = F.col(body)
    identity = {current: lambda p: p}
    known = {**identity, **dict(rules)}
    migrated = None
    for recorded, rule in known.items():
        try_shape = rule(old).cast(shape)
        hit = F.col("schema_hash") == recorded
        migrated = F.when(hit, try_shape) if migrated is None else migrated.when(hit, try_shape)
    usable = F.col("schema_hash").isin(*known)
    ok = (log.filter(usable)
             .withColumns({body: migrated, "migrated": F.col("schema_hash") != current})
             .withColumn("schema_hash", F.lit(current)))
    refused = (log.filter(~F.coalesce(usable, F.lit(False)))
                  .withColumn("reason", F.concat(F.lit("no rule from "), F.coalesce("schema_hash", F.lit("null")))))
    return ok, refused


# -- profile ----------------------------------------------------------------

def _measure(f: Field) -> str:
    if f.measure:
        return f.measure
    if f.type == "datetime":
        return "temporal"
    return "nominal" if f.type in ("utf8", "bool") else "quantitative"


def field_dictionary(df: DataFrame, edge: Edge, exact: bool = False) -> DataFrame:
    """One row per scalar field: counts, nulls, distinct values and the range.

    A single pass.  Distinct counts are sketches unless ``exact``; quartiles of
    quantitative fields come with the sketch form.
    """
    scalars = {n: f for n, f in edge.fields.items() if isinstance(f, Field)}
    aggs = [F.count(F.lit(1)).alias("rows")]
    for n, f in scalars.items():
        c = F.col(n)
        aggs += [
            F.sum(F.when(c.isNull(), 1).otherwise(0)).alias(f"{n}__nulls"),
            (F.countDistinct(c) if exact else F.approx_count_distinct(c)).alias(f"{n}__distinct"),
            F.min(c).cast("string").alias(f"{n}__min"),
            F.max(c).cast("string").alias(f"{n}__max"),
        ]
        if _measure(f) == "quantitative":
            aggs.append(F.avg(c).cast("double").alias(f"{n}__mean"))
            if not exact:
                aggs.append(F.percentile_approx(c.cast("double"), [0.25, 0.5, 0.75]).alias(f"{n}__quartiles"))
    row = df.agg(*aggs)
    entries = []
    for n, f in scalars.items():
        m = _measure(f)
        ranged, numeric = m != "nominal", m == "quantitative"
        entries.append(F.struct(
            F.lit(n).alias("field"), F.lit(m).alias("measure"), F.col("rows"),
            F.col(f"{n}__nulls").alias("nulls"), F.col(f"{n}__distinct").alias("distinct"),
            (F.col(f"{n}__min") if ranged else F.lit(None).cast("string")).alias("lowest"),
            (F.col(f"{n}__max") if ranged else F.lit(None).cast("string")).alias("highest"),
            (F.col(f"{n}__mean") if numeric else F.lit(None).cast("double")).alias("mean"),
            (F.col(f"{n}__quartiles") if numeric and not exact
             else F.lit(None).cast("array<double>")).alias("quartiles")))
    return row.select(F.inline(F.array(*entries)))


def top_values(df: DataFrame, field: str, k: int = 10) -> DataFrame:
    """The k most frequent values of a nominal field."""
    return (df.groupBy(F.col(field).cast("string").alias("value"))
              .agg(F.count(F.lit(1)).alias("instances"))
              .orderBy(F.desc("instances"), "value").limit(k))
