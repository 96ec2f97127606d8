"""JSON text decoded against a contract; an absent key differs from a null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracefold.contract import INTEGER_RANGES, TEXT, Edge, Field, Many

# How a JSON value of each kind is named by schema_of_variant.
_NUMBER = r"^(BIGINT|TINYINT|SMALLINT|INT|FLOAT|DOUBLE|DECIMAL\(\d+,\d+\))$"
_VIOLATIONS = "array<struct<path:string,rule:string,actual:string>>"


def _entry(path: Column, rule: str, actual: Column) -> Column:
    return F.struct(path.alias("path"), F.lit(rule).alias("rule"), actual.cast("string").alias("actual"))


def _key(name: str) -> str:
    return "$['" + name.replace("\\", "\\\\").replace("'", "\\'") + "']"


def _sort_of(value: Column) -> Column:
    return F.schema_of_variant(value)


def _scalar_fits(value: Column, sort: Column, f: Field) -> Column:
    if f.type in TEXT:
        return sort == "STRING"
    if f.type == "bool":
        return sort == "BOOLEAN"
    number = sort.rlike(_NUMBER)
    if f.type not in INTEGER_RANGES:
        return number
    as_double = F.try_variant_get(value, "$", "double")
    return number & (F.floor(as_double) == as_double)


def _fields(obj: Column, edge: Edge, prefix: Column | None) -> Column:
    found = []
    for name, f in edge.fields.items():
        path = F.lit(name) if prefix is None else F.concat(prefix, F.lit("." + name))
        value = F.try_variant_get(obj, _key(name), "variant")
        found.append(_value(value, f, path))
    return F.concat(*found) if found else F.array().cast(_VIOLATIONS)


def _value(value: Column, f, path: Column) -> Column:
    none = F.array().cast(_VIOLATIONS)
    sort = _sort_of(value)
    shown = value.try_cast("string")
    # The null kind of schema_of_variant: SQL NULL value -> "NULL"/null, JSON null -> "VOID".
    missing = F.array(_entry(path, "missing", F.lit(None)))
    null = F.array(_entry(path, "null", F.lit(None)))
    wrong = F.array(_entry(path, "type", F.coalesce(shown, F.to_json(value))))
    if isinstance(f, Edge):
        inside = F.when(sort.startswith("OBJECT"), _fields(value, f, path)).otherwise(wrong)
    elif isinstance(f, Many):
        items = F.try_variant_get(value, "$", "array<variant>")
        inside = F.when(sort.startswith("ARRAY"), F.flatten(F.transform(items, lambda x, i: _item(
            x, f.edge, F.concat(path, F.lit("["), i.cast("string"), F.lit("]")))))).otherwise(wrong)
    else:
        inside = F.when(_scalar_fits(value, sort, f), none).otherwise(wrong)
    on_null = none if isinstance(f, Field) and f.optional else null
    return F.when(value.isNull(), missing).when(F.is_variant_null(value), on_null).otherwise(inside)


def _item(x: Column, edge: Edge, path: Column) -> Column:
    return F.when(_sort_of(x).startswith("OBJECT"), _fields(x, edge, path)).otherwise(
        F.array(_entry(path, "type", F.to_json(x))))


def json_violations(raw: Column, edge: Edge) -> Column:
    """Shape faults of JSON text: malformed, not an object, missing, null, wrong type."""
    obj = F.try_parse_json(raw)
    at = F.lit(edge.name)
    return (F.when(obj.isNull(), F.array(_entry(at, "malformed", raw)))
             .when(~_sort_of(obj).startswith("OBJECT"), F.array(_entry(at, "object", raw)))
             .otherwise(_fields(obj, edge, None)))


def json_payload(raw: Column, edge: Edge) -> Column:
    """The typed payload struct; values that do not fit become null."""
    obj = F.try_parse_json(raw)
    return F.struct(*[
        F.try_variant_get(obj, _key(n), _ddl(f)).alias(n) if not (isinstance(f, Field) and f.type == "datetime")
        else F.try_to_timestamp(F.try_variant_get(obj, _key(n), "string")).alias(n)
        for n, f in edge.fields.items()])


def _ddl(f) -> str:
    if isinstance(f, Many):
        return f"array<{f.edge.struct_type().simpleString()}>"
    if isinstance(f, Edge):
        return f.struct_type().simpleString()
    return f.spark_type.simpleString()


def decode(df, raw: str, edge: Edge):
    """Add ``payload`` and ``violations`` for a column of JSON text."""
    return df.withColumns({
        "payload": json_payload(F.col(raw), edge),
        "violations": json_violations(F.col(raw), edge),
    })
