"""Typed record contracts ("edges") and their structural fingerprint.

A contract is declared in Python, never inferred from data.  It gives the Spark
schema of a payload, the bounds that data must meet, and a hash over its
structure that every log row carries.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Mapping
from dataclasses import dataclass, field as _field, replace
from decimal import Decimal
from typing import Any

from pyspark.sql import types as T

# The representable range of each integer scalar.
INTEGER_RANGES = {
    "uint8": (0, 255),
    "uint16": (0, 65535),
    "uint32": (0, 4294967295),
    "int8": (-128, 127),
    "int16": (-32768, 32767),
    "int32": (-2147483648, 2147483647),
}

# The Spark type that holds each scalar without loss.
SPARK_TYPES = {
    "utf8": T.StringType(),
    "bool": T.BooleanType(),
    "uint8": T.ShortType(),
    "uint16": T.IntegerType(),
    "uint32": T.LongType(),
    "int8": T.ByteType(),
    "int16": T.ShortType(),
    "int32": T.IntegerType(),
    "f32": T.FloatType(),
    "f64": T.DoubleType(),
    "datetime": T.TimestampType(),
}

# The allowed words of the three annotations.
MEASURES = ("nominal", "ordinal", "quantitative", "temporal")
FORMATS = ("id", "enum", "text", "date", "datetime", "count", "percentage")
CARDINALITIES = ("1:1", "1:many", "many:1", "many:many")

TEXT = ("utf8", "datetime")


class ContractError(ValueError):
    """A contract is badly declared, or a table cannot meet it."""


@dataclass(frozen=True)
class Relation:
    """A domain fact: this field refers to ``field`` of ``edge``."""

    edge: str
    field: str
    cardinality: str

    def __post_init__(self):
        if self.cardinality not in CARDINALITIES:
            raise ContractError(f"unknown cardinality {self.cardinality!r}")


@dataclass(frozen=True)
class Field:
    type: str
    label: str
    description: str
    nullable: bool | None = None
    measure: str | None = None
    format: str | None = None
    unit: str | None = None
    enum: tuple[str, ...] | None = None
    relation: Relation | None = None
    min: float | None = None
    max: float | None = None
    min_length: int | None = None
    max_length: int | None = None
    pattern: str | None = None
    source_key: str | None = None

    def __post_init__(self):
        problem = self._problem()
        if problem:
            raise ContractError(f"{self.type} field {self.label!r}: {problem}")

    def _problem(self) -> str | None:
        if self.type not in SPARK_TYPES:
            return "unknown scalar type"
        if self.measure is not None and self.measure not in MEASURES:
            return f"unknown measure {self.measure!r}"
        if self.format is not None and self.format not in FORMATS:
            return f"unknown format {self.format!r}"
        if self.type == "bool":
            if self.nullable is not None:
                return "bool cannot declare nullable"
        elif not isinstance(self.nullable, bool):
            return "nullable must be declared true or false"

        numeric = self.type not in TEXT and self.type != "bool"
        lengths = (self.min_length, self.max_length)
        if self.type not in TEXT:
            if any(n is not None for n in lengths):
                return "minLength/maxLength are for text"
            if self.pattern is not None:
                return "pattern is for text"
            if self.enum is not None:
                return "enumValues are for text"
        if not numeric and (self.min is not None or self.max is not None):
            return "min/max are for numbers"
        return self._bounds_problem(lengths)

    def _bounds_problem(self, lengths) -> str | None:
        if self.min is not None and self.max is not None and self.min > self.max:
            return f"min {self.min} exceeds max {self.max}"
        if self.type in INTEGER_RANGES:
            low, high = INTEGER_RANGES[self.type]
            for bound in (self.min, self.max):
                if bound is None:
                    continue
                if not low <= bound <= high:
                    return f"bound {bound} outside the representable range"
                if bound != int(bound):
                    return f"bound {bound} must be an integer"
        shortest, longest = lengths
        if shortest is not None and shortest < 0:
            return "minLength cannot be negative"
        if shortest is not None and longest is not None and shortest > longest:
            return "minLength exceeds maxLength"
        if self.pattern is not None:
            try:
                re.compile(self.pattern)
            except re.error:
                return f"pattern {self.pattern!r} is not a valid regex"
        if self.enum is not None and (self.pattern is not None or any(n is not None for n in lengths)):
            return "enumValues cannot combine with pattern or lengths"
        return None

    @property
    def optional(self) -> bool:
        return bool(self.nullable)

    @property
    def spark_type(self) -> T.DataType:
        return SPARK_TYPES[self.type]

    def metadata(self) -> dict[str, Any]:
        """Descriptive notes that travel with the Spark column."""
        notes = {
            "label": self.label,
            "description": self.description,
            "scalar": self.type,
            "measure": self.measure,
            "format": self.format,
            "unit": self.unit,
        }
        return {k: v for k, v in notes.items() if v is not None}


@dataclass(frozen=True)
class Many:
    """A repeated field: an array of another contract's payloads."""

    edge: "Edge"


@dataclass(frozen=True)
class Edge:
    name: str
    label: str = ""
    description: str = ""
    fields: Mapping[str, "Field | Edge | Many"] = _field(default_factory=dict)
    index: str | None = None

    def __post_init__(self):
        if self.index is not None and self.index not in self.fields:
            raise ContractError(f"{self.name}: index {self.index!r} is not a field")

    def __hash__(self):
        return hash((self.name, self.schema_hash))

    def struct_type(self) -> T.StructType:
        return T.StructType([
            T.StructField(name, _spark_type(f), isinstance(f, Field) and f.optional,
                          f.metadata() if isinstance(f, Field) else {})
            for name, f in self.fields.items()
        ])

    def structure(self) -> dict[str, Any]:
        """The part of the contract that decides whether data still fits it."""
        shape: dict[str, Any] = {"name": self.name}
        if self.index is not None:
            shape["index"] = self.index
        shape["fields"] = {name: _structure(self.fields[name]) for name in sorted(self.fields)}
        return shape

    @property
    def schema_hash(self) -> str:
        text = _json(self.structure())
        return hashlib.sha256(text.encode("utf-8")).hexdigest()

    @property
    def short_hash(self) -> str:
        return self.schema_hash[:8]

    def assert_hash(self, expected_short: str) -> None:
        if self.short_hash != expected_short:
            raise ContractError(
                f"schema drift on edge {self.name!r}: expected {expected_short!r}, have {self.short_hash!r}")

    def spread(self, name: str, drop: tuple[str, ...] = (), **extra) -> "Edge":
        """A new contract sharing this one's fields (shape reuse, not inheritance)."""
        kept = {k: v for k, v in self.fields.items() if k not in drop}
        index = self.index if self.index in kept else None
        return Edge(name, self.label, self.description, {**kept, **extra}, index)

    def accepts(self, other: "Edge") -> bool:
        """Structural fit: ``other`` has every field of this contract, with the same type."""
        return all(n in other.fields and _fits(f, other.fields[n]) for n, f in self.fields.items())

    def typed(self) -> "Edge":
        """The same contract for data already under its declared names."""
        bare = {n: replace(f, source_key=None) if isinstance(f, Field)
                else f.typed() if isinstance(f, Edge) else Many(f.edge.typed()) for n, f in self.fields.items()}
        return replace(self, fields=bare)

    def failed(self) -> str:
        return f"Failed<{self.name}>"


def _fits(wanted, given) -> bool:
    if isinstance(wanted, Many) and isinstance(given, Many):
        return wanted.edge.accepts(given.edge)
    if isinstance(wanted, Edge) and isinstance(given, Edge):
        return wanted.accepts(given)
    return (isinstance(wanted, Field) and isinstance(given, Field) and wanted.type == given.type
            and (wanted.optional or not given.optional))


def _spark_type(f) -> T.DataType:
    if isinstance(f, Many):
        return T.ArrayType(f.edge.struct_type(), containsNull=False)
    if isinstance(f, Edge):
        return f.struct_type()
    return f.spark_type


def _plain_number(n):
    """Write 1.0 as 1, so equal bounds hash equally however they were typed."""
    return int(n) if float(n).is_integer() else n


def _number_text(n) -> str:
    """A number as ECMAScript prints it: a double's shortest digits, plain from 1e-6 up to below 1e21."""
    sign, digits, exponent = Decimal(repr(float(n))).normalize().as_tuple()
    if digits == (0,):
        return "0"
    text, point = "".join(map(str, digits)), len(digits) + exponent
    if not -6 < point <= 21:
        text = f"{text[0]}{'.' + text[1:] if text[1:] else ''}e{point - 1:+d}"
    elif point <= 0:
        text = "0." + "0" * -point + text
    elif point >= len(text):
        text = text.ljust(point, "0")
    else:
        text = f"{text[:point]}.{text[point:]}"
    return "-" + text if sign else text


def _json(value) -> str:
    """Compact JSON; numbers in the text that fingerprints need."""
    if isinstance(value, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{_json(v)}" for k, v in value.items()) + "}"
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(_json, value)) + "]"
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return _number_text(value)
    return json.dumps(value, ensure_ascii=False)


def _structure(f) -> dict[str, Any]:
    if isinstance(f, Many):
        return {"many": f.edge.structure()}
    if isinstance(f, Edge):
        return {"edge": f.structure()}
    limits = {
        "min": None if f.min is None else _plain_number(f.min),
        "max": None if f.max is None else _plain_number(f.max),
        "minLength": f.min_length,
        "maxLength": f.max_length,
        "pattern": f.pattern,
    }
    limits = {k: v for k, v in limits.items() if v is not None}
    # The key order below is part of the hashed text.
    parts = [
        ("type", f.type),
        ("measure", f.measure),
        ("format", f.format),
        ("enumValues", None if f.enum is None else sorted(f.enum)),
        ("relation", None if f.relation is None else {
            "edge": f.relation.edge,
            "field": f.relation.field,
            "cardinality": f.relation.cardinality,
        }),
        ("validations", limits or None),
        ("nullable", True if f.optional else None),
    ]
    return {k: v for k, v in parts if v is not None}


# Field-less contracts used across the library.
UNIT = Edge("Unit", "Unit", "No payload")
PASS = Edge("Pass", "Pass", "A passing check")
FAIL = Edge("Fail", "Fail", "A failing check")
