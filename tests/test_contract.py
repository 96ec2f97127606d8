"""Contract declarations and the structural fingerprint."""

import pytest
from hypothesis import given, strategies as st
from pyspark.sql import types as T

from tracefold.contract import FAIL, PASS, UNIT, ContractError, Edge, Field, Many, Relation


def age(**kw):
    return Field("uint8", "Age", "The person's age", **{"nullable": False, **kw})


def text(**kw):
    return Field("utf8", "Text", "Some text", **{"nullable": False, **kw})


# Fingerprints that logs written elsewhere carry.
@pytest.mark.parametrize("edge, short", [
    (UNIT, "c73deff6"),
    (PASS, "c5d6ca8d"),
    (FAIL, "10f3815f"),
    (Edge("Person", fields={"age": age()}), "4b7c35de"),
    (Edge("Person", fields={"age": age(min=0, max=150)}), "a448d7ca"),
])
def test_golden_hashes(edge, short):
    assert edge.short_hash == short
    assert len(edge.schema_hash) == 64
    edge.assert_hash(short)


def test_drift_is_reported():
    with pytest.raises(ContractError, match="Person"):
        Edge("Person", fields={"age": age()}).assert_hash("a448d7ca")


BASE = Edge("Base", fields={"id": Field("uint32", "Id", "Id", nullable=False), "amount": Field("f32", "A", "A", nullable=False)})


def changed(**kw):
    return Edge("Base", fields={**BASE.fields, "amount": Field("f32", "A", "A", **{"nullable": False, **kw})})


@pytest.mark.parametrize("change", [
    {"measure": "quantitative"}, {"format": "count"}, {"min": 0}, {"max": 5}, {"nullable": True},
    {"relation": Relation("Person", "id", "many:1")},
])
def test_structure_changes_the_hash(change):
    assert changed(**change).schema_hash != BASE.schema_hash


@pytest.mark.parametrize("change", [{"unit": "EUR"}, {"source_key": "amt"}])
def test_annotations_do_not(change):
    assert changed(**change).schema_hash == BASE.schema_hash
    assert Edge("Base", "Label", "Words", dict(BASE.fields)).schema_hash == BASE.schema_hash


def test_order_of_fields_and_words_is_free():
    a = Edge("E", fields={"x": text(enum=("a", "b")), "y": age()})
    b = Edge("E", fields={"y": age(), "x": text(enum=("b", "a"))})
    assert a.schema_hash == b.schema_hash


def test_nesting_and_repetition_differ():
    task = Edge("Task", fields={"title": text()})
    one, several = Edge("L", fields={"t": task}), Edge("L", fields={"t": Many(task)})
    deeper = Edge("L", fields={"t": Edge("Task", fields={"title": text(max_length=9)})})
    assert len({one.schema_hash, several.schema_hash, deeper.schema_hash}) == 3


def test_equal_bounds_written_differently():
    assert Edge("E", fields={"a": age(min=1, max=2)}).schema_hash == Edge("E", fields={"a": age(min=1.0, max=2.0)}).schema_hash


@given(st.permutations(["a", "b", "c", "d"]))
def test_any_field_order_hashes_equally(names):
    edge = Edge("E", fields={n: text(max_length=ord(n)) for n in names})
    assert edge.schema_hash == Edge("E", fields={n: text(max_length=ord(n)) for n in "abcd"}).schema_hash


@pytest.mark.parametrize("make", [
    lambda: age(min=-1), lambda: age(max=256), lambda: age(min=5, max=4), lambda: age(min=0.5),
    lambda: age(min_length=1), lambda: age(pattern="x"), lambda: age(enum=("a",)), lambda: age(nullable=None),
    lambda: text(min=1), lambda: text(min_length=-1), lambda: text(min_length=3, max_length=2),
    lambda: text(pattern="["), lambda: text(enum=("a",), max_length=3), lambda: text(enum=("a",), pattern="a"),
    lambda: Field("bool", "B", "B", nullable=False), lambda: Field("bool", "B", "B", min=0),
    lambda: Field("int64", "I", "I", nullable=False), lambda: Field("datetime", "D", "D", nullable=False, min=1),
    lambda: Field("int8", "I", "I", nullable=False, min=-129), lambda: Field("uint16", "I", "I", nullable=False, max=65536),
    lambda: Relation("E", "f", "some:1"), lambda: age(measure="odd"), lambda: age(format="odd"),
    lambda: Edge("E", fields={}, index="id"),
])
def test_bad_declarations(make):
    with pytest.raises(ContractError):
        make()


@pytest.mark.parametrize("make", [
    lambda: age(min=0, max=255), lambda: Field("f64", "F", "F", nullable=True, min=-1.5, max=1e300),
    lambda: Field("int32", "I", "I", nullable=False, min=-2147483648, max=2147483647),
    lambda: Field("bool", "B", "B"), lambda: Field("datetime", "D", "D", nullable=True, max_length=30),
    lambda: text(pattern="^[a-z]+$", min_length=1),
])
def test_good_declarations(make):
    make()


def test_struct_type_follows_the_contract():
    home = Edge("Home", fields={"street": text()})
    edge = Edge("P", fields={"age": age(), "due": Field("datetime", "D", "D", nullable=True), "home": home, "homes": Many(home),
                             "ok": Field("bool", "Ok", "Ok")})
    shape = edge.struct_type()
    assert [f.dataType.typeName() for f in shape] == ["short", "timestamp", "struct", "array", "boolean"]
    assert [f.nullable for f in shape] == [False, True, False, False, False]
    assert shape["homes"].dataType == T.ArrayType(home.struct_type(), False)
    assert shape["age"].metadata["label"] == "Age"


def test_spread_shares_shape():
    parrot = BASE.spread("Parrot", wingspan=Field("f32", "W", "W", nullable=False))
    assert list(parrot.fields) == ["id", "amount", "wingspan"] and parrot.schema_hash != BASE.schema_hash
    assert list(BASE.spread("Thin", drop=("amount",)).fields) == ["id"]


@pytest.mark.parametrize("number, text", [
    (1e-7, "1e-7"), (1.5e-9, "1.5e-9"), (1e-6, "0.000001"), (0.00012, "0.00012"), (1e21, "1e+21"), (1.25e22, "1.25e+22"), (1e20, "100000000000000000000"),
    (123.456, "123.456"), (-0.5, "-0.5"), (150, "150"), (0, "0"), (-0.0, "0"), (1200, "1200"), (2**53, "9007199254740992")])
def test_number_text_in_fingerprints(number, text):
    from tracefold.contract import _json

    assert _json({"min": [number]}) == f'{{"min":[{text}]}}'
