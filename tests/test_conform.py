"""Validation of columns, structs, arrays and JSON text."""

import pytest
from pyspark.sql import functions as F

from tracefold.contract import ContractError, Edge, Field, Many
from tracefold.operators import conform as ops
from tracefold.sources.text import decode, json_violations

PERSON = Edge("Person", fields={
    "age": Field("uint8", "Age", "Age", nullable=False),
    "nickname": Field("utf8", "Nickname", "Nickname", nullable=True),
})
TODO = Edge("Todo", fields={
    "title": Field("utf8", "Title", "Title", nullable=False, min_length=10, max_length=200),
    "description": Field("utf8", "D", "D", nullable=True, min_length=10, max_length=2000),
    "is_complete": Field("bool", "Done", "Done"),
})
TODO_LIST = Edge("TodoList", fields={"title": TODO.fields["title"], "tasks": Many(TODO)})


def faults(df, column="v"):
    return [sorted((v.path, v.rule) for v in r[column]) for r in df.collect()]


def json_faults(spark, edge, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, raw string")
    return faults(df.withColumn("v", json_violations(F.col("raw"), edge)).orderBy("i"))


def test_json_shape(spark):
    got = json_faults(
        spark, PERSON, '{"age": 41, "nickname": null}', '{"nickname": null}', '{"age": "old", "nickname": null}',
        '{"age": null, "nickname": null}', '"nope"', "null", "[]", '{"age": "old", "nickname": 5}', "{oops",
        '{"age": 41.0, "nickname": "x"}', '{"age": 4e1, "nickname": "x"}', '{"age": 1.5, "nickname": "x"}', '{"age": 1}')
    assert got == [
        [], [("age", "missing")], [("age", "type")], [("age", "null")], [("Person", "object")], [("Person", "object")],
        [("Person", "object")], [("age", "type"), ("nickname", "type")], [("Person", "malformed")],
        [], [], [("age", "type")], [("nickname", "missing")]]


def test_json_nested(spark):
    home = Edge("Home", fields={"street": Field("utf8", "S", "S", nullable=False)})
    edge = Edge("P", fields={"home": home, "homes": Many(home)})
    got = json_faults(
        spark, edge, '{"home": {"street": "a"}, "homes": [{"street": "b"}]}', '{"home": {}, "homes": []}',
        '{"home": 5, "homes": [{"street": 1}, {"street": "x"}, 3]}', '{"home": null, "homes": null}')
    assert got == [
        [], [("home.street", "missing")],
        [("home", "type"), ("homes[0].street", "type"), ("homes[2]", "type")], [("home", "null"), ("homes", "null")]]


def test_decode_gives_typed_payload(spark):
    df = decode(spark.createDataFrame([('{"age": 300, "nickname": "N"}',), ('{"age": 7}',)], "raw string"), "raw", PERSON)
    rows = df.select("payload.age", "payload.nickname", F.size("violations").alias("n")).collect()
    assert [tuple(r) for r in rows] == [(300, "N", 0), (7, None, 1)]


@pytest.mark.parametrize("value, rules", [
    (41, []), (None, ["null"]), (300, ["range", "max"]), (-1, ["range", "min"]), (151, ["max"])])
def test_domain_of_numbers(spark, value, rules):
    edge = Edge("P", fields={"age": Field("uint8", "A", "A", nullable=False, min=0, max=150)})
    df = spark.createDataFrame([(value,)], "age bigint")
    assert [r for _, r in faults(df.select(ops.violations(df, edge, "domain").alias("v")))[0]] == sorted(rules)


def test_shape_of_columns(spark):
    df = spark.createDataFrame([("41", 1.0), ("old", 1.5), (None, None)], "age string, n double")
    edge = Edge("P", fields={"age": PERSON.fields["age"], "n": Field("int16", "N", "N", nullable=True)})
    got = faults(df.select(ops.violations(df, edge).alias("v")))
    assert got == [[], [("age", "type"), ("n", "type")], [("age", "null")]]


def test_datetime_text(spark):
    edge = Edge("D", fields={"at": Field("datetime", "At", "At", nullable=False, max_length=20)})
    df = spark.createDataFrame([("2026-09-01T00:00:00Z",), ("soon",), ("2026-09-01T00:00:00.000Z",)], "at string")
    got = faults(df.select(ops.violations(df, edge, "domain").alias("v")))
    assert got == [[], [("at", "type")], [("at", "maxLength")]]
    assert ops.apply_contract(df, edge).schema["at"].dataType.typeName() == "timestamp"


def test_known_bad_todo_is_refused_only_by_its_domain(spark):
    df = spark.createDataFrame([("Buy milk", "Get 2% milk from the store", False)], "title string, description string, is_complete boolean")
    assert faults(df.select(ops.violations(df, TODO, "shape").alias("v"))) == [[]]
    assert faults(df.select(ops.violations(df, TODO, "domain").alias("v"))) == [[("title", "minLength")]]


def test_array_elements_carry_their_index(spark):
    df = spark.createDataFrame(
        [("A long enough title", [("Long enough task", None, True), ("short", "tiny", None), None])],
        "title string, tasks array<struct<title:string,description:string,is_complete:boolean>>")
    got = faults(df.select(ops.violations(df, TODO_LIST, "domain").alias("v")))
    assert got == [[("tasks[1].description", "minLength"), ("tasks[1].is_complete", "null"), ("tasks[1].title", "minLength"),
                    ("tasks[2]", "null")]]
    assert not df.select(ops.is_valid(df, TODO_LIST, "domain").alias("ok")).first().ok


def test_missing_columns(spark):
    df = spark.createDataFrame([(1,)], "nickname int")
    assert faults(df.select(ops.violations(df, PERSON).alias("v"))) == [[("age", "missing"), ("nickname", "type")]]
    with pytest.raises(ContractError, match="age"):
        ops.apply_contract(df, PERSON)
    with pytest.raises(ContractError, match="age"):
        ops.conform(df, PERSON)


def test_conform_splits_without_loss(spark, sf):
    edge = Edge("C", fields={
        "c_acctbal": Field("f64", "B", "B", nullable=False, min=0),
        "c_name": Field("utf8", "N", "N", nullable=True, pattern="[02468]$"),
        "c_nationkey": Field("uint8", "N", "N", nullable=False, max=20),
    })
    df = spark.read.parquet(f"{sf}/customer.parquet").withColumn("c_name", F.when(F.col("c_custkey") % 5 > 0, F.col("c_name")))
    ok, failed = ops.conform(df, edge)
    assert ok.count() + failed.count() == df.count() and ok.count() > 0
    assert failed.filter(F.size("reason") == 0).count() == 0
    both = df.select(ops.is_valid(df, edge, "domain").alias("a"), (F.size(ops.violations(df, edge, "domain")) == 0).alias("b"))
    assert both.filter(~F.col("a").eqNullSafe(F.col("b"))).count() == 0


def test_conform_filter_reaches_the_scan(spark, sf):
    edge = Edge("C", fields={"c_acctbal": Field("f64", "B", "B", nullable=False, min=0)})
    ok = ops.conforming(spark.read.parquet(f"{sf}/customer.parquet"), edge)
    plan = ok._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(c_acctbal,0.0)" in plan and "c_name" not in plan


def test_conform_reads_its_source_once(spark, sf):
    edge = Edge("C", fields={"c_acctbal": Field("f64", "B", "B", nullable=False, min=0)})
    customers = spark.read.parquet(f"{sf}/customer.parquet")
    ok, failed = ops.conform(customers, edge)
    for side in (ok, failed):
        assert not any("customer.parquet" in f for f in side.inputFiles())
    want = ops.conforming(customers, edge)
    assert sorted(map(tuple, ok.collect())) == sorted(map(tuple, want.collect())) and ok.count() + failed.count() == customers.count()


def test_field_dictionary_sketch(spark, sf):
    edge = Edge("E", fields={"value": Field("f64", "V", "V", nullable=False), "event_type": Field("utf8", "T", "T", nullable=False)})
    rows = {r.field: r for r in ops.field_dictionary(spark.read.parquet(f"{sf}/events.parquet"), edge).collect()}
    assert rows["event_type"].distinct == 5 and rows["event_type"].quartiles is None
    assert rows["value"].rows == 1000 and len(rows["value"].quartiles) == 3
