"""Nodes, output modes and readiness on small logs."""

import pytest
from pyspark.sql import functions as F

from tracefold.contract import ContractError, Edge, Field, Many
from tracefold.operators import fanin, nodes as ops, verify
from tracefold.operators.conform import conform
from tracefold.operators.failure import guard
from tracefold.sources import log as src

PERSON = Edge("Person", fields={"age": Field("uint8", "Age", "Age", nullable=False)})
BIRTHDAY = ops.Node("birthday", PERSON, PERSON, lambda p: {"age": p["age"] + 1})


def people(spark, *ages):
    rows = src.literal(spark, PERSON, [{"age": a} for a in ages]).withColumn("k", F.col("age").cast("bigint"))
    return src.origin(rows, PERSON, F.col("k"), F.col("k"), F.lit("2024-01-01").cast("timestamp"))


def test_birthday_and_its_trace(spark):
    start = people(spark, 41)
    first = start.first()
    out = ops.apply(BIRTHDAY, start).first()
    assert out.payload.age == 42 and out.step == 1 and out.edge == "Person"
    assert out.causation_id == first.id and out.correlation_id == first.correlation_id and first.causation_id is None
    assert out.schema_hash == PERSON.schema_hash and out.identity == first.identity
    assert ops.apply(BIRTHDAY, start).first().id == out.id  # ids are reproducible


@pytest.mark.parametrize("age, verdict", [(42, "Pass"), (41, "Fail")])
def test_expect(spark, age, verdict):
    assert verify.expect(people(spark, age), {"age": 42}, column="payload").first().verdict == verdict


def test_expect_full_needs_all_fields(spark):
    df = spark.createDataFrame([(1, None)], "a int, b string")
    assert verify.expect(df, {"a": 1, "b": None}, "full").first().verdict == "Pass"
    with pytest.raises(ValueError):
        verify.expect(df, {"a": 1}, "full")


def test_origin_of_a_literal(spark):
    assert src.literal(spark, PERSON, [{"age": 41}]).first().age == 41


def test_all_of_fires_every_branch(spark):
    placed = people(spark, 1, 2)
    out = ops.all_of(placed, {Edge("InvoiceRequested"): lambda p: {}, Edge("InventoryReserved"): lambda p: {}}, "place_order")
    rows = out.collect()
    assert len(rows) == 4 and "payload" not in out.columns
    by_cause = {}
    for r in rows:
        by_cause.setdefault(r.causation_id, set()).add(r.edge)
    assert all(v == {"InvoiceRequested", "InventoryReserved"} for v in by_cause.values())
    assert len({r.id for r in rows}) == 4


def test_many(spark):
    pair = lambda p: F.array(F.struct((p["age"] - 2).alias("age")), F.struct((p["age"] + 2).alias("age")))
    rows = ops.many(people(spark, 10), pair, "siblings", PERSON).orderBy("ordinal").collect()
    assert [r.payload.age for r in rows] == [8, 12] and rows[0].id != rows[1].id
    none = ops.many(people(spark, 10), lambda p: F.slice(pair(p), 1, 0), "siblings", PERSON)
    assert none.count() == 0


def test_one_of_chooses_or_fails(spark):
    tag = F.when(F.col("payload.age") < 18, "Child").when(F.col("payload.age") < 70, "Adult").when(F.col("payload.age") > 100, "Old")
    chosen, failed = ops.one_of(people(spark, 5, 30, 80, 120), tag, ["Child", "Adult"], "grade", PERSON)
    assert {r.payload.age: r.edge for r in chosen.collect()} == {5: "Child", 30: "Adult"}
    assert {r.payload.input.age: r.payload.reason for r in failed.collect()} == {
        80: "undeclared branch null", 120: "undeclared branch Old"}
    assert ops.branch(chosen, "Child").first().schema_hash == PERSON.spread("Child").schema_hash


def nested(spark, df, edge):
    return src.origin(df, edge, F.lit("c"), F.lit("k"), F.lit("2024-01-01").cast("timestamp"))


def test_nested_compound(spark):
    address = Edge("Address", fields={"street": Field("utf8", "S", "S", nullable=False)})
    edge = Edge("PersonWithAddress", fields={"name": Field("utf8", "N", "N", nullable=False), "address": address})
    df = spark.createDataFrame([("Ada", ("1 Infinite Loop",))], "name string, address struct<street:string>")
    greet = ops.Node("greet", edge, edge, lambda p: {
        "name": F.concat(p["name"], F.lit(" of "), p["address"]["street"]), "address": p["address"]})
    out = ops.apply(greet, nested(spark, df, edge)).first().payload
    assert out.name == "Ada of 1 Infinite Loop" and out.address.street == "1 Infinite Loop"


def test_many_field(spark):
    task = Edge("Task", fields={"title": Field("utf8", "T", "T", nullable=False)})
    edge = Edge("TaskList", fields={"title": task.fields["title"], "tasks": Many(task)})
    df = spark.createDataFrame([("Groceries", [("Milk",), ("Eggs",)])], "title string, tasks array<struct<title:string>>")
    summarize = ops.Node("summarize", edge, edge, lambda p: {
        "title": F.concat(p["title"], F.lit(" ("), F.size(p["tasks"]).cast("string"), F.lit(" tasks)")), "tasks": p["tasks"]})
    out = ops.apply(summarize, nested(spark, df, edge)).first().payload
    assert out.title == "Groceries (2 tasks)" and [t.title for t in out.tasks] == ["Milk", "Eggs"]


def test_nullable_field(spark):
    edge = Edge("T", fields={"title": Field("utf8", "T", "T", nullable=False), "due_at": Field("utf8", "D", "D", nullable=True)})
    describe = ops.Node("describe_due_date", edge, edge, lambda p: {
        "title": F.concat(p["title"], F.when(p["due_at"].isNull(), " (no due date)").otherwise(
            F.concat(F.lit(" (due "), p["due_at"], F.lit(")")))), "due_at": p["due_at"]})
    df = spark.createDataFrame([("Ship it", None), ("Ship it", "2026-09-01T00:00:00Z")], "title string, due_at string")
    titles = {r.payload.title for r in ops.apply(describe, nested(spark, df, edge)).collect()}
    assert titles == {"Ship it (no due date)", "Ship it (due 2026-09-01T00:00:00Z)"}


def test_compose_and_pipe_agree(spark):
    start = people(spark, 1, 20)
    piped = ops.pipe(start, BIRTHDAY, BIRTHDAY, BIRTHDAY, opaque=True)
    composed = ops.apply(ops.compose("thrice", BIRTHDAY, BIRTHDAY, BIRTHDAY), start)
    assert sorted(r.payload.age for r in piped.collect()) == sorted(r.payload.age for r in composed.collect()) == [4, 23]
    logged = ops.repeat(BIRTHDAY, start, 3)
    assert sorted((r.step, r.payload.age) for r in logged.collect()) == [(1, 2), (1, 21), (2, 3), (2, 22), (3, 4), (3, 23)]


def test_wires_fit_by_shape(spark):
    dog = Edge("Dog", fields={"age": PERSON.fields["age"], "name": Field("utf8", "N", "N", nullable=False)})
    cat = Edge("Cat", fields={"weight": Field("f64", "W", "W", nullable=False)})
    assert PERSON.accepts(dog) and not dog.accepts(PERSON) and not PERSON.accepts(cat)
    to_dog = ops.Node("to_dog", PERSON, dog, lambda p: {"age": p["age"], "name": F.lit("Rex")})
    to_cat = ops.Node("to_cat", PERSON, cat, lambda p: {"weight": F.lit(4.0)})
    assert ops.pipe(people(spark, 3), to_dog, BIRTHDAY, opaque=True).first().payload.age == 4
    with pytest.raises(ContractError, match="to_cat"):
        ops.pipe(people(spark, 3), to_cat, BIRTHDAY)


def test_readme_example(spark):
    person = Edge("Person", "Person", "Someone", {
        "age": Field("uint8", "Age", "Age in years", nullable=False, min=0, max=150)})
    grow = ops.Node("birthday", person, person, lambda p: {"age": p["age"] + 1})
    table = spark.createDataFrame([(1, 41), (2, 151)], "key bigint, age bigint").withColumn("ts", F.current_timestamp())
    ok, failed = conform(table, person, keep=["key", "ts"])
    log = src.origin(ok, person, F.col("key"), F.col("key"), F.col("ts"))
    assert [r.payload.age for r in ops.apply(grow, log).collect()] == [42] and failed.first().input.age == 151


def test_output_contract(spark):
    ok, failed = ops.check_output(ops.apply(BIRTHDAY, people(spark, 254, 255)), PERSON)
    assert [r.payload.age for r in ok.collect()] == [255]
    bad = failed.first().payload
    assert bad.input.age == 256 and [(v.path, v.rule) for v in bad.reason] == [("age", "range")]


def test_guard_catches(spark):
    edge = Edge("Ratio", fields={"r": Field("f64", "R", "R", nullable=False)})
    node = ops.Node("ratio", PERSON, edge, lambda p: {"r": F.try_divide(F.lit(10), p["age"])})
    ok, failed = guard(node, people(spark, 0, 5))
    assert ok.first().payload.r == 2.0 and failed.first().edge == "Failed<Person>"


def test_python_node_isolates_bad_rows(spark):
    def halve(rows):
        if (rows["age"] % 2 == 1).any():
            raise ValueError("odd")
        return rows.assign(half=rows["age"] // 2)[["half"]]
    df = spark.createDataFrame([(a,) for a in range(7)], "age bigint").repartition(2)
    rows = {r.age: (r.half, r.reason) for r in ops.python_node(df, halve, "half bigint", ["age"], ["age"]).collect()}
    assert rows == {a: ((a // 2, None) if a % 2 == 0 else (None, "ValueError: odd")) for a in range(7)}


def test_collect_gives_one_row_a_parent(spark):
    children = spark.range(90).select(F.when(F.col("id") < 40, "big").when(F.col("id") < 50, "small").when(F.col("id") < 60, "stranger").alias("cp"),
                                      F.col("id").alias("o"))  # the last 30 have no key
    parents = spark.createDataFrame([("big",), ("small",), ("none",), (None,)], "p string")
    rows = ops.collect_many(parents, "p", children, "cp", ["o"], F.col("o"), "items").collect()
    assert {r.p: list(r["items"]) for r in rows} == {"big": list(range(40)), "small": list(range(40, 50)), "none": [], None: []}
    sums = ops.reduce_many(parents, "p", children, "cp", n=F.count(F.lit(1)), last=F.max("o")).collect()
    assert {r.p: (r.n, r["last"]) for r in sums} == {"big": (40, 39), "small": (10, 49), "none": (None, None), None: (None, None)}


def test_append_to_many(spark):
    lists = spark.createDataFrame([("l", ["a"]), ("m", [])], "k string, items array<string>")
    late = spark.createDataFrame([("l", 2, "c"), ("l", 1, "b")], "ck string, n int, v string")
    rows = ops.append_to_many(lists, "k", "items", late, "ck", ["n"], F.col("v")).collect()
    assert {r.k: list(r["items"]) for r in rows} == {"l": ["a", "b", "c"], "m": []}


# -- readiness --------------------------------------------------------------

WORD = Edge("Word", fields={"value": Field("utf8", "V", "V", nullable=False)})


def words(spark, *rows):
    """rows: (edge, correlation, value) in order of arrival."""
    data = [(f"{i:03d}", c, i, e, (v,), None) for i, (e, c, v) in enumerate(rows)]
    return spark.createDataFrame(
        data, "id string, correlation_id string, step int, edge string, payload struct<value:string>, ts timestamp"
    ).withColumn("identity", src.identity())


def joined(log):
    out = fanin.apply_every(log, ["A", "B"], "C", WORD.spread("C"), lambda bag: {
        "value": F.concat(bag["A"]["value"], F.lit("+"), bag["B"]["value"])})
    return {r.correlation_id: r.payload.value for r in out.collect()}


def test_every_waits_for_all(spark):
    assert joined(words(spark, ("A", "t1", "a"))) == {}
    assert joined(words(spark, ("X", "t1", "a"))) == {}


def test_every_fires_in_any_order_and_again(spark):
    log = words(spark, ("A", "t1", "a"), ("B", "t1", "b"))
    assert joined(log) == {"t1": "a+b"} == joined(log)
    assert joined(words(spark, ("B", "t1", "b"), ("A", "t1", "a"))) == {"t1": "a+b"}


def test_every_keeps_correlations_apart(spark):
    assert joined(words(spark, ("A", "t1", "a"), ("A", "t2", "a2"), ("B", "t2", "b2"))) == {"t2": "a2+b2"}


def test_every_checks_its_inputs(spark):
    tight = Edge("Tight", fields={"value": Field("utf8", "V", "V", nullable=False, max_length=1)})
    log = words(spark, ("A", "t1", None), ("B", "t1", "b"), ("A", "t2", "a"), ("B", "t2", "long"), ("A", "t3", "a"), ("B", "t3", "b"))
    ok, failed = fanin.every_checked(log, {"A": tight, "B": tight}, "domain")
    assert [r.correlation_id for r in ok.collect()] == ["t3"]
    assert {r.correlation_id: [(v.path, v.rule) for v in r.payload.reason] for r in failed.collect()} == {
        "t1": [("A.value", "null")], "t2": [("B.value", "maxLength")]}


def test_latest_and_fire_readings_differ(spark):
    log = words(spark, ("A", "t", "a1"), ("A", "t", "a2"), ("B", "t", "b1"), ("A", "t", "a3"), ("B", "t", "b2"))
    late, fire = fanin.every(log, ["A", "B"]).first(), fanin.every(log, ["A", "B"], at="fire").first()
    assert (late.A.payload.value, late.B.payload.value, late.step) == ("a3", "b2", 4)
    assert (fire.A.payload.value, fire.B.payload.value, fire.step) == ("a2", "b1", 2)
    assert list(fire.parents) == ["001", "002"] and fire.causation_id == "002"


def test_diamond_pulses(spark):
    ids = spark.createDataFrame([(x,) for x in "ABCDEF"], "id string")
    deps = spark.createDataFrame([("B", "A"), ("C", "A"), ("C", "B"), ("D", "C"), ("E", "D"), ("E", "A")], "id string, parent string")
    assert {r.id: r.pulse for r in fanin.pulse(ids, deps).collect()} == {"A": 1, "B": 2, "C": 3, "D": 4, "E": 5, "F": 1}


def test_pulse_refuses_cycles(spark):
    deps = spark.createDataFrame([("A", "B"), ("B", "A"), ("A", "C"), ("B", "C")], "id string, parent string")
    with pytest.raises(ValueError):
        fanin.pulse(spark.createDataFrame([("A",), ("B",), ("C",)], "id string"), deps)


def test_pulse_of_unknown_parents_is_null(spark):
    ids = spark.createDataFrame([(x,) for x in "ABCDE"], "id string")
    deps = spark.createDataFrame([("A", "X"), ("B", "A"), ("C", "B"), ("C", "D"), ("E", "D"), ("D", None)], "id string, parent string")
    assert {r.id: r.pulse for r in fanin.pulse(ids, deps).collect()} == {"A": None, "B": None, "C": None, "D": 1, "E": 2}
