"""The node boundary: every row comes out once, on one side, and nothing aborts."""

import pytest
from pyspark.sql import functions as F

from tracefold.contract import ContractError, Edge, Field
from tracefold.functions.outcomes import settle
from tracefold.functions.safe import raising
from tracefold.operators import failure, privacy
from tracefold.operators.boundary import boundary, checked
from tracefold.operators.nodes import Node
from tracefold.sources.log import IDENTITY

IN = Edge("In", "In", "Input", {"a": Field("int32", "A", "A", nullable=False, min=-10), "b": Field("int32", "B", "B", nullable=True)})
OUT = Edge("Out", "Out", "Output", {"q": Field("f64", "Q", "Q", nullable=False, max=5)})


@pytest.fixture
def log(spark):
    rows = [(str(i), "c", None, 0, "n", "1", ("u", "l", scopes), "h", edge, (a, b)) for i, (a, b, scopes, edge) in enumerate([
        (4, 2, ["s"], "In"), (4, 0, ["s"], "In"), (4, None, ["s"], "In"), (None, 2, ["s"], "In"), (-11, 1, ["s"], "In"), (100, 2, ["s"], "In"),
        (4, 2, [], "In"), (4, 2, None, "In"), (9, 9, ["s"], "Else")])]
    ddl = f"id string, correlation_id string, causation_id string, step int, node string, impl_version string, identity {IDENTITY}, schema_hash string, edge string, payload struct<a:int,b:int>"
    return spark.createDataFrame(rows, ddl).withColumn("ts", F.lit("2024-01-01").cast("timestamp"))


def divide(p):
    return {"q": p["a"] / p["b"]}


def test_each_stage_stops_its_rows(log):
    ok, failed = boundary(Node("d", IN, OUT, divide), log, scope="s")
    assert [(r.causation_id, r.edge, r.payload.q) for r in ok.collect()] == [("0", "Out", 2.0)]
    got = {r.causation_id: (r.payload.stage, r.payload.reason) for r in failed.collect()}
    assert got == {"1": ("body", "no value for q"), "2": ("body", "no value for q"), "3": ("input", "a null"), "4": ("input", "a min (-11)"),
                   "5": ("output", "q max (50.0)"), "6": ("scope", "missing scope s"), "7": ("scope", "missing scope s")}
    assert {r.edge for r in failed.collect()} == {"Failed<In>"} and failed.filter("step <> 1").count() == 0


def test_sides_read_a_table_and_not_the_source_again(log):
    ok, failed = boundary(Node("d", IN, OUT, divide), log)
    for side in (ok, failed):
        plan = side._jdf.queryExecution().optimizedPlan().toString()
        assert "boundary" in side.inputFiles()[0] and plan.count("Relation") == 1 and "LocalRelation" not in plan


def test_guard_catches_what_a_body_raises(spark, log):
    one = log.filter("id in ('0', '1')")
    bodies = {"division": divide, "remainder": lambda p: {"q": p["a"] % p["b"]}, "overflow": lambda p: {"q": p["a"] * 2_000_000_000 / (p["b"] - 2)},
              "cast": lambda p: {"q": F.concat(p["a"].cast("string"), F.lit("x")).try_cast("int")}, "negation": lambda p: {"q": 1 / -p["b"]}}
    for name, body in bodies.items():
        ok, failed = failure.guard(Node(name, IN, OUT, body), one)
        assert ok.count() + failed.count() == 2 and failed.count() >= 1


@pytest.mark.parametrize("body", [lambda p: {"q": F.abs(p["a"]) / F.abs(p["b"])}, lambda p: {"q": F.lit("x").cast("int")},
                                  lambda p: {"q": F.element_at(F.array(p["a"]), 3)}, lambda p: {"q": F.raise_error(F.lit("no"))}])
def test_bodies_that_could_abort_are_refused_before_they_run(log, body):
    with pytest.raises(ContractError):
        checked(Node("bad", IN, OUT, body), log)


def test_harmless_expressions_pass(spark):
    df = spark.range(1).select((F.col("id").cast("int") if False else F.col("id").cast("double") + 1).alias("x"))
    assert raising(df) == [] and raising(df.select((F.col("x") / 2).alias("y")))


def test_settle_puts_null_verdicts_with_the_failed(spark):
    df = spark.createDataFrame([(1, True), (2, False), (3, None)], "i int, good boolean")
    ok, failed = settle(df, F.col("good"), F.struct("i"), F.struct("i", F.lit("no").alias("why")))
    assert [r.i for r in ok.collect()] == [1] and sorted(map(tuple, failed.collect())) == [(2, "no"), (3, "no")]
    none = settle(df.limit(0), F.col("good"), F.struct("i"), F.struct("i"))
    assert [side.count() for side in none] == [0, 0]


def test_refusals_are_failed_rows(log):
    ok, refused = privacy.scope_gate(log, "s")
    assert ok.columns == log.columns and ok.count() == 7
    assert sorted((r.causation_id, r.edge, r.payload.reason, r.payload.input.a) for r in refused.collect()) == [
        ("6", "Failed<In>", "missing scope s", 4), ("7", "Failed<In>", "missing scope s", 4)]


def test_retry_answers_failures_and_stops_when_none_is_left(log):
    failed = failure.failed_rows(log.filter("id in ('0', '5')"), IN, F.lit("first"), "limit")
    node = Node("again", IN, OUT, lambda p, attempt: {"q": F.when(p["a"] <= 4 * attempt, p["a"] / 1)})
    worked, attempts, dead = failure.retry(failed, node, 3)
    assert [(r.attempts, r.payload.q) for r in worked.collect()] == [(1, 4.0)]
    assert attempts.count() == 4 and dead.count() == 1
    chain, causes = dead.first(), {r.id: r.causation_id for r in attempts.collect()}
    for _ in range(3):
        chain_id = causes[chain.id] if not isinstance(chain, str) else causes[chain]
        chain = chain_id
    assert chain in {r.id for r in failed.collect()}
    worked, attempts, dead = failure.retry(failed.filter("payload.input.a = 4"), node, 3)
    assert worked.count() == 1 and attempts.count() == 1 and dead.count() == 0
    worked, attempts, dead = failure.retry(failed, node, 0)
    assert (worked.count(), attempts.count(), dead.count()) == (0, 0, 2)
