"""Log files, replay, failures and privacy as properties over the tables."""

import tempfile

import pytest
from pyspark.sql import functions as F

from tracefold.contract import Edge, Field
from tracefold.operators import failure, privacy, replay, state, verify
from tracefold.operators.conform import is_valid
from tracefold.operators.nodes import Node, apply, check_output
from tracefold.plans import fixtures
from tracefold.sources import log as src


@pytest.fixture(scope="module")
def log(spark, sf):
    return fixtures.event_log(spark, sf)


def same(a, b):
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_append_only_log_prunes_by_edge(spark, log):
    path = tempfile.mkdtemp(prefix="spark-") + "/log"
    half = F.col("id") % 2 == 0
    src.append_log(log.filter(half), path)
    src.append_log(log.filter(~half), path)
    assert same(src.read_log(spark, path).select("id", "edge", "step"), log.select("id", "edge", "step"))
    some = src.read_log(spark, path, edges=["view"], correlations=[101, 203])
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(edge" in plan and "In(correlation_id, [101,203])" in plan
    assert same(some.select("id"), log.filter("edge = 'view' and correlation_id in (101, 203)").select("id"))


def test_unified_view_gives_payloads_back(spark, sf, log):
    whole = src.unified([log.drop("user_id"), fixtures.placed(spark, sf)])
    back = src.typed_view(whole, fixtures.PLACED).select("payload.order", "payload.price")
    assert same(back, fixtures.placed(spark, sf).select("payload.order", "payload.price"))


def test_unchanged_node_replays_to_itself(spark, sf):
    node = Node("birthday", fixtures.SIZED, fixtures.SIZED, lambda p: {"size": p["size"] + 1})
    inputs = fixtures.sized(spark, sf)
    whole = inputs.unionByName(check_output(apply(node, inputs), fixtures.SIZED)[0])
    assert {r.status for r in replay.replay_diff(whole, node).select("status").distinct().collect()} == {"same"}


def test_causes_and_effects_meet(log):
    up = replay.ancestors(log, log.filter("edge = 'purchase'"))
    down = replay.descendants(log, log)
    purchases = log.filter("edge = 'purchase'").select("id")
    assert same(up.select("seed", "id", "depth"),
                down.join(purchases, "id").select(F.col("id").alias("seed"), F.col("seed").alias("id"), "depth"))


def test_redaction_round_trip_and_erasure(spark, sf):
    table = spark.read.parquet(f"{sf}/customer.parquet").select("c_custkey", "c_name", "c_mktsegment")
    hidden, names = privacy.redact(table, ["c_name", "c_mktsegment"], "salt")
    assert hidden.filter(~F.col("c_name").rlike(privacy.TOKEN_PATTERN)).count() == 0
    assert same(privacy.rehydrate(hidden, names, ["c_name", "c_mktsegment"]), table)
    other, _ = privacy.redact(table, ["c_name"], "another salt")
    assert hidden.join(other, "c_name").count() == 0
    gone = table.filter("c_custkey < 3").select(F.col("c_name").alias("value"))
    after = privacy.rehydrate(hidden, privacy.erase_subject(names, gone), ["c_name", "c_mktsegment"])
    assert after.filter("c_name is null").count() == 3 and after.count() == table.count()


def test_erasing_one_subject_leaves_equal_values_of_others(spark):
    df = spark.createDataFrame([(1, "Ann", "Rome", 7), (2, "Bob", "Ann", 7)], "who int, name string, city string, n int")
    hidden, names = privacy.redact(df, ["name", "city", "n"], "s", {"name": "text", "city": "text"}, subject="who")
    spaces, types = {"name": "text", "city": "text"}, {"n": "int"}
    whole = privacy.rehydrate(hidden, names, ["name", "city", "n"], spaces, types, "who")
    assert whole.schema["n"].dataType == df.schema["n"].dataType and same(whole, df)
    kept = privacy.erase_subject(names, spark.createDataFrame([(1,)], "subject int"), "subject")
    got = {tuple(r) for r in privacy.rehydrate(hidden, kept, ["name", "city", "n"], spaces, types, "who").collect()}
    assert got == {(1, None, None, None), (2, "Bob", "Ann", 7)}


def test_null_values_stay_null(spark):
    df = spark.createDataFrame([(1, None), (2, "a")], "i int, v string")
    hidden, names = privacy.redact(df, ["v"], "s")
    assert names.count() == 1 and same(privacy.rehydrate(hidden, names, ["v"]), df)


def test_scopes(spark):
    df = spark.createDataFrame([(1, ["a", "b"])], "i int, s array<string>").withColumn("identity", src.identity("x", scopes=F.col("s")))
    assert privacy.scope_narrow(df, ["read:Identity:sub"], {"Identity": "identity"}).columns == ["sub"]


def test_retry_then_dead_letter(log):
    tried = failure.retry_inline(log, lambda k, p: (p["value"] <= 100 * k, p["value"]), 2)
    dead = failure.dead_letter(tried)
    assert dead.count() == log.filter("payload.value > 200").count()
    assert tried.filter("succeeded").count() + dead.count() == log.count()


def test_refresh_equals_rebuild(log):
    def view(rows):
        return rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("last"))
    day = F.dayofmonth("ts")
    merged = state.refresh(view(log.filter(day <= 10)), view(log.filter(day > 10)), ["user_id"], {"n": "sum", "last": "max"})
    assert same(merged, view(log).select(*merged.columns))


def test_generated_rows_meet_their_contract(spark):
    edge = Edge("G", fields={
        "a": Field("uint8", "A", "A", nullable=False, min=3, max=9), "b": Field("int32", "B", "B", nullable=True),
        "c": Field("utf8", "C", "C", nullable=False, min_length=2, max_length=5), "d": Field("bool", "D", "D"),
        "e": Field("utf8", "E", "E", nullable=False, pattern="^x[0-9]$"), "f": Field("datetime", "F", "F", nullable=False),
        "g": Field("f32", "G", "G", nullable=False, min=-1, max=1), "h": Field("utf8", "H", "H", nullable=False, enum=("p", "q")),
        "i": Edge("I", fields={"j": Field("uint32", "J", "J", nullable=False)}),
    })
    rows = verify.generate(spark, edge, 500, seed=3, templates={"e": ["x1", "x2"]}, edges=True)
    assert rows.filter(~F.coalesce(is_valid(rows, edge, "domain"), F.lit(False))).count() == 0
    assert rows.select("a").distinct().count() == 7 and rows.filter("b is null").count() > 10
    again = verify.generate(spark, edge, 500, seed=3, templates={"e": ["x1", "x2"]}, edges=True)
    assert same(rows, again)
    other = verify.generate(spark, edge, 500, seed=4, templates={"e": ["x1", "x2"]})
    assert rows.select("b").distinct().intersect(other.select("b").distinct()).count() < 5
    with pytest.raises(ValueError):
        verify.generate(spark, edge, 1)


def test_ids_of_null_keys_and_separators(spark):
    from tracefold.functions.columns import joined, row_digest
    from tracefold.sources.log import origin

    rows = spark.createDataFrame([(None, 1), (None, 2), (None, None), ("N", 1), ("|", 1), ("\\N", 1)], "key string, k int")
    edge = Edge("Keyed", "Keyed", "A keyed row", {"k": Field("int32", "K", "Number", nullable=True)})
    log = origin(rows, edge, F.col("key"), F.col("key"), F.lit(None).cast("timestamp"))
    assert log.select("id").distinct().count() == 6
    parts = spark.createDataFrame([("a|b", "c"), ("a", "b|c"), (None, "x"), ("x", None), ("\\", "|"), ("\\|", "")], "a string, b string")
    assert parts.select(joined([F.col("a"), F.col("b")])).distinct().count() == 6
    assert rows.select(row_digest(rows.columns)).distinct().count() == 6


def test_routes_that_print_alike_differ_in_their_digest(spark):
    from tracefold.operators.lineage import routes

    rows = [(run, step, edge) for run, path in ((1, "abc"), (2, "abd"), (3, "abc")) for step, edge in enumerate(path)]
    log = spark.createDataFrame(rows, "correlation_id long, step int, edge string")
    found = routes(log, max_depth=2).collect()
    assert sorted((r.route, r.runs) for r in found) == [("a>b>…", 1), ("a>b>…", 2)] and len({r.digest for r in found}) == 2
