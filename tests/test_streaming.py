"""Streams fed in several batches must agree with their batch forms."""

import tempfile
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tracefold.contract import Edge, Field
from tracefold.operators import fanin, state
from tracefold.plans import fixtures
from tracefold.session import materialize
from tracefold.streaming import operators as ops
from tracefold.streaming.tables import CurrentTable


def fresh():
    return tempfile.mkdtemp(prefix="spark-")


@pytest.fixture
def parts(spark, sf):
    """The event log in four files, in order of time."""
    path = fresh() + "/log"
    log = fixtures.event_log(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    for i in range(4):
        (log.filter(F.floor((F.col("id")) / 250) == i).coalesce(1).write.mode("append").parquet(path))
    return path, materialize(spark.read.parquet(path), "log")


def stream(spark, parts):
    return ops.stream_log(spark, parts[0], parts[1].schema, files_per_batch=1)


def test_every_fires_once_across_batches(spark, parts):
    out, checkpoint = fresh(), fresh()
    edges = ["signup", "purchase"]
    ops.stream_every(stream(spark, parts), edges, out, checkpoint).awaitTermination()
    ops.heartbeat(spark, parts[0], parts[1].schema, parts[1].agg(F.max("ts") + F.expr("INTERVAL 2 HOURS")).first()[0])
    ops.stream_every(stream(spark, parts), edges, out, checkpoint).awaitTermination()
    got = spark.read.schema(ops.every_schema(edges, "bigint")).parquet(out)
    batch = fanin.every(parts[1], edges, at="fire").select(
        "correlation_id", "step", F.col("signup.id").alias("a"), F.col("purchase.id").alias("b"))
    want = sorted(map(tuple, batch.collect()))
    assert want and sorted((r.correlation_id, r.step, int(r.id_0), int(r.id_1)) for r in got.collect()) == want
    ops.stream_every(stream(spark, parts), edges, out, checkpoint).awaitTermination()  # nothing new, nothing twice
    assert spark.read.schema(ops.every_schema(edges, "bigint")).parquet(out).count() == len(want)


def test_fold_and_view_stay_current(spark, parts):
    out, view = fresh(), fresh()
    ops.stream_fold(stream(spark, parts), ["correlation_id"], {"k": F.sum("payload.k")}, out, fresh(), compact_after=3).awaitTermination()
    table = CurrentTable(spark, out, ["correlation_id"])
    assert table.batch() >= 3
    want = state.fold(parts[1], k=F.sum("payload.k"))
    assert sorted(map(tuple, table.read().collect())) == sorted(map(tuple, want.collect()))

    rows = stream(spark, parts).select("user_id", "id", "edge")
    ops.stream_view(rows, ["user_id"], ["id"], view, fresh()).awaitTermination()
    got = CurrentTable(spark, view, ["user_id"], ["id"]).read()
    want = state.current_state(parts[1].select("user_id", "id", "edge"), ["user_id"], ["id"])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_conform_and_append(spark, parts):
    out, log = fresh(), fresh()
    edge = Edge("E", fields={"id": Field("uint32", "I", "I", nullable=False, max=600)})
    ops.stream_conform(stream(spark, parts), edge, out, fresh()).awaitTermination()
    ok, failed = ops.conformed(spark, out)
    assert ok.count() == 601 and failed.count() == 399
    ops.stream_append(stream(spark, parts), log, fresh()).awaitTermination()
    assert spark.read.schema(parts[1].schema).parquet(log).count() == 1000


def test_effects_left_join_reports_the_unanswered(spark, parts):
    out = fresh()
    ops.stream_effects(stream(spark, parts), F.col("edge") == "view", F.col("edge") == "purchase", "12 HOURS", "1 hour",
                       out, fresh()).awaitTermination()
    schema = "request_id bigint, request_ts timestamp, result_id bigint, result_ts timestamp"
    rows = spark.read.schema(schema).parquet(out).collect()
    batch = parts[1]
    answered = batch.filter("edge = 'purchase'").select(F.col("causation_id").alias("id"), F.col("id").alias("r"),
                                                        F.col("ts").alias("rts"))
    pairs = batch.filter("edge = 'view'").join(answered, "id", "left").select("id", "ts", "r", "rts").collect()
    near = {(p.id, p.r) for p in pairs if p.r is not None and (p.rts - p.ts).total_seconds() <= 12 * 3600}
    assert {(r.request_id, r.result_id) for r in rows if r.result_id is not None} == near
    silent = {r.request_id for r in rows if r.result_id is None}
    never = {p.id for p in pairs} - {a for a, _ in near}
    last = batch.agg(F.max("ts")).first()[0]
    sure = {p.id for p in pairs if p.id in never and (last - p.ts).total_seconds() > 24 * 3600}
    assert silent <= never and sure <= silent and sure


def test_timeouts_fire_across_batches(spark, parts):
    out = fresh()
    edges, within = ["signup", "purchase"], 6 * 3600
    ops.timeout_race(stream(spark, parts), edges, within * 1000, out, fresh(), "1 hour").awaitTermination()
    got = {r.correlation_id: r.outcome for r in spark.read.schema("correlation_id bigint, outcome string").parquet(out).collect()}
    firsts = parts[1].filter(F.col("edge").isin(*edges)).groupBy("correlation_id").agg(
        *[F.min(F.when(F.col("edge") == e, F.col("ts"))).alias(e) for e in edges]).collect()
    last = parts[1].filter(F.col("edge").isin(*edges)).agg(F.max("ts")).first()[0]
    for r in firsts:
        times = [r[e] for e in edges if r[e] is not None]
        ready = len(times) == 2 and (max(times) - min(times)).total_seconds() <= within
        over = (last - min(times)).total_seconds() > within + 2 * 3600
        if ready:
            assert got[r.correlation_id] == "Ready"
        elif over:
            assert got[r.correlation_id] == "TimedOut"
    assert set(got.values()) == {"Ready", "TimedOut"}


def test_redelivered_rows_are_dropped(spark, parts):
    source, out = fresh() + "/s", fresh()
    rows = parts[1].select("id", "ts")
    rows.filter("id < 500").coalesce(1).write.mode("append").parquet(source)
    rows.filter("id >= 480").coalesce(1).write.mode("append").parquet(source)
    ops.stream_dedupe(ops.stream_log(spark, source, rows.schema, files_per_batch=1), out, fresh(), "3 days").awaitTermination()
    assert spark.read.schema(rows.schema).parquet(out).count() == 1000


def rows_of(spark, rows):
    return spark.createDataFrame(rows, "id long, correlation_id long, step int, edge string, ts timestamp, payload struct<k:int>")


def at(hour):
    return datetime(2024, 1, 1) + timedelta(hours=hour)


def run_every(spark, batches, edges, delay="10 days", lifetime_ms=None):
    """The firings after each batch, and the rows of state left at the end."""
    path, out, checkpoint, seen = fresh() + "/log", fresh() + "/out", fresh(), []
    for rows in batches:
        rows_of(spark, rows).coalesce(1).write.mode("append").parquet(path)
        schema = spark.read.parquet(path).schema
        query = ops.stream_every(ops.stream_log(spark, path, schema), edges, out, checkpoint, delay, lifetime_ms)
        query.awaitTermination()
        seen.append(sorted((r.correlation_id, r.step, *[int(r[f"id_{i}"]) for i in range(len(edges))])
                           for r in spark.read.schema(ops.every_schema(edges, "bigint")).parquet(out).collect()))
    return seen, query.lastProgress["stateOperators"][0]["numRowsTotal"]


def beat(hour):
    return (0, None, None, "heartbeat", at(hour), None)


def test_every_waits_for_earlier_rows_that_come_late(spark):
    a, b, c = (10, 1, 0, "a", at(0), (1,)), (11, 1, 1, "b", at(1), (1,)), (12, 1, 2, "a", at(2), (1,))
    d = (13, 1, 3, "b", at(3), (1,))
    # by arrival alone (c, d) would fire; the earliest firing is (a, b)
    seen, left = run_every(spark, [[d], [c], [b], [a], [beat(24 * 20)]], ["a", "b"], lifetime_ms=3_600_000 * 24)
    assert seen == [[], [], [], [], [(1, 1, 10, 11)]] and left == 0


def test_every_takes_the_last_row_before_the_firing(spark):
    rows = [(i, 1, i, "a", at(i), (i,)) for i in range(5)] + [(9, 1, 5, "b", at(5), (1,)), (10, 1, 6, "a", at(6), (1,))]
    seen, _ = run_every(spark, [rows[4:], rows[:2], rows[2:4], [beat(24 * 30)]], ["a", "b"])
    assert seen[-1] == [(1, 5, 4, 9)]
    # rows behind the watermark are thinned to the last one before the other edge comes
    seen, _ = run_every(spark, [rows[:5], [beat(100)], [(9, 1, 5, "b", at(101), (1,))], [beat(200)]], ["a", "b"], delay="1 hour")
    assert seen[-1] == [(1, 5, 4, 9)]


def test_correlations_that_never_complete_leave(spark):
    rows = [(i, i, 0, "a", at(i), (1,)) for i in range(6)]
    seen, left = run_every(spark, [rows[:3], rows[3:], [beat(24 * 40)], [beat(24 * 41)]], ["a", "b"], lifetime_ms=3_600_000)
    assert seen[-1] == [] and left == 0
    # without a lifetime they stay
    assert run_every(spark, [rows, [beat(24 * 40)]], ["a", "b"])[1] > 0


def test_three_edges_in_any_batch_order(spark):
    log = [(c * 10 + s, c, s, e, at(c + s), (1,)) for c in range(4) for s, e in enumerate(["x", "y", "x", "z", "y"])]
    want = sorted(map(tuple, fanin.every(rows_of(spark, log), ["x", "y", "z"], at="fire").select(
        "correlation_id", "step", "x.id", "y.id", "z.id").collect()))
    assert want == [(c, 3, c * 10 + 2, c * 10 + 1, c * 10 + 3) for c in range(4)]
    for order in ([2, 0, 1], [1, 2, 0]):
        batches = [[r for r in log if r[0] % 3 == k] for k in order]
        assert run_every(spark, [*batches, [beat(24 * 30)]], ["x", "y", "z"])[0][-1] == want


def test_correlations_share_state_by_group(spark, monkeypatch):
    monkeypatch.setattr(ops, "GROUPS", 3, raising=False)
    log = [(c * 10 + s, c, s, e, at(c % 7 + s), (1,)) for c in range(40) for s, e in enumerate(["a", "b", "a"][: 1 + c % 3])]
    # every second correlation starts in one batch and is completed in a later one
    batches = [[r for r in log if r[0] % 2 == k] for k in (1, 0)]
    assert run_every(spark, batches, ["a", "b"])[1] < 20  # one value and one timer a group, not one a correlation
    seen, left = run_every(spark, [*batches, [beat(24 * 30)], [beat(24 * 31)]], ["a", "b"], lifetime_ms=3_600_000)
    assert seen[-1] == [(c, 1, c * 10, c * 10 + 1) for c in range(40) if c % 3] and left == 0

    path, out = fresh() + "/log", fresh()
    for rows in [*batches, [beat(24 * 30)]]:
        rows_of(spark, rows).coalesce(1).write.mode("append").parquet(path)
    schema = spark.read.parquet(path).schema
    query = ops.timeout_race(ops.stream_log(spark, path, schema), ["a", "b"], 3_600_000, out, fresh(), "10 days", 3_600_000)
    query.awaitTermination()
    got = sorted(map(tuple, spark.read.schema("correlation_id bigint, outcome string").parquet(out).collect()))
    assert got == [(c, "Ready" if c % 3 else "TimedOut") for c in range(40)]


# -- tables kept by a stream --

def changes(spark, *rows):
    return spark.createDataFrame(list(rows), "k string, at int, v string")


def kept(table):
    return sorted(map(tuple, table.read().select("k", "at", "v").collect()), key=str)


def test_a_table_has_one_row_per_key(spark):
    table = CurrentTable(spark, fresh() + "/t", ["k"], ["at"], compact_after=3)
    table.apply(changes(spark, ("a", 1, "x"), ("a", 3, "y"), ("b", 1, "z"), (None, 1, "n")), 0)
    table.apply(changes(spark, ("a", 2, "late"), ("c", None, "q")), 1)
    assert kept(table) == sorted([("a", 3, "y"), ("b", 1, "z"), ("c", None, "q"), (None, 1, "n")], key=str)
    table.apply(changes(spark, ("b", 1, "same order, later batch"), ("c", 1, "r")), 2)  # compacts
    want = sorted([("a", 3, "y"), ("b", 1, "same order, later batch"), ("c", 1, "r"), (None, 1, "n")], key=str)
    assert kept(table) == want
    assert table.files.names("versions")[-1] == "000000000002.json" and not table._pointer()["changes"]
    table.apply(changes(spark, ("a", 9, "again")), 2)  # a batch that counts already
    assert kept(table) == want
    table.apply(changes(spark), 3)
    assert kept(table) == want and table.batch() == 3
    assert sorted(n for n in table.files.names("") if n != "versions") == ["base-000000000002", "changes-000000000003"]


def test_a_run_that_died_before_its_pointer_loses_nothing(spark, monkeypatch):
    table = CurrentTable(spark, fresh() + "/t", ["k"], ["at"], compact_after=2)
    table.apply(changes(spark, ("a", 1, "x")), 0)

    def die(*_):
        raise RuntimeError("lost")
    for step in ("_compacted", "files.publish"):
        owner = table.files if "." in step else table
        with monkeypatch.context() as m:
            m.setattr(owner, step.split(".")[-1], die)
            with pytest.raises(RuntimeError):
                table.apply(changes(spark, ("a", 2, "y"), ("b", 1, "z")), 1)
        assert kept(table) == [("a", 1, "x")] and table.batch() == 0
    # half a base, as if its writer had died
    changes(spark, ("junk", 1, "junk")).write.mode("overwrite").parquet(f"{table.path}/base-000000000001")
    table.apply(changes(spark, ("a", 2, "y"), ("b", 1, "z")), 1)
    assert kept(table) == [("a", 2, "y"), ("b", 1, "z")]


def test_older_versions_stay_readable_while_kept(spark):
    table = CurrentTable(spark, fresh() + "/t", ["k"], ["at"], compact_after=2, keep=1)
    for i in range(4):
        table.apply(changes(spark, ("a", i, str(i))), i)
    assert [r.v for r in table.read(2).collect()] == ["2"] and [r.v for r in table.read().collect()] == ["3"]
    assert table.versions() == [2, 3]
    with pytest.raises(ValueError):
        table.read(0)


def test_a_view_stream_restarts_where_it_stopped(spark):
    path, out, checkpoint = fresh() + "/log", fresh() + "/out", fresh()
    for batch in range(3):
        changes(spark, ("a", batch, str(batch)), (f"k{batch}", 0, "new")).coalesce(1).write.mode("append").parquet(path)
        stream = ops.stream_log(spark, path, changes(spark).schema)
        ops.stream_view(stream, ["k"], ["at"], out, checkpoint, compact_after=2).awaitTermination()
    table = CurrentTable(spark, out, ["k"], ["at"])
    assert kept(table) == [("a", 2, "2"), ("k0", 0, "new"), ("k1", 0, "new"), ("k2", 0, "new")]
