"""Hot groups: the segmented paths must equal brute force."""

import itertools

import pytest
from pyspark.sql import functions as F

from tracefold.functions import ordered
from tracefold.operators import fanin, lineage, replay, state
from tracefold.plans import fixtures


@pytest.fixture()
def small_limits(monkeypatch):
    monkeypatch.setattr(ordered, "HOT_ROWS", 40)
    monkeypatch.setattr(ordered, "SEGMENT_ROWS", 30)


ROWS = [("hot", i, f"{i:04d}", ["a", "b", "c"][i * 7 % 3], (i * 37) % 11 - 5 if i % 6 else None) for i in range(400)] + [
    (f"g{g}", i, f"{g}-{i}", ["a", "b", "c"][(i + g) % 3], i - g) for g in range(20) for i in range(g)]


@pytest.fixture()
def log(spark):
    return spark.createDataFrame(ROWS, "correlation_id string, step int, id string, edge string, v int").repartition(5)


def groups():
    for key, rows in itertools.groupby(sorted(ROWS), key=lambda r: r[0]):
        yield key, list(rows)


def test_only_large_groups_are_hot(log, small_limits):
    found = ordered.hot_groups(log, ["correlation_id"])
    assert [r.correlation_id for r in found.table.collect()] == ["hot"] and found.total() == 400
    assert ordered.hot_groups(log, ["correlation_id"], 1000) is None


def test_hot_groups_show_in_a_sample(spark, monkeypatch):
    monkeypatch.setattr(ordered, "PROBE", 200)
    rows = spark.range(60_000).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id") % 5000).alias("k"))
    found = ordered.hot_groups(rows, ["k"], 10_000)
    (hot,) = found.table.collect()
    assert hot.k == -1 and 15_000 < hot.rows < 25_000


def test_too_many_hot_keys_are_joined_as_a_table(log, monkeypatch):
    monkeypatch.setattr(ordered, "HOT_ROWS", 5)
    monkeypatch.setattr(ordered, "SEGMENT_ROWS", 30)
    monkeypatch.setattr(ordered, "HOT_GROUPS", 3)
    found = ordered.hot_groups(log, ["correlation_id"])
    assert not found.few and found.table.count() == 15
    out = ordered.Ordered(log, ["correlation_id"], ["step"]).numbered("n").df
    assert out.filter(F.col("n") != F.col("step")).count() == 0 and out.count() == len(ROWS)


@pytest.mark.parametrize("inclusive", [True, False])
def test_running_values(log, small_limits, inclusive):
    seen = ordered.Ordered(log, ["correlation_id"], ["step", "id"])
    assert seen._hot is not None and seen._hot.select("__segment").distinct().count() > 3
    out = seen.running({"s": ("sum", F.col("v")), "lo": ("min", F.col("v")), "hi": ("max", F.col("v")),
                        "last": ("last", F.when(F.col("edge") == "a", F.col("v")))}, inclusive).df.collect()
    want = {}
    for key, rows in groups():
        for i, r in enumerate(rows):
            upto = rows[:i + 1] if inclusive else rows[:i]
            vs = [x[4] for x in upto if x[4] is not None]
            lasts = [x[4] for x in upto if x[3] == "a" and x[4] is not None]
            want[key, r[1]] = (sum(vs) if vs else None, min(vs, default=None), max(vs, default=None), lasts[-1] if lasts else None)
    assert {(r.correlation_id, r.step): (r.s, r.lo, r.hi, r["last"]) for r in out} == want


def test_positions_and_previous_rows(log, small_limits):
    out = ordered.Ordered(log, ["correlation_id"], ["id"]).numbered("n", {"before": "v", "prev": "id"}).df.collect()
    want = {}
    for key, rows in groups():
        rows = sorted(rows, key=lambda r: r[2])
        for i, r in enumerate(rows):
            want[r[2]] = (i, rows[i - 1][4] if i else None, rows[i - 1][2] if i else None)
    assert {r.id: (r.n, r.before, r.prev) for r in out} == want


def test_ordered_fold(log, small_limits):
    lift = F.struct(F.lit(0).alias("floor"), F.coalesce("v", F.lit(0)).alias("shift"))
    merge = lambda a, b: F.struct(F.greatest(b["floor"], a["floor"] + b["shift"]).alias("floor"),
                                  (a["shift"] + b["shift"]).alias("shift"))
    out = state.ordered_fold(log, lift, merge).select("correlation_id", F.greatest("state.floor", "state.shift").alias("b"))
    want = {}
    for key, rows in groups():
        balance = 0
        for r in rows:
            balance = max(0, balance + (r[4] or 0))
        want[key] = balance
    assert {r.correlation_id: r.b for r in out.collect()} == want


def test_event_log_is_the_same_with_and_without_segments(spark, sf, monkeypatch):
    plain = fixtures.event_log(spark, sf).select("id", "causation_id", "step").collect()
    monkeypatch.setattr(ordered, "HOT_ROWS", 3)
    monkeypatch.setattr(ordered, "SEGMENT_ROWS", 10)
    assert sorted(map(tuple, fixtures.event_log(spark, sf).select("id", "causation_id", "step").collect()), key=str) == sorted(
        map(tuple, plain), key=str)


def test_run_statistics_on_a_hot_run(log, small_limits):
    distances = {}
    passing, runs = {}, 0
    for key, rows in groups():
        for i, r in enumerate(rows):
            starts = [x[1] for x in rows[:i] if x[3] == "a"]
            if starts:
                distances[r[3]] = min(distances.get(r[3], 10 ** 9), r[1] - starts[-1])
        sa = next((x[1] for x in rows if x[3] == "a"), None)
        sb = next((x[1] for x in rows if sa is not None and x[3] == "b" and x[1] > sa), None)
        if sb is not None:
            runs += 1
            for e in {x[3] for x in rows if sa < x[1] < sb}:
                passing[e] = passing.get(e, 0) + 1
    assert {r.edge: r.distance for r in lineage.reachable(log, "a").collect()} == distances
    assert {r.edge: (r.passing, r.runs) for r in lineage.must_pass(log, "a", "b").collect()} == {
        e: (n, runs) for e, n in passing.items()}


def test_firing_reading_of_a_hot_run(log, small_limits):
    got = fanin.every(log, ["a", "c"], at="fire", carry=("v",)).collect()
    want = {}
    for key, rows in groups():
        held = {}
        for r in rows:
            held[r[3]] = (r[2], r[4])
            if "a" in held and "c" in held:
                want[key] = (r[1], held["a"], held["c"])
                break
    assert {r.correlation_id: (r.step, (r.a.id, r.a.v), (r.c.id, r.c.v)) for r in got} == want


def test_routes_are_identified_beyond_their_printed_part(spark):
    rows = [(c, i, f"{c}{i}", e) for c, path in {"x": "aabbc", "y": "aabbd", "z": "aabbc"}.items() for i, e in enumerate(path)]
    log = spark.createDataFrame(rows, "correlation_id string, step int, id string, edge string")
    got = sorted((r.route, r.steps, r.runs) for r in lineage.routes(log, max_depth=2).collect())
    assert got == [("a>a>…", 5, 1), ("a>a>…", 5, 2)]
    whole = sorted((r.route, r.runs) for r in lineage.routes(log, chained=True).collect())
    assert whole == [("a>a>b>b>c", 2), ("a>a>b>b>d", 1)]


def test_fan_out_does_not_lengthen_a_route(spark):
    rows = [("c", 0, "r", "root")] + [("c", 1, f"k{i}", "leaf") for i in range(9)]
    log = spark.createDataFrame(rows, "correlation_id string, step int, id string, edge string")
    assert [(r.route, r.runs) for r in lineage.routes(log).collect()] == [("root>leaf", 1)]


def test_closure_of_a_long_chain(spark):
    n = 150
    log = spark.range(n).select("id", F.when(F.col("id") > 0, F.col("id") - 1).alias("causation_id"))
    up = replay.ancestors(log, log.filter(F.col("id") == n - 1)).collect()
    assert sorted((r.id, r.depth) for r in up) == [(i, n - 1 - i) for i in range(n)]
    down = replay.descendants(log, log.filter(F.col("id").isin(0, 100))).collect()
    assert sorted((r.seed, r.id, r.depth) for r in down) == sorted(
        [(0, i, i) for i in range(n)] + [(100, i, i - 100) for i in range(100, n)])


def test_closure_of_a_tree(spark):
    rows = [(0, None)] + [(i, (i - 1) // 2) for i in range(1, 31)]
    log = spark.createDataFrame(rows, "id bigint, causation_id bigint")
    down = replay.descendants(log, log.filter(F.col("id") == 0))
    assert down.count() == 31 and down.filter("depth = 4").count() == 16


def test_cycles_are_refused(spark):
    log = spark.createDataFrame([(1, 2), (2, 1)], "id bigint, causation_id bigint")
    with pytest.raises(ValueError):
        replay.ancestors(log, log)


def fanned(spark):
    rows = [("c", 0, "s0", "s"), ("c", 1, "q1", "q"), ("c", 2, "s2", "s"), ("c", 2, "x2", "x"), ("c", 2, "z2", "z"),
            ("d", 0, "s0d", "s"), ("d", 1, "m1", "m"), ("d", 1, "p1", "p")]
    return spark.createDataFrame(rows, "correlation_id string, step int, id string, edge string")


@pytest.mark.parametrize("hot", [10 ** 6, 1])
def test_siblings_of_a_fan_out(spark, monkeypatch, hot):
    monkeypatch.setattr(ordered, "HOT_ROWS", hot)
    monkeypatch.setattr(ordered, "SEGMENT_ROWS", 2)
    log = fanned(spark)
    assert {r.edge: r.distance for r in lineage.reachable(log, "s").collect()} == {"q": 1, "s": 2, "x": 2, "z": 2, "m": 1, "p": 1}
    assert lineage.must_pass(log, "s", "p").count() == 0  # m stands beside p, not before it
    assert {r.edge: (r.passing, r.runs) for r in lineage.must_pass(log, "s", "z").collect()} == {"q": (1, 1)}
    assert [(r.route, r.depth) for r in lineage.rank_routes(log, "s", "z", 5, 3).collect()] == [("s>q>z", 2)]


def test_a_hot_null_key_is_one_group(spark, monkeypatch):
    monkeypatch.setattr(ordered, "HOT_ROWS", 10)
    monkeypatch.setattr(ordered, "SEGMENT_ROWS", 8)
    rows = spark.range(60).select(F.when(F.col("id") % 3 == 0, F.col("id") % 2).alias("k"), "id")
    seen = ordered.Ordered(rows, ["k"], ["id"])
    assert seen._hot is not None and seen._hot.filter("k is null").count() == 40
    out = seen.running({"n": ("sum", F.lit(1))}).df
    assert out.count() == 60 and sorted(r.n for r in out.filter("k is null").collect()) == list(range(1, 41))


def test_quantiles_have_their_own_columns(spark):
    rows = [(0, None, "a", 0)] + [(i, 0, "b", i) for i in range(1, 2001)]
    log = spark.createDataFrame(rows, "id int, causation_id int, edge string, ts int")
    got = lineage.latency(log, lambda a, b: (a - b).cast("bigint"), (0.5, 0.995, 0.9995)).first()
    assert (got.p50, got.p99_5, got.p99_95) == (1000, 1990, 1999)


def test_a_joining_task_reads_little_however_large_the_tables(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        ids = spark.range(1_600_000).select(F.sha2(F.col("id").cast("string"), 256).alias("id"))  # 100 MB that do not compress well
        assert ids.repartition("id").groupBy("id").count().rdd.getNumPartitions() >= 6
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_small_files_of_large_derived_rows_are_not_broadcast(spark):
    from tracefold.session import materialize, tune
    tune(spark)
    # 300,000 numbers in about 1 MB of files, whose hashes take 20 MB
    numbers = materialize(spark.range(300_000).coalesce(1), "numbers")
    ids = numbers.select(F.sha2(F.col("id").cast("string"), 256).alias("id"), F.lit(1).alias("one"))
    joined = ids.join(ids.select("id", F.lit(2).alias("two")), "id")
    assert joined.count() == 300_000
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan
