"""Closures from few and many seeds, stages in one reading, keyed tokens, and lookups that must be many:1."""

import hashlib
import hmac

import pytest
from pyspark.sql import functions as F

from tracefold.contract import Edge, Field
from tracefold.operators import fanin, nodes, privacy, replay
from tracefold.operators.nodes import Node
from tracefold.plans import fixtures


def chains(spark, groups, length):
    """``groups`` chains of ``length`` rows: row i of group g has the id g * 1000 + i."""
    rows = [(g * 1000 + i, None if i == 0 else g * 1000 + i - 1) for g in range(groups) for i in range(length)]
    return spark.createDataFrame(rows, "id long, causation_id long")


def rows(df):
    return sorted((r.seed, r.id, r.depth) for r in df.collect())


@pytest.mark.parametrize("few, steps", [(0, 32), (16, 32), (10 ** 9, 32), (0, 3)])
def test_every_way_to_follow_causes_gives_the_same(spark, monkeypatch, few, steps):
    monkeypatch.setattr(replay, "FEW", few)
    monkeypatch.setattr(replay, "STEPS", steps)
    log = chains(spark, 3, 9)
    seeds = log.filter("id in (8, 1004)")
    seeds = seeds.unionByName(seeds)  # a seed named twice is one seed
    assert rows(replay.ancestors(log, seeds)) == sorted([(8, i, 8 - i) for i in range(9)] + [(1004, 1000 + i, 4 - i) for i in range(5)])
    assert rows(replay.descendants(log, seeds)) == sorted([(8, 8, 0)] + [(1004, 1000 + i, i - 4) for i in range(4, 9)])


def test_one_seed_joins_no_log_with_itself(spark, monkeypatch):
    written = []
    keep = replay.materialize
    monkeypatch.setattr(replay, "materialize", lambda df, name: written.append(name) or keep(df, name))
    log = chains(spark, 40, 5)
    assert len(rows(replay.ancestors(log, log.filter("id = 4")))) == 5
    assert "jump" not in written and written.count("links") == 1
    written.clear()
    assert len(rows(replay.ancestors(log, log))) == 40 * 15
    assert "jump" in written


def test_cycles_are_refused_from_one_seed_too(spark, monkeypatch):
    monkeypatch.setattr(replay, "STEPS", 4)
    log = spark.createDataFrame([(i, (i + 1) % 20) for i in range(20)], "id long, causation_id long")
    with pytest.raises(ValueError):
        replay.ancestors(log, log.filter("id = 0"))


# -- stages --

ONE = Edge("One", "One", "A number", {"n": Field("int32", "N", "N", nullable=False)})
SAID = Edge("Said", "Said", "A text", {"t": Field("utf8", "T", "T", nullable=False)})
UP = Node("up", ONE, ONE, lambda p: {"n": p["n"] + 1})
SAY = Node("say", ONE, SAID, lambda p: {"t": p["n"].cast("string")})


def numbers(spark):
    return fixtures.origin(spark.range(4).select(F.col("id").cast("int").alias("n")), ONE, F.col("n"), F.col("n"), F.lit("2024-01-01").cast("timestamp"))


def test_stages_read_their_input_once(spark, sf):
    log = fixtures.sized(spark, sf)
    up = Node("up", fixtures.SIZED, fixtures.SIZED, lambda p: {"size": (p["size"] + 1).cast("smallint")})
    plan = nodes.repeat(up, log, 5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Union" not in plan


def test_stages_equal_one_node_after_the_other(spark):
    log = numbers(spark)
    piped = sorted(map(str, nodes.repeat(UP, log, 3).collect()))
    first = nodes.apply(UP, log)
    second = nodes.apply(UP, first, wired=True)
    assert piped == sorted(map(str, first.unionByName(second).unionByName(nodes.apply(UP, second, wired=True)).collect()))
    mixed = nodes.pipe(log, UP, SAY)
    got = {(r.node, r.n, r.t) for r in mixed.select("node", F.try_variant_get("payload", "$.n", "int").alias("n"),
                                                    F.try_variant_get("payload", "$.t", "string").alias("t")).collect()}
    assert got == {("up", i, None) for i in range(1, 5)} | {("say", None, str(i)) for i in range(1, 5)}
    assert sorted(r.payload.t for r in nodes.pipe(log, UP, SAY, opaque=True).collect()) == ["1", "2", "3", "4"]


# -- tokens --

@pytest.mark.parametrize("secret", ["s", "k" * 64, "a long secret " * 9])
def test_a_token_is_an_hmac(spark, secret):
    df = spark.createDataFrame([("Ünï|code",), ("",)], "v string")
    got = [r[0] for r in df.select(privacy.token("f|x", F.col("v"), privacy.Key(secret, "k9"))).collect()]
    want = ["tok_k9_" + hmac.new(secret.encode(), f"3:f|x{len(v.encode())}:{v}".encode(), hashlib.sha256).hexdigest() for v in ("Ünï|code", "")]
    assert got == want


def test_parts_with_separators_never_meet(spark):
    df = spark.createDataFrame([("b|c", "c")], "v string, w string")
    row = df.select(privacy.token("a", F.col("v"), "s").alias("x"), privacy.token("a|b", F.col("w"), "s").alias("y")).first()
    assert row.x != row.y


def test_tokens_of_an_old_key_still_resolve(spark):
    df = spark.createDataFrame([(1, "Ann"), (2, "Bob")], "i int, name string")
    old, old_map = privacy.redact(df.filter("i = 1"), ["name"], privacy.Key("before", "k1"))
    new, new_map = privacy.redact(df, ["name"], privacy.Key("after", "k2"))
    both = old.unionByName(new)
    back = privacy.rehydrate(both, old_map.unionByName(new_map), ["name"])
    assert sorted(map(tuple, back.collect())) == [(1, "Ann"), (1, "Ann"), (2, "Bob")]
    assert privacy.check_tokens(both, new_map, "name").count() == 1
    with pytest.raises(ValueError):
        privacy.Key("s", "a_b")


# -- lookups --

def test_a_lookup_never_multiplies_a_row(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, None)], "i int, k string")
    other = spark.createDataFrame([("a", 1, "x"), ("b", 1, "x"), ("b", 2, "y"), (None, 9, "z")], "key string, v int, w string")
    ok, failed = fanin.lookup(df, "k", other, "key")
    assert ok.columns == ["i", "k", "key", "v", "w"] and list(map(tuple, ok.collect())) == [(1, "a", "a", 1, "x")]
    assert {r.input.i: r.reason for r in failed.collect()} == {2: "2 matches for k=b", 3: "no match for k=c", 4: "no match for k=null"}
