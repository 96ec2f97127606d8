"""Whitening against numpy, and its exact parts against plain whole-number arithmetic."""

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracefold.llm import whitening as w
from tracefold.llm.queries import QUERIES


def plain(vectors, most=16):
    """(n, {row: deviation}, eigenvalues, axes, z) by numpy over the distinct rows."""
    x = np.floor(64 * np.array(vectors, float)).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(0)
    c = fit - s / n
    values, axes = np.linalg.eigh(c.T @ c / n)
    order = [i for i in np.argsort(-values)[:most] if values[i] > 1e-9]
    deviations = [sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, s)) for row in x]
    return n, deviations, values[order], axes[:, order], (x - s / n) @ axes[:, order] / np.sqrt(values[order]), values.sum()


def check(rows, keys, vectors, most=16):
    n, deviations, values, axes, z, trace = plain(vectors, most)
    got = {(r.vec_id, r.component): r for r in rows}
    assert len(got) == len(rows) == len(keys) * len(values)
    for k in range(len(values)):
        mine = np.array([got[i, k + 1].whitened for i in keys])
        assert min(np.abs(mine - z[:, k]).max(), np.abs(mine + z[:, k]).max()) < 1e-6
    for i, d in zip(keys, deviations):
        assert got[i, 1].deviation == d and got[i, 1].n == n
    for k, v in enumerate(values):
        assert math.isclose(got[keys[0], k + 1].explained, v / trace, rel_tol=1e-6)
    assert max(r.identity_error for r in rows) < 1e-9


def test_query_equals_numpy(spark, sf):
    given = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()
    check(QUERIES["op12_whitening"](spark, sf).collect(), [r.vec_id for r in given], [r.embedding for r in given])


def test_odd_rows(spark):
    rng = np.random.default_rng(3)
    good = rng.normal(size=(40, 5)).round(3).tolist()
    odd = [None, [], [1.0, None, 2.0, 3.0, 4.0], [float("nan")] * 5, [float("inf"), 0.0, 0.0, 0.0, 0.0], [1.0, 2.0]]
    rows = [(i, v, "x") for i, v in enumerate(good)] + [(100 + i, v, "x") for i, v in enumerate(odd)] + [(200, good[0], "x"), (201, good[0], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, n string")
    got = w.whiten(df).collect()
    assert {r.vec_id for r in got} == {*range(40), 200, 201}
    check(got, [*range(40), 200, 201], [*good, good[0], good[0]])
    assert w.whiten(df.filter("vec_id >= 100 and vec_id < 200 and vec_id <> 105")).collect() == []
    assert w.whiten(df.limit(0)).collect() == []
    assert w.whiten(df.filter("vec_id in (0, 200)")).collect() == []  # one distinct vector has no variance
    keyless = w.whiten(df.withColumn("vec_id", F.lit(None).cast("long"))).collect()
    assert len(keyless) == 42 * 5 and {r.vec_id for r in keyless} == {None}


def test_flat_directions_and_equal_roots(spark):
    # two equal variances, one smaller, one direction without any
    points = [[a / 4, b / 4, c / 8, 1.0] for a in (-1, 1) for b in (-1, 1) for c in (-1, 1)]
    df = spark.createDataFrame(list(enumerate(points)), "vec_id long, embedding array<double>")
    rows = w.whiten(df).collect()
    assert {r.component for r in rows} == {1, 2, 3} and max(r.identity_error for r in rows) < 1e-12
    assert {r.component: round(r.explained, 9) for r in rows} == {1: round(4 / 9, 9), 2: round(4 / 9, 9), 3: round(1 / 9, 9)}


def test_large_entries_stay_exact(spark):
    points = [[1e9, 3.0], [-2e9, 5.5], [7e8, -1.0], [1.0, 2.0]]
    df = spark.createDataFrame(list(enumerate(points)), "vec_id long, embedding array<double>")
    x = [[math.floor(64 * c) for c in p] for p in points]
    s = [sum(c) for c in zip(*x)]
    want = [sum((4 * a - b) ** 2 for a, b in zip(p, s)) for p in x]
    got = {r.vec_id: r.deviation for r in w.whiten(df).collect()}
    assert got == {i: (v if v < 1 << 63 else None) for i, v in enumerate(want)}


def test_exact_polynomial_and_roots(spark):
    rng = np.random.default_rng(5)
    a = rng.integers(-50, 50, (6, 9))
    m = [[int(v) for v in row] for row in a @ a.T]
    found = w.polynomial(spark, m)
    for x in (0, 1, -3, 1000):  # det(x - m) by fractions
        rows = [[Fraction((x if i == j else 0) - m[i][j]) for j in range(6)] for i in range(6)]
        det = Fraction(1)
        for k in range(6):
            p = next(i for i in range(k, 6) if rows[i][k])
            if p != k:
                rows[k], rows[p], det = rows[p], rows[k], -det
            det *= rows[k][k]
            for i in range(k + 1, 6):
                f = rows[i][k] / rows[k][k]
                rows[i] = [u - f * v for u, v in zip(rows[i], rows[k])]
        assert w._value(found, x) == det
    roots, bits = w.largest_roots(found, 4)
    assert np.allclose([r / (1 << bits) for r in roots], np.linalg.eigvalsh(np.array(m, float))[::-1][:4], rtol=1e-12)
    axes = w.components(m, roots, bits)
    assert np.abs(np.array(m, float) @ axes - axes * [r / (1 << bits) for r in roots]).max() < 1e-8
    assert np.abs(axes.T @ axes - np.eye(4)).max() < 1e-12


@pytest.mark.parametrize("matrix", [[[4, 0], [0, 4]], [[0, 0], [0, 9]], [[7]]])
def test_small_matrices(spark, matrix):
    values = sorted(np.linalg.eigvalsh(np.array(matrix, float)), reverse=True)
    roots, bits = w.largest_roots(w.polynomial(spark, matrix), 16)
    assert [r / (1 << bits) for r in roots] == [v for v in values if v > 0]
    axes = w.components(matrix, roots, bits)
    assert np.abs(axes.T @ axes - np.eye(len(roots))).max() < 1e-12


def test_gram_of_any_size():
    x = np.array([[2 ** 50 + 3, -7], [-(2 ** 61), 5], [1, 2 ** 19]], np.int64)
    want = [[sum(int(a[i]) * int(a[j]) for a in x) for j in range(2)] for i in range(2)]
    assert w.gram(x).tolist() == want
