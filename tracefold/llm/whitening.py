"""Embedding whitening by the exact characteristic polynomial.

Entries become whole numbers, and the scatter of the distinct vectors, ``n * sum(x x') - S S'``, is summed in whole numbers by all
tasks.  Its characteristic polynomial is found modulo many primes (Hessenberg reduction, one task per share of the primes) and put
together by Chinese remaindering.  A symmetric matrix has real roots only, so the sign changes of the polynomial shifted to ``a``
count the roots above ``a`` exactly: that isolates the largest ones, and bisection refines them to PRECISION bits.  Each component is
the null space of the shifted scatter, by inverse iteration in fixed-point numbers.

To the driver come sums by pair of dimensions and one polynomial per prime; their number depends on the dimensions, not on the rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefold.llm.common import extended
from tracefold.session import materialize

SCALE, SHIFT = 64, 1_000_000
MOST = 16
#: Bits of a root beyond the trace's, of a fixed-point number, of a summand that is sent as one long.
PRECISION, WORK, PART = 160, 400, 40
LIMB = 20  # products of two, over ROWS rows, are exact in a double
ROWS = 4096


# -- whole-number sums ------------------------------------------------------------

def gram(x: np.ndarray) -> np.ndarray:
    """x' x of whole numbers, exact, as Python integers: limb by limb in floating point."""
    limbs, rest = [], x.astype(np.int64)
    while True:
        low = ((rest + (1 << LIMB - 1)) & ((1 << LIMB) - 1)) - (1 << LIMB - 1)
        limbs.append(low.astype(np.float64))
        rest = (rest - low) >> LIMB
        if not rest.any():
            break
    total = np.zeros((x.shape[1], x.shape[1]), object)
    for a, left in enumerate(limbs):
        for b, right in enumerate(limbs):
            for at in range(0, len(x), ROWS):
                part = left[at:at + ROWS].T @ right[at:at + ROWS]
                total += part.astype(np.int64).astype(object) << LIMB * (a + b)
    return total


def _matrix(batch: pa.RecordBatch, column: str) -> np.ndarray:
    lists = batch.column(column)
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(lists), -1)


def scatter(fit: DataFrame, width: int) -> tuple[int, list[int], list[list[int]]]:
    """(n, sums, n * sum(x x') - sums sums') of the column ``x``, less SHIFT; every sum is exact."""
    def run(batches: Iterator[pa.RecordBatch]):
        total = np.zeros((width + 1, width + 1), object)
        for batch in batches:
            if len(batch):
                x = _matrix(batch, "x") - SHIFT
                total += gram(np.hstack([x, np.ones((len(x), 1), np.int64)]))
        out = [[], [], [], []]
        for i in range(width + 1):
            for j in range(i, width + 1):
                value, part = int(total[i, j]), 0
                while value:
                    low = ((value + (1 << PART - 1)) & ((1 << PART) - 1)) - (1 << PART - 1)
                    for column, v in zip(out, (i, j, part, low)):
                        column.append(v)
                    value, part = (value - low) >> PART, part + 1
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int32()),
                                          pa.array(out[3], pa.int64())], ["i", "j", "part", "value"])

    parts = fit.mapInArrow(run, "i int, j int, part int, value long").groupBy("i", "j", "part").agg(F.sum("value").alias("value"))
    sums = [[0] * (width + 1) for _ in range(width + 1)]
    for r in parts.collect():  # pairs of dimensions
        sums[r.i][r.j] += r.value << PART * r.part
        if r.i != r.j:
            sums[r.j][r.i] = sums[r.i][r.j]
    n, s = sums[width][width], sums[width][:width]
    return n, s, [[n * sums[i][j] - s[i] * s[j] for j in range(width)] for i in range(width)]


# -- the characteristic polynomial ------------------------------------------------

def primes_below(top: int) -> Iterator[int]:
    def is_prime(n: int) -> bool:
        d, r = n - 1, 0
        while d % 2 == 0:
            d, r = d // 2, r + 1
        for a in (2, 3, 5, 7):  # enough below 3 * 10 ** 9
            x = pow(a, d, n)
            if x in (1, n - 1):
                continue
            for _ in range(r - 1):
                x = x * x % n
                if x == n - 1:
                    break
            else:
                return False
        return True
    return (n for n in range(top - 1 | 1, 1, -2) if n < top and is_prime(n))


def polynomial_mod(matrix: np.ndarray, p: int) -> np.ndarray:
    """Coefficients of det(x - matrix) modulo ``p``, constant first, by reduction to Hessenberg form."""
    a, d = matrix.copy(), len(matrix)
    for k in range(d - 2):
        below = np.flatnonzero(a[k + 1:, k])
        if not len(below):
            continue
        pivot = k + 1 + int(below[0])
        if pivot != k + 1:
            a[[k + 1, pivot]] = a[[pivot, k + 1]]
            a[:, [k + 1, pivot]] = a[:, [pivot, k + 1]]
        u = a[k + 2:, k] * pow(int(a[k + 1, k]), -1, p) % p
        a[k + 2:] = (a[k + 2:] - u[:, None] * a[k + 1] % p) % p
        a[:, k + 1] = (a[:, k + 1] + (a[:, k + 2:] * u % p).sum(1)) % p
    found = np.zeros((d + 1, d + 1), np.int64)
    found[0, 0] = 1
    for k in range(d):
        weights, product = np.zeros(k + 1, np.int64), 1
        for i in range(k, -1, -1):
            weights[i] = int(a[i, k]) * product % p
            product = product * int(a[i, i - 1]) % p if i else 0
        found[k + 1, 1:] = found[k, :-1]
        found[k + 1] = (found[k + 1] - (weights[:, None] * found[:k + 1] % p).sum(0)) % p
    return found[d]


def polynomial(spark: SparkSession, matrix: list[list[int]]) -> list[int]:
    """Coefficients of det(x - matrix), constant first, of a symmetric whole-number matrix without negative roots."""
    d, trace = len(matrix), sum(matrix[i][i] for i in range(len(matrix)))
    # by Maclaurin's inequality the k-th coefficient is at most C(d, k) (trace / d) ** k
    bits = max(math.log2(math.comb(d, k)) + k * (math.log2(trace) - math.log2(d)) for k in range(d + 1)) if trace else 1
    needed = int(bits / 30.99) + 2
    primes = [p for p, _ in zip(primes_below(1 << 31), range(needed))]

    def run(batches):
        for batch in batches:
            for i in batch.column(0).to_pylist():
                p = primes[i]
                rest = polynomial_mod(np.array([[v % p for v in row] for row in matrix], np.int64), p)
                yield pa.RecordBatch.from_arrays([pa.array([p]), pa.array([rest.tolist()], pa.list_(pa.int64()))], ["prime", "rest"])

    slots = min(len(primes), spark.sparkContext.defaultParallelism)
    found = spark.range(0, len(primes), 1, slots).mapInArrow(run, "prime long, rest array<long>").collect()  # one row per prime
    whole = math.prod(primes)
    weights = {p: whole // p * pow(whole // p, -1, p) for p in primes}
    out = []
    for k in range(d + 1):
        c = sum(r.rest[k] * weights[r.prime] for r in found) % whole
        out.append(c - whole if 2 * c > whole else c)
    if out[d] != 1 or -out[d - 1] != trace:
        raise ArithmeticError("the polynomial does not have the matrix's trace")
    return out


# -- roots --------------------------------------------------------------------------

def shifted(coefficients: list[int], a: int) -> list[int]:
    """p(x + a)."""
    c = list(coefficients)
    for i in range(len(c) - 1):
        for j in range(len(c) - 2, i - 1, -1):
            c[j] += a * c[j + 1]
    return c


def above(coefficients: list[int], a: int) -> int:
    """Number of roots above ``a``, with multiplicity: exact where all roots are real."""
    signs = [c > 0 for c in shifted(coefficients, a) if c]
    return sum(x != y for x, y in zip(signs, signs[1:]))


def _value(coefficients: list[int], x: int) -> int:
    v = 0
    for c in reversed(coefficients):
        v = v * x + c
    return v


def largest_roots(coefficients: list[int], most: int) -> tuple[list[int], int]:
    """(the largest positive roots in falling order times 2 ** bits, bits)."""
    d = len(coefficients) - 1
    trace = -coefficients[d - 1]
    bits = max(0, PRECISION - trace.bit_length())
    scaled = [c << bits * (d - k) for k, c in enumerate(coefficients)]
    top = 1 << trace.bit_length() + bits
    roots: list[int] = []
    open_ = [(0, top, above(scaled, 0), 0)]  # of (low, high, roots above low, roots above high) the last is the highest
    while open_ and len(roots) < most:
        low, high, at_low, at_high = open_.pop()
        many = at_low - at_high
        if not many:
            continue
        if many == 1:
            # p changes its sign once in the interval
            sign = 1 if at_high % 2 == 0 else -1
            while high - low > 1:
                middle = (low + high) // 2
                v = _value(scaled, middle) * sign
                if v == 0:
                    low, high = middle - 1, middle
                elif v < 0:
                    low = middle
                else:
                    high = middle
        if high - low <= 1:
            roots.extend([high] * many)
            continue
        middle = (low + high) // 2
        at_middle = above(scaled, middle)
        open_.append((low, middle, at_low, at_middle))
        open_.append((middle, high, at_middle, at_high))
    return roots[:most], bits


# -- components ---------------------------------------------------------------------

def _fixed_product(a, b):
    return (a * b) >> WORK


def _unit(v: np.ndarray) -> np.ndarray:
    """A vector of Python integers scaled to length one in fixed point."""
    drop = max(0, max(abs(int(e)).bit_length() for e in v) - 2 * WORK)
    v = np.array([int(e) >> drop for e in v], object)
    length = math.isqrt(sum(int(e) * int(e) for e in v)) or 1
    return np.array([(int(e) << WORK) // length for e in v], object)


def components(matrix: list[list[int]], roots: list[int], bits: int) -> np.ndarray:
    """Unit eigenvectors as columns, to double precision, by inverse iteration on ``matrix - root``.

    Equal roots get vectors orthogonal to each other.
    """
    d, found = len(matrix), []
    scale = max(1, max(abs(v) for row in matrix for v in row)).bit_length()  # entries become at most one
    whole = np.array([[(v << WORK) >> scale for v in row] for row in matrix], object)
    for number, root in enumerate(roots):
        a = whole.copy()
        for i in range(d):
            a[i, i] -= (root << WORK) >> (bits + scale)
        factors = []
        for k in range(d):
            pivot = k + max(range(d - k), key=lambda i: abs(a[k + i, k]))
            a[[k, pivot]] = a[[pivot, k]]
            if a[k, k] == 0:
                a[k, k] = 1
            multiples = np.array([(int(v) << WORK) // int(a[k, k]) for v in a[k + 1:, k]], object)
            if len(multiples):
                a[k + 1:, k:] -= _fixed_product(multiples[:, None], a[k, k:][None, :])
            factors.append((pivot, multiples))
        same = [v for v, r in zip(found, roots) if abs(r - root) <= 1]
        # a start that is not orthogonal to the component but by accident; one unit of the last place is far below any gap
        v = _unit(np.array([((i + 1) * (number + 3) ** 2 * 7919) % 1009 + 1 for i in range(d)], object))
        for _ in range(3):
            for k, (pivot, multiples) in enumerate(factors):
                v[[k, pivot]] = v[[pivot, k]]
                if len(multiples):
                    v[k + 1:] -= _fixed_product(multiples, v[k])
            for k in range(d - 1, -1, -1):
                rest = v[k] - (int((a[k, k + 1:] * v[k + 1:]).sum()) >> WORK if k + 1 < d else 0)
                v[k] = (int(rest) << WORK) // int(a[k, k])
            v = _unit(v)
            for other in same:
                v = v - _fixed_product(other, int((other * v).sum()) >> WORK)
            v = _unit(v)
        found.append(v)
    return np.array([[int(e) / (1 << WORK) for e in v] for v in found]).reshape(len(found), d).T


# -- the operator -------------------------------------------------------------------

def whole_entries(vector: Column) -> Column:
    """floor(64 c) + 1000000 of every entry, taken as double."""
    return F.transform(vector.cast("array<double>"), lambda c: F.floor(c * F.lit(float(SCALE))).cast("long") + F.lit(SHIFT))


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.lit(False)))
    return F.coalesce((F.size(vector) > 0) & finite, F.lit(False))


def whiten(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", most: int = MOST) -> DataFrame:
    """Per usable row and component (by falling eigenvalue, at most ``most``): key, component, n, deviation, whitened, explained, identity_error.

    Rows whose vector is null, empty, or holds a null or non-finite entry are left out, as are vectors of another length than the
    most frequent one (of equally frequent ones the longer).  The fit counts each distinct vector once, so repeated rows change
    nothing and are whitened alike.  Directions without variance are no components; a table with no variance or no rows gives no
    rows.  ``deviation`` is null where it exceeds a long.  Rows without a key and ties are kept; other columns are not read.
    """
    spark = vectors.sparkSession
    names = ["component", "n", "deviation", "whitened", "explained", "identity_error"]
    held = vectors.filter(usable(F.col(column))).select(F.col(key), whole_entries(F.col(column)).alias("x"))
    schema = extended(held, [key], "component int, n long, deviation long, whitened double, explained double, identity_error double")
    empty = spark.createDataFrame([], schema)
    width = held.groupBy(F.size("x").alias("w")).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), F.desc("w")).first()
    if width is None:
        return empty
    width = width["w"]
    held = held.filter(F.size("x") == width)
    fit = materialize(held.select("x").distinct(), "distinct-vectors")
    n, sums, matrix = scatter(fit, width)
    trace = sum(matrix[i][i] for i in range(width))
    if trace == 0:
        return empty
    roots, bits = largest_roots(polynomial(spark, matrix), most)
    axes = components(matrix, roots, bits)
    count = len(roots)
    # of the covariance matrix / n ** 2
    spread = np.array([math.sqrt(r / (1 << bits) / n / n) for r in roots])
    explained = [r / (trace << bits) for r in roots]
    most_sum = max(map(abs, sums))

    def project(x: np.ndarray):
        """(whitened, deviations) of rows of whole numbers less SHIFT."""
        if n * int(np.abs(x).max(initial=0)) + most_sum < 1 << 62:
            y = n * x - np.array(sums, np.int64)
        else:
            y = n * x.astype(object) - np.array(sums, object)
        z = (y.astype(np.float64) / n) @ axes / spread
        small = all(abs(v) < 1 << 62 for v in (int(y.max(initial=0)), int(y.min(initial=0)))) and \
            max(abs(int(y.max(initial=0))), abs(int(y.min(initial=0)))) ** 2 * width < 1 << 63
        if small:
            return z, (y.astype(np.int64) ** 2).sum(1).tolist()
        exact = (y.astype(object) ** 2).sum(1).tolist()
        return z, [v if v < 1 << 63 else None for v in exact]

    def moments(batches):
        first, second = np.zeros(count), np.zeros((count, count))
        for batch in batches:
            if len(batch):
                z, _ = project(_matrix(batch, "x") - SHIFT)
                first, second = first + z.sum(0), second + z.T @ z
        i, j = np.indices(second.shape)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(i.ravel(), np.arange(count)), pa.int32()), pa.array(np.append(j.ravel(), np.full(count, -1)), pa.int32()),
                                          pa.array(np.append(second.ravel(), first))], ["i", "j", "value"])

    found = fit.mapInArrow(moments, "i int, j int, value double").groupBy("i", "j").agg(F.sum("value").alias("value")).collect()  # components
    whole = {(r.i, r.j): r.value / n for r in found}
    error = max(abs(whole[i, j] - whole[i, -1] * whole[j, -1] - (i == j)) for i in range(count) for j in range(count))

    def run(batches):
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                part = batch.slice(at, ROWS)
                z, deviations = project(_matrix(part, "x") - SHIFT)
                rows = pa.array(np.repeat(np.arange(len(part)), count))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(rows), pa.array(np.tile(np.arange(1, count + 1), len(part)), pa.int32()), pa.array(np.full(len(rows), n)),
                     pa.array(deviations, pa.int64()).take(rows), pa.array(z.ravel()), pa.array(np.tile(explained, len(part))),
                     pa.array(np.full(len(rows), error))], [key, *names])

    return held.mapInArrow(run, schema)
