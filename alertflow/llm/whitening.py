"""Whitening of embeddings from the exact characteristic polynomial.

1. Entries become integers, ``floor(256 * c)``; every distinct vector counts
   once.  Executors sum ``x`` and ``x x^T`` exactly, so the scatter matrix
   ``n * sum(x x^T) - S S^T`` (the covariance times ``n ** 2``) is an integer
   matrix without rounding.
2. Its characteristic polynomial is found modulo many primes, each by reduction
   to Hessenberg form on the executors, and put together by Chinese
   remaindering.  Maclaurin's inequality bounds the coefficients, and so the
   number of primes that make the result certain.
3. All roots are real and none is negative, so the sign changes of the shifted
   polynomial count exactly the roots beyond a point.  Bisection on that count
   isolates the largest roots; signs refine them to ``ROOT_BITS`` bits.
4. A component spans the null space of ``matrix - root``: inverse iteration on
   a factorisation in high-precision decimals.

What reaches the driver depends on the dimension alone: the matrix, the
polynomial and at most ``COMPONENTS`` vectors.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator
from decimal import Context, Decimal, localcontext

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, tune

SCALE = 256
COMPONENTS = 4
ROOT_BITS = 160      # bits of a root behind its first one
ALIKE_BITS = 60      # roots that agree in so many bits share one space
DIGITS = 120         # decimal digits of the null-space solver, besides those of the matrix
LIMB = 20            # bits of the numbers that are multiplied in floating point, exactly
TASK_GROUPS = 64     # partial sums are merged in two steps
_LONG = 1 << 63


# --- integers ----------------------------------------------------------------

def whole_numbers(v: np.ndarray) -> np.ndarray:
    """floor(256 * c) as 64-bit integers; what lies beyond them stops at their end."""
    with np.errstate(over="ignore"):
        f = np.floor(v * float(SCALE))
    inside = (f >= -float(_LONG)) & (f < float(_LONG))
    out = np.where(inside, f, 0).astype("i8")
    out[f >= float(_LONG)] = _LONG - 1
    out[f < -float(_LONG)] = -_LONG
    return out


def pack_row(x: np.ndarray) -> bytes:
    """One vector as bytes; equal vectors give equal bytes."""
    small = x.astype("<i2")
    return b"s" + small.tobytes() if (small == x).all() else b"l" + x.astype("<i8").tobytes()


def unpack_row(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<i2" if raw[:1] == b"s" else "<i8", offset=1).astype("i8")


def gram_matrix(x: np.ndarray) -> np.ndarray:
    """x^T x without rounding, as Python integers: the numbers are cut into
    limbs, whose products and sums a double holds exactly."""
    if not len(x):
        return np.zeros((x.shape[1], x.shape[1]), object)
    limbs, rest = [], x
    while True:
        low = rest & ((1 << LIMB) - 1)
        rest = rest >> LIMB
        done = bool(((rest == 0) | (rest == -1)).all())
        if done:
            low = low + (rest << LIMB)  # the last limb keeps the sign
        limbs.append(low.astype("f8"))
        if done:
            break
    out = np.zeros((x.shape[1], x.shape[1]), object)
    for i, a in enumerate(limbs):
        for j, b in enumerate(limbs):
            out += (a.T @ b).astype("i8").astype(object) * (1 << LIMB * (i + j))
    return out


def scatter(n: int, total: list[int], gram: np.ndarray) -> np.ndarray:
    """n * sum(x x^T) - S S^T: the covariance (divisor n) times n ** 2."""
    s = np.array(total, object)
    return gram * n - np.outer(s, s)


# --- characteristic polynomial -------------------------------------------------

def is_prime(n: int) -> bool:
    """Miller-Rabin with bases that decide every n below 3 * 10 ** 9."""
    if n < 2 or any(n % p == 0 for p in (2, 3, 5, 7)):
        return n in (2, 3, 5, 7)
    odd, twos = n - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for base in (2, 3, 5, 7):
        x = pow(base, odd, n)
        if x in (1, n - 1):
            continue
        for _ in range(twos - 1):
            x = x * x % n
            if x == n - 1:
                break
        else:
            return False
    return True


def primes_beyond(bound: int) -> list[int]:
    """Primes below 2 ** 31, largest first, whose product exceeds ``bound``."""
    out, product, p = [], 1, 1 << 31
    while product <= bound:
        p -= 1
        if is_prime(p):
            out.append(p)
            product *= p
    return out


def coefficient_bound(matrix: np.ndarray) -> int:
    """No coefficient of the polynomial is larger: its k-th is the sum of all
    products of k roots, at most binomial(d, k) * (trace / d) ** k."""
    d, mean = len(matrix), -(-sum(int(matrix[i, i]) for i in range(len(matrix))) // max(len(matrix), 1))
    return max((math.comb(d, k) * mean ** k for k in range(d + 1)), default=1)


def hessenberg(a: np.ndarray, p: int) -> np.ndarray:
    """A similar matrix modulo ``p`` with zeros below the first subdiagonal."""
    h, d = a.copy(), len(a)
    for k in range(d - 2):
        below = np.flatnonzero(h[k + 1:, k])
        if not len(below):
            continue
        q = k + 1 + int(below[0])
        if q != k + 1:
            h[[k + 1, q]] = h[[q, k + 1]]
            h[:, [k + 1, q]] = h[:, [q, k + 1]]
        u = h[k + 2:, k] * pow(int(h[k + 1, k]), -1, p) % p
        h[k + 2:] = (h[k + 2:] - u[:, None] * h[k + 1] % p) % p
        h[:, k + 1] = (h[:, k + 1] + (h[:, k + 2:] * u % p).sum(1)) % p
    return h


def polynomial_mod(a: np.ndarray, p: int) -> np.ndarray:
    """Coefficients of det(t - a) modulo ``p``, highest first."""
    h, d = hessenberg(a, p), len(a)
    lead = np.zeros((d + 1, d + 1), "i8")   # row m: polynomial of the leading m x m block, lowest first
    lead[0, 0] = 1
    for m in range(1, d + 1):
        row = np.zeros(d + 1, "i8")
        row[1:] = lead[m - 1, :-1]
        row = (row - int(h[m - 1, m - 1]) * lead[m - 1] % p) % p
        step = 1
        for i in range(m - 1, 0, -1):       # products of the subdiagonal from i on
            step = step * int(h[i, i - 1]) % p
            if not step:
                break
            row = (row - int(h[i - 1, m - 1]) * step % p * lead[i - 1] % p) % p
        lead[m] = row
    return lead[d, ::-1]


def remainder_join(residues: list[int], primes: list[int]) -> int:
    """The number nearest to 0 with these residues."""
    value, modulus = 0, 1
    for r, p in zip(residues, primes):
        value += modulus * ((r - value) * pow(modulus, -1, p) % p)
        modulus *= p
    return value - modulus if 2 * value > modulus else value


# --- roots -----------------------------------------------------------------------

def roots_beyond(poly: list[int], a: int, bits: int) -> int:
    """How many roots exceed a / 2 ** bits, for a polynomial with real roots only:
    the sign changes of the polynomial shifted there."""
    c = [v << (bits * k) for k, v in enumerate(poly)]
    d = len(c) - 1
    for end in range(d, 0, -1):             # Taylor shift by repeated division
        for k in range(1, end + 1):
            c[k] += a * c[k - 1]
    signs = [v > 0 for v in c if v]
    return sum(x != y for x, y in zip(signs, signs[1:]))


def _sign(poly: list[int], a: int, bits: int) -> int:
    value = 0
    for k, v in enumerate(poly):
        value = value * a + (v << (bits * k))
    return (value > 0) - (value < 0)


def largest_roots(poly: list[int], wanted: int, root_bits: int = ROOT_BITS) -> list[tuple[int, int, int]]:
    """``(numerator, bits, multiplicity)`` of the largest positive roots, each
    numerator / 2 ** bits with ``root_bits`` bits; roots that agree in
    ``ALIKE_BITS`` bits come once, with their number as multiplicity.  Stops
    when the multiplicities reach ``wanted`` or the positive roots end."""
    d = len(poly) - 1
    while poly and not poly[-1]:
        poly = poly[:-1]                    # roots at zero
    positive, out, seen = len(poly) - 1, [], 0
    if d < 1 or positive < 1:
        return out
    # no root exceeds the sum of all; a coarse power of two for it
    top = 1 << (int(-poly[1]).bit_length() + 1)
    while seen < min(wanted, positive):
        # the root with ``seen`` others before it lies in (lo, hi] / 2 ** bits
        lo, hi, bits, single = 0, top, 0, False
        while True:
            if hi - lo == 1:
                if lo.bit_length() >= root_bits:
                    break
                lo, hi, bits = lo * 2, hi * 2, bits + 1
                continue
            mid = (lo + hi) // 2
            if single:                      # one root inside: the sign tells its side
                beyond = _sign(poly, mid, bits) * side < 0
            else:
                beyond = roots_beyond(poly, mid, bits) > seen
            lo, hi = (mid, hi) if beyond else (lo, mid)
            if not single and lo.bit_length() > 2 and (
                    roots_beyond(poly, lo, bits) == seen + 1 and roots_beyond(poly, hi, bits) == seen):
                side = _sign(poly, hi, bits)
                single = side != 0
        slack = hi >> ALIKE_BITS
        times = roots_beyond(poly, lo - slack, bits) - seen
        out.append((hi, bits, times))
        seen += times
    return out


# --- components --------------------------------------------------------------------

def _solver(matrix: list[list[Decimal]], tiny: Decimal):
    """Factorise once (partial pivoting); returns a solver of matrix * x = b."""
    a, d = [row[:] for row in matrix], len(matrix)
    order = list(range(d))
    for k in range(d):
        q = max(range(k, d), key=lambda r: abs(a[r][k]))
        a[k], a[q], order[k], order[q] = a[q], a[k], order[q], order[k]
        if not a[k][k]:
            a[k][k] = tiny                  # singular as it should be
        top = a[k]
        for r in range(k + 1, d):
            if a[r][k]:
                f = a[r][k] / top[k]
                a[r] = [*a[r][:k], f, *[x - f * y for x, y in zip(a[r][k + 1:], top[k + 1:])]]

    def solve(b: list[Decimal]) -> list[Decimal]:
        x = [b[i] for i in order]
        for r in range(d):
            x[r] -= sum((a[r][k] * x[k] for k in range(r)), Decimal(0))
        for r in range(d - 1, -1, -1):
            x[r] = (x[r] - sum((a[r][k] * x[k] for k in range(r + 1, d)), Decimal(0))) / a[r][r]
        return x

    return solve


def _unit(x: list[Decimal], others: list[list[Decimal]]) -> list[Decimal]:
    """``x`` of length 1 and at right angles to ``others``."""
    for _ in range(2):
        for o in others:
            along = sum((p * q for p, q in zip(x, o)), Decimal(0))
            x = [p - along * q for p, q in zip(x, o)]
    length = sum((p * p for p in x), Decimal(0)).sqrt()
    return [p / length for p in x]


def null_space(matrix: np.ndarray, root: Decimal, wanted: int, before: list[list[Decimal]]) -> list[list[Decimal]]:
    """``wanted`` unit vectors that ``matrix - root`` all but annuls, at right
    angles to each other and to ``before``."""
    d, rng = len(matrix), random.Random(len(before))
    shifted = [[Decimal(int(matrix[i, j])) - (root if i == j else 0) for j in range(d)] for i in range(d)]
    solve = _solver(shifted, root.scaleb(-DIGITS))
    out: list[list[Decimal]] = []
    for _ in range(wanted):
        x = _unit([Decimal(rng.randrange(1, 1 << 20)) for _ in range(d)], before + out)
        for _ in range(3):
            x = _unit(solve(x), before + out)
        out.append(x)
    return out


def components(matrix: np.ndarray, poly: list[int], wanted: int = COMPONENTS) -> list[tuple[Decimal, list[Decimal]]]:
    """Largest positive eigenvalues of the integer matrix with their unit
    eigenvectors (the largest entry is positive), to double precision and beyond."""
    size = max((len(str(abs(int(v)))) for v in poly[1:2]), default=1)
    out: list[tuple[Decimal, list[Decimal]]] = []
    with localcontext(Context(prec=DIGITS + 2 * size)):
        for numerator, bits, times in largest_roots(poly, wanted):
            root = Decimal(numerator) / Decimal(1 << bits)
            take = min(times, wanted - len(out))
            for x in null_space(matrix, root, take, [v for _, v in out]):
                largest = max(x, key=abs)
                out.append((root, [-p for p in x] if largest < 0 else x))
    return out


# --- Spark -------------------------------------------------------------------------

def _usable(b: pa.RecordBatch, at: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, vectors as integers) of the usable vectors of a batch, by length:
    not null, not empty, all entries finite."""
    column = b.column(at)
    there = np.flatnonzero(~np.asarray(column.is_null()))
    size = column.value_lengths().to_numpy(zero_copy_only=False)[there].astype("i8")
    flat = column.flatten().to_numpy(zero_copy_only=False).astype("f8")   # a null entry is not a number
    start = np.concatenate([[0], np.cumsum(size)])[:-1].astype("i8")
    for n in np.unique(size[size > 0]).tolist():
        of = size == n
        v = flat[start[of][:, None] + np.arange(n)]
        fine = np.isfinite(v).all(1)
        if fine.any():
            yield there[of][fine], whole_numbers(v[fine])


def distinct_vectors(vectors: DataFrame) -> DataFrame:
    """``x, dim, rows``: every distinct integer vector, packed, with its number of rows."""
    def run(it):
        for b in it:
            for _, x in _usable(b, 0):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([pack_row(r) for r in x], pa.binary()), pa.array(np.full(len(x), x.shape[1]), pa.int32())],
                    ["x", "dim"])

    return (vectors.select(F.col("embedding").cast("array<double>")).mapInArrow(run, "x binary, dim int")
            .groupBy("x", "dim").agg(F.count(F.lit(1)).alias("rows")))


def exact_sums(distinct: DataFrame, dim: int) -> tuple[int, list[int], np.ndarray]:
    """n, S and sum(x x^T) over the vectors of length ``dim``, without rounding."""
    kind = "i int, part int, n long, s string, cells array<string>"
    fields = pa.schema([("i", pa.int32()), ("part", pa.int32()), ("n", pa.int64()), ("s", pa.string()),
                        ("cells", pa.list_(pa.string()))])

    def run(it):
        n, total, gram = 0, np.zeros(dim, object), np.zeros((dim, dim), object)
        for b in it:
            x = np.array([unpack_row(r) for r in b.column(0).to_pylist()], "i8").reshape(-1, dim)
            n += len(x)
            gram += gram_matrix(x)
            # in halves, whose sums fit
            total += (x >> 32).sum(0).astype(object) * (1 << 32) + (x & 0xFFFFFFFF).sum(0).astype(object)
        group = TaskContext.get().partitionId() % TASK_GROUPS
        yield pa.RecordBatch.from_pydict({
            "i": np.arange(dim), "part": [group] * dim, "n": [n] * dim, "s": [str(v) for v in total],
            "cells": [[str(v) for v in row] for row in gram]}, schema=fields)

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        cells = [sum(map(int, column)) for column in zip(*rows["cells"])]
        return pd.DataFrame({"i": rows["i"][:1], "part": 0, "n": int(rows["n"].sum()),
                             "s": str(sum(map(int, rows["s"]))), "cells": [[str(v) for v in cells]]})

    parts = distinct.where(F.col("dim") == dim).select("x").mapInArrow(run, kind)
    rows = parts.groupBy("i", "part").applyInPandas(add, kind).groupBy("i").applyInPandas(add, kind).collect()
    rows.sort(key=lambda r: r["i"])  # one row per dimension
    return rows[0]["n"], [int(r["s"]) for r in rows], np.array([[int(v) for v in r["cells"]] for r in rows], object)


def characteristic_polynomial(spark: SparkSession, matrix: np.ndarray) -> list[int]:
    """Coefficients of det(t - matrix), highest first, for an integer matrix
    with no negative eigenvalue; one task per few primes."""
    primes = primes_beyond(2 * coefficient_bound(matrix))
    sent = spark.sparkContext.broadcast((matrix, primes))  # dimension squared numbers

    def run(it):
        for b in it:
            whole, ps = sent.value
            for at in b.column(0).to_pylist():
                c = polynomial_mod((whole % ps[at]).astype("i8"), ps[at])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(len(c)), pa.int32()), pa.array(np.full(len(c), at), pa.int32()), pa.array(c)],
                    ["k", "at", "residue"])

    def join(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("at")
        value = remainder_join(rows["residue"].tolist(), [sent.value[1][a] for a in rows["at"]])
        return pd.DataFrame({"k": rows["k"][:1], "value": str(value)})

    tasks = max(1, min(len(primes), spark.sparkContext.defaultParallelism))
    found = (spark.range(0, len(primes), 1, tasks).mapInArrow(run, "k int, at int, residue long")
             .groupBy("k").applyInPandas(join, "k int, value string").collect())
    sent.unpersist()
    return [int(r["value"]) for r in sorted(found, key=lambda r: r["k"])]


def whiten(spark: SparkSession, vectors: DataFrame, wanted: int = COMPONENTS) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error,
    deviation_text`` per usable row and component (from 1, by falling eigenvalue).

    Rows take no part if their vector is null, empty, holds a null or
    non-finite entry, or has another length than most distinct vectors (ties:
    the shorter length).  Null ids and repeated rows each give their rows;
    equal vectors count once in the fit and have equal results.  Components
    with eigenvalue zero are left out, so there are fewer than ``wanted`` where
    the distinct vectors span less, and none for an empty table or a single
    vector.  Components of equal eigenvalues are some orthonormal basis of
    their space.  Entries beyond 64 bits stop at their end.  ``deviation`` is
    null where it exceeds a long; ``deviation_text`` then holds it in digits.
    """
    tune(spark)
    result = ("vec_id long, component int, n long, deviation long, whitened double, explained double, "
              "identity_error double, deviation_text string")
    distinct = stored(spark, distinct_vectors(vectors), "distinct-vectors")
    sizes = distinct.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dim").first()
    if sizes is None:
        return spark.createDataFrame([], result)
    dim = sizes["dim"]
    n, total, gram = exact_sums(distinct, dim)
    matrix = scatter(n, total, gram)
    trace = sum(int(matrix[i, i]) for i in range(dim))
    found = components(matrix, characteristic_polynomial(spark, matrix), wanted) if trace else []
    if not found:
        return spark.createDataFrame([], result)
    with localcontext(Context(prec=DIGITS)):
        # (x - S / n) / sqrt(eigenvalue / n ** 2) is (n * x - S) / sqrt(eigenvalue)
        project = np.array([[float(p / root.sqrt()) for p in v] for root, v in found]).T
        explained = [float(root / trace) for root, _ in found]
    sent = spark.sparkContext.broadcast((n, np.array(total, object), project))  # dimension times components

    def centred(x: np.ndarray) -> np.ndarray:
        """n * x - S, without rounding."""
        k, s, _ = sent.value
        largest = int(np.abs(x.astype("f8")).max()) + 1 if x.size else 0
        if k * largest + max(map(abs, s)) < 1 << 62:
            return x * k - s.astype("i8")
        return x.astype(object) * k - s

    m = len(found)
    upper = [(i, j) for i in range(m) for j in range(i, m)]

    def moments(it):
        sums = np.zeros(m + len(upper))
        for b in it:
            x = np.array([unpack_row(r) for r in b.column(0).to_pylist()], "i8").reshape(-1, dim)
            y = centred(x).astype("f8") @ sent.value[2]
            sums += np.concatenate([y.sum(0), [(y[:, i] * y[:, j]).sum() for i, j in upper]])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(sums)), pa.int32()), pa.array(sums)], ["at", "sum"])

    rows = (distinct.where(F.col("dim") == dim).select("x").mapInArrow(moments, "at int, sum double")
            .groupBy("at").agg(F.sum("sum").alias("sum")).collect())
    means = {r["at"]: r["sum"] / n for r in rows}
    error = max(abs(means[m + k] - means[i] * means[j] - (i == j)) for k, (i, j) in enumerate(upper))

    def apply(it):
        for b in it:
            for at, x in _usable(b, 1):
                if x.shape[1] != dim:
                    continue
                c = centred(x)
                y = c.astype("f8") @ sent.value[2]
                if c.dtype == object or (c.astype("f8") ** 2).sum(1).max() >= float(1 << 62):
                    exact = [sum(int(v) ** 2 for v in r) for r in c]
                else:
                    exact = (c * c).sum(1).tolist()
                fits = [v if v < _LONG else None for v in exact]
                text = [None if v < _LONG else str(v) for v in exact]
                ids = b.column(0).take(pa.array(at))
                for k in range(m):
                    yield pa.RecordBatch.from_arrays(
                        [ids, pa.array(np.full(len(at), k + 1), pa.int32()), pa.array(np.full(len(at), n), pa.int64()),
                         pa.array(fits, pa.int64()), pa.array(y[:, k]), pa.array(np.full(len(at), explained[k])),
                         pa.array(np.full(len(at), error)), pa.array(text, pa.string())],
                        ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error",
                         "deviation_text"])

    return vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).mapInArrow(apply, result)
