"""Embedding whitening from an exact characteristic polynomial.

Vectors become integers, so the scatter ``M = n * sum(x x') - S S'`` (n squared times the
covariance) is an integer matrix and is summed exactly by Spark tasks. Its characteristic
polynomial comes from residues: for each of a list of primes one Spark task brings M to
Hessenberg form modulo the prime and reads off the polynomial; Chinese remaindering gives
the integer coefficients. All roots are real, so the sign changes of the shifted
polynomial count the roots above any point exactly (Descartes), and bisection isolates the
largest ones as narrowly as wanted. Each component is then the null vector of ``M - root``,
by inverse iteration in long decimals, one Spark task per cluster of roots.

What reaches the driver is bounded by the dimension: the scatter's entries, one residue row
per prime, and the components.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from decimal import Context, Decimal, localcontext

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from quayside.session import stage

_LIMB = 20          # bits of a limb: limb products of a block of rows add up exactly in a double
_BLOCK = 4096
_LOW = 1 << 60


# -- integers from vectors ----------------------------------------------------------------


def quantised(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """key and ``x``, each entry c of the vector as the long floor(scale * c).

    Rows whose vector is null, empty, or holds null or non-finite entries are left out.
    Entries beyond the range of a long stop at its ends. Of vectors of several lengths only
    those of the most frequent length take part (of equals the longer).
    """
    c = F.transform(F.col(vector), lambda v: v.cast("double"))
    src = vectors.select(F.col(key).alias("k"), c.alias("c")).where(F.size("c") > 0)
    src = src.where(~F.exists("c", lambda v: F.coalesce(F.isnan(v) | (F.abs(v) == float("inf")), F.lit(True))))
    top = float((1 << 63) - 1024)  # the largest double below 2^63
    as_long = lambda v: F.floor(F.greatest(F.lit(-float(1 << 63)), F.least(F.lit(top), v * F.lit(float(scale))))).cast("long")
    src = stage(src.select("k", F.transform("c", as_long).alias("x")), "quantised")
    best = src.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    return src.where(F.size("x") == F.lit(best[0]["d"] if best else 0)).withColumnRenamed("k", key)


def _limbs(x: np.ndarray) -> list[np.ndarray]:
    """Limbs of 20 bits, lowest first, as doubles; the last one is signed."""
    out = []
    while len(x) and (x.min() < -(1 << _LIMB) or x.max() >= 1 << _LIMB):
        out.append((x & ((1 << _LIMB) - 1)).astype(np.float64))
        x = x >> _LIMB
    return [*out, x.astype(np.float64)]


def _add_block(total: list, sums: list, x: np.ndarray) -> None:
    parts = _limbs(x)
    for a, p in enumerate(parts):
        s = p.sum(0)
        for i in range(len(s)):
            sums[i] += int(s[i]) << (_LIMB * a)
        for b, q in enumerate(parts):
            m = p.T @ q
            for i in range(len(m)):
                row = total[i]
                for j in range(i + 1):
                    row[j] += int(m[i, j]) << (_LIMB * (a + b))


def scatter(fit: DataFrame, dim: int, x: str = "x") -> tuple[int, list[int], list[list[int]]]:
    """(n, S, M) of a list of integer vectors: the number of rows, the sums, and the exact
    ``n * sum(x x') - S S'``. Tasks reduce their rows to one partial matrix each, Spark adds
    the partials; (dim + 1)(dim + 2) / 2 sums reach the driver."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, sums, n = [[0] * dim for _ in range(dim)], [0] * dim, 0
        for batch in batches:
            flat = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            for at in range(0, len(flat), _BLOCK):
                _add_block(total, sums, flat[at:at + _BLOCK].astype(np.int64))
            n += len(flat)
        if n:
            cells = [(i, j, total[i][j]) for i in range(dim) for j in range(i + 1)] + [(dim, j, sums[j]) for j in range(dim)] + [(dim, dim, n)]
            i, j, v = zip(*cells)
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array([Decimal(a >> 60) for a in v], pa.decimal128(38, 0)),
                                              pa.array([a & (_LOW - 1) for a in v], pa.int64())], ["i", "j", "high", "low"])

    parts = fit.select(x).mapInArrow(run, "i int, j int, high decimal(38,0), low long")
    rows = parts.groupBy("i", "j").agg(F.sum("high").alias("high"), F.sum(F.col("low").cast("decimal(38,0)")).alias("low")).collect()
    cell = {(r.i, r.j): (int(r.high) << 60) + int(r.low) for r in rows}
    n = cell.get((dim, dim), 0)
    s = [cell.get((dim, j), 0) for j in range(dim)]
    get = lambda i, j: cell.get((max(i, j), min(i, j)), 0)
    return n, s, [[n * get(i, j) - s[i] * s[j] for j in range(dim)] for i in range(dim)]


# -- the characteristic polynomial ---------------------------------------------------------


def primes_below(top: int, count: int) -> list[int]:
    """The ``count`` largest primes below ``top`` (at most 2^31)."""
    small = np.ones(1 << 16, bool)
    small[:2] = False
    for q in range(2, 256):
        if small[q]:
            small[q * q::q] = False
    tests = np.flatnonzero(small)
    out, p = [], top - 1 | 1
    while len(out) < count:
        p -= 2
        q = tests[tests.astype(np.int64) ** 2 <= p]
        if (p % q).all():
            out.append(p)
    return out


def polynomial_mod(matrix: np.ndarray, p: int) -> list[int]:
    """Coefficients of det(t - matrix) modulo the prime p < 2^31, constant first.

    Similar row and column steps bring the matrix to Hessenberg form; the polynomials of
    its leading blocks follow by the usual recurrence.
    """
    a = matrix % p
    d = len(a)
    for k in range(1, d - 1):
        rows = np.flatnonzero(a[k:, k - 1])
        if not len(rows):
            continue
        r = k + int(rows[0])
        if r != k:
            a[[k, r]] = a[[r, k]]
            a[:, [k, r]] = a[:, [r, k]]
        f = a[k + 1:, k - 1] * pow(int(a[k, k - 1]), -1, p) % p
        a[k + 1:] = (a[k + 1:] - f[:, None] * a[k] % p) % p
        add = np.zeros(d, np.int64)
        for part in range(0, len(f)):  # a sum of products stays below 2^63 only if reduced one by one
            if f[part]:
                add = (add + f[part] * a[:, k + 1 + part]) % p
        a[:, k] = (a[:, k] + add) % p
    polys = np.zeros((d + 1, d + 1), np.int64)
    polys[0, 0] = 1
    for m in range(1, d + 1):
        q = np.zeros(d + 1, np.int64)
        q[1:] = polys[m - 1, :-1]
        q = (q - a[m - 1, m - 1] * polys[m - 1]) % p
        chain = 1
        for i in range(m - 1, 0, -1):
            chain = chain * int(a[i, i - 1]) % p
            if not chain:
                break
            q = (q - (int(a[i - 1, m - 1]) * chain % p) * polys[i - 1]) % p
        polys[m] = q
    return polys[d].tolist()


def characteristic_polynomial(spark: SparkSession, matrix: list[list[int]]) -> list[int]:
    """Integer coefficients of det(t - matrix), constant first, of a positive semidefinite
    integer matrix. One Spark task row per prime; the number of primes follows from
    Maclaurin's bound on the coefficients, so the result is certain."""
    d = len(matrix)
    trace = sum(matrix[i][i] for i in range(d))
    # |coefficient of t^(d-k)| = e_k(roots) <= C(d, k) (trace / d)^k
    bound = max(math.comb(d, k) * trace ** k // d ** k + 1 for k in range(d + 1))
    primes = primes_below(1 << 31, bound.bit_length() // 30 + 2)
    wide = [[str(v) for v in row] for row in matrix]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = [[int(v) for v in row] for row in wide]
        for batch in batches:
            ps = batch.column(0).to_pylist()
            got = [polynomial_mod(np.array([[v % p for v in row] for row in whole], np.int64), p) for p in ps]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.list_(pa.int64()))], ["p", "c"])

    tasks = max(1, min(len(primes) // 4, 64))
    found = spark.createDataFrame([(p,) for p in primes], "p long").repartition(tasks).mapInArrow(run, "p long, c array<long>").collect()
    product = math.prod(primes)
    out = [0] * (d + 1)
    for r in found:
        rest = product // r.p
        w = rest * pow(rest, -1, r.p)
        for i, c in enumerate(r.c):
            out[i] += c * w
    return [c - product if c > product // 2 else c for c in (c % product for c in out)]


def roots_above(poly: list[int], a: int, shift: int) -> int:
    """Number of roots (with multiplicity) above a / 2^shift of a polynomial with real roots
    only: the sign changes of poly(t + a / 2^shift)."""
    d = len(poly) - 1
    c = [v << (shift * (d - i)) for i, v in enumerate(poly)]  # of the polynomial with roots times 2^shift
    for i in range(d):
        for j in range(d - 1, i - 1, -1):
            c[j] += a * c[j + 1]
    signs = [v > 0 for v in c if v]
    return sum(x != y for x, y in zip(signs, signs[1:]))


def largest_roots(poly: list[int], count: int, bits: int = 110) -> list[tuple[int, int, int]]:
    """The largest positive roots as (a, shift, multiplicity): one or more roots lie in
    (a, a + 1] / 2^shift, an interval of at most 2^-bits of the root's size. As many
    clusters as hold ``count`` roots, or all positive ones; largest first."""
    d = len(poly) - 1
    top = max([1, -poly[d - 1]])  # the trace bounds every root
    positive = roots_above(poly, 0, 0)
    out, taken = [], 0
    while taken < min(count, positive):
        # the next root is where the count of roots above falls to ``taken``
        low, high, shift, above_low, above_high = 0, top, 0, positive, taken
        while True:
            if high - low == 1:
                if low.bit_length() > bits or shift > 4 * bits:
                    break
                low, high, shift = 2 * low, 2 * high, shift + 1
                continue
            mid = (low + high) // 2
            n = roots_above(poly, mid, shift)
            if n > taken:
                low, above_low = mid, n
            else:
                high, above_high = mid, n
        out.append((low, shift, above_low - taken))
        taken = above_low
    return out


# -- components ----------------------------------------------------------------------------


def null_space(matrix: list[list[int]], a: int, shift: int, dim: int, digits: int) -> list[list[Decimal]]:
    """Orthonormal null vectors of matrix - (a + 1/2) / 2^shift by inverse iteration."""
    d = len(matrix)
    with localcontext(Context(prec=digits)):
        root = (Decimal(2 * a + 1)) / (Decimal(2) ** (shift + 1))
        lu = [[Decimal(v) for v in row] for row in matrix]
        for i in range(d):
            lu[i][i] -= root
        order = list(range(d))
        tiny = max(abs(v) for row in lu for v in row) * Decimal(10) ** -(digits - 5) or Decimal(1)
        for k in range(d):
            r = max(range(k, d), key=lambda i: abs(lu[i][k]))
            if r != k:
                lu[k], lu[r], order[k], order[r] = lu[r], lu[k], order[r], order[k]
            pivot, head = lu[k][k] or tiny, lu[k]
            head[k] = pivot
            for i in range(k + 1, d):
                row = lu[i]
                f = row[k] = row[k] / pivot
                if f:
                    for j in range(k + 1, d):
                        row[j] -= f * head[j]

        def solve(b: list[Decimal]) -> list[Decimal]:
            y = [b[i] for i in order]
            for i in range(d):
                y[i] -= sum((lu[i][j] * y[j] for j in range(i)), Decimal(0))
            for i in range(d - 1, -1, -1):
                y[i] = (y[i] - sum((lu[i][j] * y[j] for j in range(i + 1, d)), Decimal(0))) / lu[i][i]
            return y

        # fixed starting vectors without structure
        basis = [[Decimal(int(v)) for v in np.random.default_rng([7, m]).integers(1, 1 << 30, d)] for m in range(dim)]
        for _ in range(3):
            done: list[list[Decimal]] = []
            for v in basis:
                v = solve(v)
                for _ in range(2):
                    for u in done:
                        dot = sum((x * y for x, y in zip(u, v)), Decimal(0))
                        v = [y - dot * x for x, y in zip(u, v)]
                    size = sum((x * x for x in v), Decimal(0)).sqrt()
                    v = [x / size for x in v]
                done.append(v)
            basis = done
        return basis


def components(spark: SparkSession, matrix: list[list[int]], clusters: list[tuple[int, int, int]], count: int) -> list[list[float]]:
    """The first ``count`` unit eigenvectors, as doubles; one Spark task row per cluster of roots."""
    wide = [[str(v) for v in row] for row in matrix]
    size = max(len(str(matrix[i][i])) for i in range(len(matrix)))
    digits = 2 * max([size, *(len(str(a)) for a, _, _ in clusters)]) + 40
    work = [(i, str(a), s, m) for i, (a, s, m) in enumerate(clusters)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = [[int(v) for v in row] for row in wide]
        for batch in batches:
            for r in batch.to_pylist():
                vs = null_space(whole, int(r["a"]), r["s"], r["m"], digits)
                yield pa.RecordBatch.from_arrays([pa.array([r["i"]] * len(vs), pa.int32()), pa.array(range(len(vs)), pa.int32()),
                                                  pa.array([[float(x) for x in v] for v in vs], pa.list_(pa.float64()))], ["i", "m", "v"])

    df = spark.createDataFrame(work, "i int, a string, s int, m int").repartition(len(work), "i")
    return [r.v for r in sorted(df.mapInArrow(run, "i int, m int, v array<double>").collect(), key=lambda r: (r.i, r.m))][:count]


class Whitening:
    """A fitted whitening: ``n``, ``sums`` (per dimension), ``eigen`` (eigenvalues of the
    covariance, falling), ``vectors`` (unit components), ``explained`` and ``trace``."""

    def __init__(self, n, sums, eigen, vectors, explained, trace):
        self.n, self.sums, self.eigen, self.vectors, self.explained, self.trace = n, sums, eigen, vectors, explained, trace

    def transform(self, rows: DataFrame, key: str | None = "vec_id", x: str = "x") -> DataFrame:
        """key (if named), ``deviation`` (sum over dimensions of (n x - S)^2, null beyond a
        long) and ``w``, the projections over the roots of the eigenvalues."""
        n, sums = self.n, self.sums
        basis = np.array(self.vectors).reshape(len(self.vectors), len(sums)).T / (n * np.sqrt(np.array(self.eigen)))
        typed = {"k": rows.schema[key].dataType} if key else {}
        schema = T.StructType([*(T.StructField(c, t) for c, t in typed.items()), T.StructField("deviation", T.LongType()), T.StructField("w", T.ArrayType(T.DoubleType()))])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            far = max([1, *map(abs, sums)])
            for batch in batches:
                v = batch.column(0)
                flat = v.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(sums)).astype(np.int64)
                most = n * int(max(abs(int(flat.max(initial=0))), abs(int(flat.min(initial=0))))) + far
                if most * most * len(sums) < 1 << 62:
                    centred = flat * n - np.array(sums, np.int64)
                    dev = (centred * centred).sum(1).tolist()
                else:  # beyond 64 bits: whole numbers of any size
                    centred = flat.astype(object) * n - np.array(sums, object)
                    dev = [a if a < 1 << 63 else None for a in (centred * centred).sum(1).tolist()]
                w = centred.astype(np.float64) @ basis
                yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(dev, pa.int64()), pa.array(list(w), pa.list_(pa.float64()))], schema.names)

        return rows.select(x, *([F.col(key).alias("k")] if key else [])).mapInArrow(run, schema)


def fit_whitening(rows: DataFrame, count: int = 4, x: str = "x") -> tuple[Whitening, DataFrame] | None:
    """Fit on each distinct vector of ``rows`` once; None if there is none. Also returns the
    fit list. Components of eigenvalue zero are left out, so there may be fewer than
    ``count``. Components whose eigenvalues agree to 33 digits share one null space, whose
    orthonormal basis is then as good as any other and the same on every run."""
    spark = rows.sparkSession
    fit = stage(rows.select(x).distinct(), "fit-list")
    head = fit.limit(1).collect()
    if not head:
        return None
    dim = len(head[0][0])
    n, sums, matrix = scatter(fit, dim, x)
    trace = sum(matrix[i][i] for i in range(dim))
    if not trace:
        return Whitening(n, sums, [], [], [], 0.0), fit
    poly = characteristic_polynomial(spark, matrix)
    clusters = largest_roots(poly, count)
    vectors = components(spark, matrix, clusters, count)
    with localcontext(Context(prec=60)):
        roots = [Decimal(2 * a + 1) / Decimal(2) ** (s + 1) for a, s, m in clusters for _ in range(m)][:count]
        eigen = [float(r / n / n) for r in roots]
        explained = [float(r / trace) for r in roots]
    return Whitening(n, sums, eigen, vectors, explained, float(Decimal(trace) / n / n)), fit


def identity_error(model: Whitening, fit: DataFrame) -> float:
    """Largest absolute entry of the whitened fit list's covariance minus the identity; the
    products are summed by Spark."""
    k = len(model.vectors)
    if not k:
        return 0.0
    w = model.transform(fit, None)
    pairs = [(i, j) for i in range(k) for j in range(i + 1)]
    at = lambda i: F.element_at("w", i + 1)
    r = w.agg(*(F.avg(at(i)).alias(f"m{i}") for i in range(k)), *(F.avg(at(i) * at(j)).alias(f"c{i}_{j}") for i, j in pairs)).first()
    return max(abs(r[f"c{i}_{j}"] - r[f"m{i}"] * r[f"m{j}"] - (i == j)) for i, j in pairs)


WHITENED = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, count: int = 4, key: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """Per usable row (see :func:`quantised`) and component: key, component (from 1), n,
    deviation, whitened, explained, identity_error.

    Repeated rows, and rows with equal vectors, are transformed each but fitted once. Null
    keys are kept. If all vectors are equal there is no component and the result is empty,
    as it is for an empty table. ``deviation`` is null where it is beyond a long.
    """
    rows = quantised(vectors, key, vector, scale)
    fitted = fit_whitening(rows, count)
    kind = rows.schema[key].dataType.simpleString()
    if fitted is None or not fitted[0].vectors:
        return rows.sparkSession.createDataFrame([], f"`{key}` {kind}, {WHITENED}")
    model, fit = fitted
    error = identity_error(model, fit)
    out = model.transform(rows, key).select("k", "deviation", F.posexplode("w").alias("c", "whitened"))
    shares = F.array(*map(F.lit, model.explained))
    return out.select(F.col("k").alias(key), (F.col("c") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
                      F.get(shares, F.col("c")).alias("explained"), F.lit(error).alias("identity_error"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All usable embeddings whitened on their first four components."""
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
