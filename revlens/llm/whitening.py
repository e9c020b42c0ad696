"""Embedding whitening from the exact characteristic polynomial.

Entries become integers, so the scatter matrix is an integer matrix and
nothing is rounded before the eigenvalues are known:

1. Every task sums its part of the fit list (each distinct integer vector
   once), centred at the rounded means, into integer sums and cross sums;
   the sums of the tasks meet as (cell, digit) rows.
2. ``n^2`` times the covariance is an integer matrix M.  Its characteristic
   polynomial is found modulo many 31-bit primes, one prime per row of a
   Spark job, each by reduction to Hessenberg form; Chinese remaindering
   gives the integer coefficients.  The primes' product exceeds twice the
   largest possible coefficient (Maclaurin's bound from the trace).
3. All roots are real, so the sign changes of the polynomial shifted to a
   count exactly the roots above a, each as often as it repeats.  Bisection
   on these counts isolates the largest roots.
4. One task per root refines its interval by exact signs and finds the null
   space of M - root by inverse iteration in long decimals: as many start
   vectors as the root repeats, kept orthogonal.
5. Rows are centred and projected map-side.

The driver holds numbers that depend on the dimension only.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from decimal import Decimal, localcontext
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revlens.llm.common import stored
from revlens.llm.vectors import matrix, usable

#: Integer entries: floor(SCALE * c) + OFFSET; products beyond +-LIMIT count as +-LIMIT.
SCALE, OFFSET, LIMIT = 64, 1_000_000, 2.0 ** 56
#: Bits of a digit in which integer sums travel between tasks.
DIGIT = 32
#: Roots closer than this many bits below the trace count as one repeated root.
CLOSE_BITS = 256


def integer_entries(rows: DataFrame) -> DataFrame:
    """(id, x): ``v`` as long integers."""
    def entry(e):
        return F.floor(F.greatest(F.least(e.cast("double") * SCALE, F.lit(LIMIT)), F.lit(-LIMIT))).cast("long") + F.lit(OFFSET)
    return rows.select("id", F.transform("v", entry).alias("x"))


def _digits(cells: np.ndarray) -> tuple[list, list, list]:
    """Integers of any size as (cell, place, digit) columns, the sign on every digit."""
    at, place, digit = [], [], []
    for i, v in enumerate(cells):
        sign, v, k = (-1 if v < 0 else 1), abs(int(v)), 0
        while v:
            if v & ((1 << DIGIT) - 1):
                at.append(i)
                place.append(k)
                digit.append(sign * (v & ((1 << DIGIT) - 1)))
            v, k = v >> DIGIT, k + 1
    return at, place, digit


def exact_sums(fit: DataFrame, cells: int, part) -> list[int]:
    """Sums over all rows of the integers that ``part`` makes of a batch (an object array of ``cells``)."""
    def run(batches):
        total = np.zeros(cells, object)
        for b in batches:
            if b.num_rows:
                total = total + part(matrix(b.column(0), np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in _digits(total)], names=["cell", "place", "digit"])

    out = [0] * cells
    sums = fit.select("x").mapInArrow(run, "cell long, place long, digit long").groupBy("cell", "place").agg(F.sum(F.col("digit").cast("decimal(38,0)")).alias("s"))
    for r in sums.collect():  # cells x places rows: the dimension bounds them
        out[r["cell"]] += int(r["s"]) << (DIGIT * r["place"])
    return out


def column_sums(x: np.ndarray) -> np.ndarray:
    """Exact column sums of 64-bit integers."""
    return (x >> 32).sum(axis=0).astype(object) * (1 << 32) + (x & 0xFFFFFFFF).sum(axis=0).astype(object)


def cross_sums(y: np.ndarray) -> np.ndarray:
    """Exact y'y (flat): one product in doubles where it is exact, else products of 18-bit pieces."""
    top = int(np.abs(y).max())
    if top * top * len(y) < 2 ** 53:
        f = y.astype(np.float64)
        return (f.T @ f).astype(np.int64).astype(object).ravel()
    total = np.zeros(y.shape[1] ** 2, object)
    for k in range(0, len(y), 1 << 16):
        part = y[k:k + (1 << 16)]
        pieces = [((part >> 18 * i) & 0x3FFFF).astype(np.float64) for i in range(3)]
        pieces.append((part >> 54).astype(np.float64))  # carries the sign
        for a, p in enumerate(pieces):
            for b, q in enumerate(pieces):
                total = total + (p.T @ q).astype(np.int64).astype(object).ravel() * (1 << (18 * (a + b)))
    return total


def _is_prime(n: int) -> bool:
    """Miller-Rabin with bases that are certain below 2^32."""
    d, s = n - 1, 0
    while d % 2 == 0:
        d, s = d // 2, s + 1
    for a in (2, 3, 5, 7):
        x = pow(a, d, n)
        if x in (1, n - 1):
            continue
        for _ in range(s - 1):
            x = x * x % n
            if x == n - 1:
                break
        else:
            return False
    return True


def primes(above: int) -> list[int]:
    """The largest primes below 2^31 whose product exceeds ``above``."""
    out, product, n = [], 1, (1 << 31) - 1
    while product <= above:
        if _is_prime(n):
            out.append(n)
            product *= n
        n -= 2
    return out


def polynomial_mod(a: np.ndarray, p: int) -> np.ndarray:
    """Characteristic polynomial of ``a`` (reduced mod the prime p), constant first, by Hessenberg form."""
    a, d = a.copy(), len(a)
    for m in range(1, d - 1):
        below = np.flatnonzero(a[m:, m - 1])
        if not len(below):
            continue
        at = m + below[0]
        if at != m:
            a[[m, at]] = a[[at, m]]
            a[:, [m, at]] = a[:, [at, m]]
        u = a[m + 1:, m - 1] * pow(int(a[m, m - 1]), -1, p) % p
        a[m + 1:] = (a[m + 1:] - u[:, None] * a[m] % p) % p
        a[:, m] = (a[:, m] + (a[:, m + 1:] * u % p).sum(axis=1)) % p
    f = [np.array([1], np.int64)]
    for m in range(d):
        g = np.zeros(m + 2, np.int64)
        g[1:] = f[m]
        g[:-1] = (g[:-1] - a[m, m] * f[m]) % p
        below = 1
        for i in range(m - 1, -1, -1):
            below = below * int(a[i + 1, i]) % p
            if not below:
                break
            g[:i + 1] = (g[:i + 1] - below * int(a[i, m]) % p * f[i]) % p
        f.append(g)
    return f[d]


def characteristic_polynomial(spark: SparkSession, m: list[list[int]]) -> list[int]:
    """Coefficients (constant first) of det(xI - m) of a positive semidefinite integer matrix."""
    d = len(m)
    trace = sum(m[i][i] for i in range(d))
    bound = max(comb(d, k) * (trace // d + 1) ** k for k in range(d + 1))
    moduli = primes(2 * bound + 1)

    def run(batches):
        for b in batches:
            rows = []
            for p in b.column(0).to_pylist():
                rows.append(polynomial_mod(np.array([[v % p for v in row] for row in m], np.int64), p).tolist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.list_(pa.int64()))], names=["p", "f"])

    tasks = max(1, min(len(moduli), spark.sparkContext.defaultParallelism))
    table = spark.createDataFrame([(p,) for p in moduli], "p long").repartition(tasks)
    found = table.mapInArrow(run, "p long, f array<long>").collect()
    product = 1
    for p in moduli:
        product *= p
    out = [0] * (d + 1)
    for r in found:
        rest = product // r["p"]
        part = rest * pow(rest, -1, r["p"])
        for i, c in enumerate(r["f"]):
            out[i] += c * part
    return [c % product - (product if 2 * (c % product) > product else 0) for c in out]


def _scaled(f: list[int], s: int) -> list[int]:
    """Coefficients of 2^(s deg f) f(x / 2^s)."""
    d = len(f) - 1
    return [c << (s * (d - i)) for i, c in enumerate(f)]


def roots_above(f: list[int], k: int, s: int) -> int:
    """How many roots of the real-rooted ``f`` exceed k / 2^s, repeated ones each time."""
    g = _scaled(f, s)
    for i in range(len(g) - 1):
        for j in range(len(g) - 2, i - 1, -1):
            g[j] += k * g[j + 1]
    signs = [c > 0 for c in g if c]
    return sum(a != b for a, b in zip(signs, signs[1:]))


def largest_roots(f: list[int], count: int) -> list[tuple[int, int, int, int]]:
    """(low, high, s, times), largest first: the roots in (low, high] / 2^s, until ``count`` positive roots are named."""
    f = f[next(i for i, c in enumerate(f) if c):]  # roots at zero
    if len(f) == 1:
        return []
    top = abs(f[-2]).bit_length() + 1  # the sum of the roots bounds each
    left, out, named = [(0, 1 << top, 0, len(f) - 1, 0)], [], 0
    while left and named < count:
        low, high, s, over_low, over_high = left.pop()
        times = over_low - over_high
        if not times:
            continue
        if times == 1 or (high - low == 1 and s >= CLOSE_BITS):
            out.append((low, high, s, times))
            named += times
            continue
        if high - low == 1:
            low, high, s = 2 * low, 2 * high, s + 1
        mid = (low + high) // 2
        over = roots_above(f, mid, s)
        left.append((low, mid, s, over_low, over))
        left.append((mid, high, s, over, over_high))
    return out


def refined(f: list[int], low: int, high: int, s: int, bits: int) -> tuple[int, int]:
    """(k, s): the single root of f in (low, high] / 2^s to ``bits`` binary places, by exact signs."""
    def sign(k, s):
        value = 0
        for i in range(len(f) - 1, -1, -1):
            value = value * k + (f[i] << (s * (len(f) - 1 - i)))
        return (value > 0) - (value < 0)

    at_high = sign(high, s)
    if not at_high:
        return high, s
    while high - low > 1 or s < bits:
        if high - low == 1:
            low, high, s = 2 * low, 2 * high, s + 1
        mid = (low + high) // 2
        here = sign(mid, s)
        if not here:
            return mid, s
        low, high = (low, mid) if here == at_high else (mid, high)
    return high, s


def null_space(m: list[list[int]], k: int, s: int, times: int, digits: int) -> np.ndarray:
    """Orthonormal rows spanning the null space of m - k/2^s: inverse iteration in decimals."""
    with localcontext() as context:
        context.prec, context.Emin, context.Emax = digits, -999999999, 999999999
        root, d = Decimal(k) / Decimal(1 << s), len(m)
        a = np.array([[Decimal(v) for v in row] for row in m], object)
        a[np.arange(d), np.arange(d)] -= root
        tiny = max((abs(v) for v in a.ravel()), default=Decimal(1)) or Decimal(1)
        tiny = tiny.scaleb(-digits + 6)
        order = np.arange(d)
        for i in range(d):
            at = i + max(range(d - i), key=lambda j: abs(a[i + j, i]))
            if at != i:
                a[[i, at]] = a[[at, i]]
                order[[i, at]] = order[[at, i]]
            if abs(a[i, i]) < tiny:
                a[i, i] = tiny
            a[i + 1:, i] = a[i + 1:, i] / a[i, i]
            a[i + 1:, i + 1:] = a[i + 1:, i + 1:] - np.outer(a[i + 1:, i], a[i, i + 1:])
        found = []
        for t in range(times):
            x = np.array([Decimal((i * i * 7919 + 104729 * (t + 1) * (i + 1)) % 1009 + 1) for i in range(d)], object)
            for _ in range(3):
                for y in found:
                    x = x - y * (x * y).sum()
                x = x[order]
                for i in range(d):
                    x[i] = x[i] - (a[i, :i] * x[:i]).sum() if i else x[i]
                for i in range(d - 1, -1, -1):
                    x[i] = (x[i] - (a[i, i + 1:] * x[i + 1:]).sum()) / a[i, i] if i < d - 1 else x[i] / a[i, i]
                for y in found:
                    x = x - y * (x * y).sum()
                x = x / (x * x).sum().sqrt()
            found.append(x)
        out = np.array([[float(v) for v in x] for x in found])
    sign = np.sign(out[np.arange(times), np.abs(out).argmax(axis=1)])
    return out * sign[:, None]


def components(spark: SparkSession, m: list[list[int]], count: int) -> list[tuple[float, list[float]]]:
    """(share of the trace, unit eigenvector) of the ``count`` largest positive eigenvalues, largest first."""
    f = characteristic_polynomial(spark, m)
    trace = sum(m[i][i] for i in range(len(m)))
    found = largest_roots(f, count)
    if not found:
        return []

    def run(batches):
        for b in batches:
            rows = []
            for at, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                low, high, s, times = json.loads(text)
                bits = 2 * s + CLOSE_BITS
                k, s = refined(f, low, high, s, bits) if times == 1 else (high, s)
                digits = int(0.302 * (trace.bit_length() + bits)) + 40
                share = float(Decimal(k) / Decimal(1 << s) / Decimal(trace))
                rows.extend((at, share, v) for v in null_space(m, k, s, times, digits).tolist())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(
                (pa.int64(), pa.float64(), pa.list_(pa.float64())))], names=["at", "share", "vector"])

    jobs = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(found)], "at long, root string").repartition(len(found))
    rows = jobs.mapInArrow(run, "at long, share double, vector array<double>").collect()
    return [(r["share"], list(r["vector"])) for r in sorted(rows, key=lambda r: r["at"])][:count]


def _projection(mean: list[int], rest: list[int], n: int, axes: np.ndarray, scale: np.ndarray):
    """x -> whitened coordinates; the mean is ``mean + rest / n``."""
    near, off = np.array(mean, np.int64), np.array([r / n for r in rest])

    def project(x):
        return ((x - near).astype(np.float64) - off) @ axes.T / scale
    return project


def whiten(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", count: int = 16) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error): ``count`` rows (fewer where the
    covariance has fewer positive eigenvalues) for every row with a usable vector.

    Rows whose vector is null, empty, or holds a null or non-finite entry, or has another length than most, are dropped.
    Repeated rows get equal results and count once in the fit; null ids stay.
    A deviation beyond a long is null.  Other columns are ignored.  An empty
    table, or one whose vectors are all equal, gives no rows.  Components of
    a repeated eigenvalue are an orthonormal basis of its space."""
    spark = df.sparkSession
    rows = stored(integer_entries(usable(df, id_col, vec_col)))
    fit = stored(rows.select("x").distinct())
    kind = df.schema[id_col].dataType.simpleString()
    schema = (f"`{id_col}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    first, n = fit.select(F.size("x").alias("d")).first(), fit.count()
    if first is None:
        return spark.createDataFrame([], schema)
    d = first["d"]
    sums = exact_sums(fit, d, column_sums)
    mean = [(2 * s + n) // (2 * n) for s in sums]
    near = np.array(mean, np.int64)
    cross = exact_sums(fit, d * d, lambda x: cross_sums(x - near))
    rest = [s - n * c for s, c in zip(sums, mean)]
    m = [[n * cross[i * d + j] - rest[i] * rest[j] for j in range(d)] for i in range(d)]
    trace = sum(m[i][i] for i in range(d))
    found = components(spark, m, count) if trace else []
    if not found:
        return spark.createDataFrame([], schema)
    axes, share = np.array([v for _, v in found]), np.array([s for s, _ in found])
    project = _projection(mean, rest, n, axes, np.sqrt(share * (trace / (n * n))))
    error = _identity_error(fit, project, len(found), n)
    k = len(found)

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 2048):
                part = b.slice(at, 2048)
                x = matrix(part.column(1), np.int64)
                times = len(x)
                yield pa.RecordBatch.from_arrays([
                    part.column(0).take(pa.array(np.repeat(np.arange(times), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), times)),
                    pa.array(np.full(times * k, n)), pa.array([v for v in _deviations(x - near, rest, n) for _ in range(k)], pa.int64()),
                    pa.array(project(x).ravel()), pa.array(np.tile(share, times)), pa.array(np.full(times * k, error))],
                    names=[id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, schema)


def _deviations(y: np.ndarray, rest: list[int], n: int) -> Iterator[int | None]:
    """Exact sums over dimensions of (n y - rest)^2, null beyond a long."""
    top = max(int(np.abs(y).max(initial=0)) * n, max(abs(r) for r in rest)) * 2
    if top * top * y.shape[1] < 2 ** 63:
        z = y * n - np.array(rest, np.int64)
        yield from (z * z).sum(axis=1).tolist()
    else:
        z = y.astype(object) * n - np.array(rest, object)
        yield from (int(v) if v < 2 ** 63 else None for v in (z * z).sum(axis=1))


def _identity_error(fit: DataFrame, project, k: int, n: int) -> float:
    """Largest absolute entry of the covariance of the whitened fit list minus the identity."""
    def run(batches):
        total = np.zeros((k + 1, k))
        for b in batches:
            if b.num_rows:
                w = project(matrix(b.column(0), np.int64))
                total += np.concatenate([w.T @ w, w.sum(axis=0)[None]])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k * (k + 1))), pa.array(total.ravel())], names=["cell", "v"])

    cells = fit.select("x").mapInArrow(run, "cell long, v double").groupBy("cell").agg(F.sum("v").alias("v")).collect()
    total = np.zeros(k * (k + 1))
    for r in cells:
        total[r["cell"]] = r["v"]
    total = total.reshape(k + 1, k) / n
    return float(np.abs(total[:k] - np.outer(total[k], total[k]) - np.eye(k)).max())
