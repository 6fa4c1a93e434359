"""Embedding whitening by an eigensolver of our own.

1. One pass: count, sums of each dimension (whole numbers, exact).
2. One pass: the covariance.  Each partition centres its vectors, multiplies
   them and sends one d x d matrix, row by row; Spark adds them up.
3. On the driver, from d x d numbers: Householder reflections make the matrix
   tridiagonal; Sturm counts bisect its leading eigenvalues; inverse iteration
   finds their vectors, those of close eigenvalues kept orthogonal to each
   other; the reflections carry them back.
4. One pass projects every vector on the broadcast components; the covariance
   of what comes out is measured on Spark again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, written
from .vectors import matrix

#: Vector entries become floor(SCALE * c) + SHIFT; products by SCALE beyond LARGEST count as LARGEST (doubles are whole numbers there).
SCALE, SHIFT, LARGEST = 1024, 100_000, 1 << 52
#: Widest vectors: d x d doubles lie in the driver (128 MB at 4,096).
MAX_DIMENSION = 4096
#: Eigenvalues below this share of the largest, times d, are rounding: no component.
RANK_EPS = 1e-13
#: Eigenvalues closer than this share of the matrix norm are a cluster.
CLUSTER = 1e-3

SCHEMA = "vec_id long, n long, deviation decimal(38,0), whitened array<double>"


# ------------------------------------------------------------ eigenpairs
def tridiagonal(a):
    """Householder reflections of a symmetric matrix: (diagonal, off-diagonal,
    reflectors), T = Q'AQ with Q = H0 H1 ..., H = I - 2vv', v in row k zero up to k."""
    import numpy as np

    a = np.array(a, dtype=np.float64)
    d = len(a)
    reflectors = np.zeros((max(d - 2, 0), d))
    for k in range(d - 2):
        x = a[k + 1:, k]
        size = np.sqrt((x * x).sum())
        if size == 0 or not x[1:].any():
            continue
        v = x.copy()
        v[0] += size if x[0] >= 0 else -size
        v /= np.sqrt((v * v).sum())
        sub = a[k + 1:, k + 1:]
        p = sub @ v
        w = 2 * (p - (v @ p) * v)
        sub -= np.outer(v, w) + np.outer(w, v)
        a[k + 1, k] = a[k, k + 1] = -size if x[0] >= 0 else size
        a[k + 2:, k] = a[k, k + 2:] = 0
        reflectors[k, k + 1:] = v
    return np.diag(a).copy(), np.diag(a, 1).copy(), reflectors


def sturm_counts(diag, off, x):
    """For each of the numbers ``x``: how many eigenvalues of the tridiagonal matrix lie below it."""
    import numpy as np

    tiny = np.finfo(float).tiny ** 0.5
    count = np.zeros(len(x), dtype=np.int64)
    q = np.ones(len(x))
    for i in range(len(diag)):
        q = diag[i] - x - (off[i - 1] * off[i - 1] / q if i else 0)
        q = np.where(np.abs(q) < tiny, -tiny, q)
        count += q < 0
    return count


def leading_eigenvalues(diag, off, k: int):
    """The k largest eigenvalues, falling, by bisection down to neighbouring doubles."""
    import numpy as np

    d = len(diag)
    reach = np.zeros(d)
    reach[:-1] += np.abs(off)
    reach[1:] += np.abs(off)
    bottom, top = (diag - reach).min(), (diag + reach).max()
    slack = 4 * np.finfo(float).eps * max(abs(bottom), abs(top)) * d + np.finfo(float).tiny
    lo, hi = np.full(k, bottom - slack), np.full(k, top + slack)
    wanted = d - 1 - np.arange(k)  # so many eigenvalues lie below the sought one
    for _ in range(200):
        mid = lo + (hi - lo) / 2
        if ((mid <= lo) | (mid >= hi)).all():
            break
        above = sturm_counts(diag, off, mid) > wanted
        lo, hi = np.where(above, lo, mid), np.where(above, mid, hi)
    return lo + (hi - lo) / 2


def _solver(diag, off, shift):
    """Elimination with row exchanges of T - shift; returns a function that solves for a right side."""
    import numpy as np

    d = len(diag)
    least = np.finfo(float).eps * max(np.abs(diag).max(), np.abs(off).max(initial=0.0), np.finfo(float).tiny)
    u0, u1, u2 = (diag - shift).tolist(), [*off.tolist(), 0.0], [0.0] * d
    low = off.tolist()
    swapped, factor = [False] * d, [0.0] * d
    for i in range(d - 1):
        if abs(low[i]) > abs(u0[i]):
            swapped[i] = True
            factor[i] = u0[i] / low[i]
            u0[i], u1[i], u2[i], nxt = low[i], u0[i + 1], u1[i + 1], u1[i]
            u0[i + 1], u1[i + 1] = nxt - factor[i] * u1[i], -factor[i] * u2[i]
        else:
            if abs(u0[i]) < least:
                u0[i] = least
            factor[i] = low[i] / u0[i]
            u0[i + 1] -= factor[i] * u1[i]
    if abs(u0[-1]) < least:
        u0[-1] = least

    def solve(b):
        b = b.tolist()
        for i in range(d - 1):
            if swapped[i]:
                b[i], b[i + 1] = b[i + 1], b[i]
            b[i + 1] -= factor[i] * b[i]
        for i in range(d - 1, -1, -1):
            s = b[i]
            if i + 1 < d:
                s -= u1[i] * b[i + 1]
            if i + 2 < d:
                s -= u2[i] * b[i + 2]
            b[i] = s / u0[i]
        return np.array(b)

    return solve


def leading_eigenpairs(a, k: int):
    """(eigenvalues, unit eigenvectors as rows) of a symmetric matrix, the k largest, falling."""
    import numpy as np

    a = np.asarray(a, dtype=np.float64)
    d = len(a)
    k = min(k, d)
    scale = np.abs(a).max(initial=0.0)
    if k == 0 or scale == 0:
        return np.zeros(k), np.eye(k, d)
    diag, off, reflectors = tridiagonal(a / scale)
    values = leading_eigenvalues(diag, off, k)
    norm = max((np.abs(diag) + np.abs(np.r_[off, 0]) + np.abs(np.r_[0, off])).max(), np.finfo(float).tiny)
    start = np.random.default_rng(d)
    vectors = np.zeros((k, d))
    first, shift = 0, np.inf
    for i in range(k):
        if i and values[i - 1] - values[i] > CLUSTER * norm:
            first = i  # a new cluster
        # equal eigenvalues: shifts that differ by a few roundings
        shift = min(values[i], shift - 10 * np.finfo(float).eps * norm) if i > first else values[i]
        solve = _solver(diag, off, shift)
        y = start.uniform(0.5, 1.5, d) * np.where(start.random(d) < 0.5, -1, 1)
        for _ in range(6):
            y = solve(y / np.abs(y).max())
            y /= np.abs(y).max()
            for _ in range(2):  # twice, for what rounding leaves
                y -= vectors[first:i].T @ (vectors[first:i] @ y)
            y /= np.sqrt((y * y).sum())
        vectors[i] = y
    for v in reflectors[::-1]:
        vectors -= 2 * np.outer(vectors @ v, v)
    vectors /= np.sqrt((vectors * vectors).sum(axis=1))[:, None]
    return values * scale, vectors


# ------------------------------------------------------------ passes over the vectors
def whole(values):
    """floor(1024 c) + 100000 of doubles, as int64."""
    import numpy as np

    return np.clip(np.floor(values * float(SCALE)), -float(LARGEST), float(LARGEST)).astype(np.int64) + SHIFT


def _remaining(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    small_batches(vectors.sparkSession)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    return rows.filter(F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))


def fit_sums(rows: DataFrame) -> tuple[int, list[int]]:
    """(n, S): how many vectors, and the exact sum of each dimension."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        n, total, held = 0, [], []
        for batch in batches:
            sizes = np.diff(batch.column("v").offsets.to_numpy())
            d = int(sizes.max(initial=0))
            n += batch.num_rows
            x = whole(matrix(batch.column("v"), d) if d else np.zeros((batch.num_rows, 0)))
            there = np.arange(d) < sizes[:, None]  # beyond its end a vector is zero, counted below
            # halves, so that sums of whole numbers up to 2^53 do not overflow
            high, low = np.where(there, x >> 26, 0).sum(axis=0), np.where(there, x & (1 << 26) - 1, 0).sum(axis=0)
            total += [0] * (d - len(total))
            held += [0] * (d - len(held))
            for j in range(d):
                total[j] += (int(high[j]) << 26) + int(low[j])
                held[j] += int(there[:, j].sum())
        from decimal import Decimal

        if n:  # dimension -1 counts the vectors
            yield pa.RecordBatch.from_arrays([pa.array([-1, *range(len(total))], pa.int32()), pa.array([n, *held], pa.int64()),
                                              pa.array([Decimal(x) for x in [0, *total]], pa.decimal128(38, 0))], names=["j", "n", "s"])

    sums = rows.mapInArrow(run, "j int, n long, s decimal(38,0)").groupBy("j").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    found = {r["j"]: r for r in sums.limit(MAX_DIMENSION + 2).collect()}  # a row per dimension
    if len(found) > MAX_DIMENSION + 1:
        raise ValueError(f"vectors have more than {MAX_DIMENSION} entries")
    n = found[-1]["n"] if found else 0
    return n, [int(found[j]["s"]) + SHIFT * (n - found[j]["n"]) for j in range(len(found) - 1)]


def covariance(rows: DataFrame, column: str, d: int, centre) -> object:
    """Sum of the products of centred vectors (d x d).  ``centre`` takes an
    Arrow column and gives centred rows of doubles."""
    import numpy as np

    def run(batches):
        import pyarrow as pa

        total = None
        for batch in batches:
            y = centre(batch.column(column))
            total = y.T @ y if total is None else total + y.T @ y
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(d), pa.int32()), pa.array([r[: i + 1] for i, r in enumerate(total)], pa.list_(pa.float64()))],
                                             names=["i", "below"])

    parts = rows.select(column).mapInArrow(run, "i int, below array<double>")
    cells = parts.select("i", F.posexplode("below").alias("j", "x")).groupBy("i", "j").agg(F.sum("x").alias("x")).toArrow()  # d (d + 1) / 2 cells
    out = np.zeros((d, d))
    i, j, x = (cells.column(c).to_numpy() for c in ("i", "j", "x"))
    out[i, j] = out[j, i] = x
    return out


def whiten(vectors: DataFrame, k: int = 8, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, component (from 1), n, deviation (decimal), whitened, explained,
    identity_error: a row for each remaining vector and each of the (up to)
    ``k`` leading components.

    Vectors that are null or hold null or non-finite entries do not remain.
    Entries c become x = floor(1024 c) + 100000.  deviation: the sum over
    dimensions of (n x - S)^2, exact, null from 10^38 on.  whitened: x - S/n projected
    on the component and divided by the root of its eigenvalue.  explained:
    eigenvalue over trace.  identity_error: how far the covariance of
    ``whitened`` over all rows is from the identity at most.

    Shorter vectors are as if filled up with zeros; entries beyond 2^52 / 1024
    count as that; null ids stay null and repeated rows count and come out
    each; directions without variance are no components, so equal vectors (or
    one alone) and empty tables give no rows; other columns are not read.
    Vectors have at most ``MAX_DIMENSION`` entries (else an error).
    """
    import numpy as np

    spark = vectors.sparkSession
    rows = _remaining(vectors, id_col, vector_col)
    n, sums = fit_sums(rows)
    d = len(sums)
    empty = spark.createDataFrame([], "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double")
    if not n or not d:
        return empty
    mean = np.array([s / n for s in sums])
    fits = n * (LARGEST + SHIFT) < 1 << 62  # else only small enough batches are computed in 64 bits

    def deviations(column):
        """n x - S: int64 where it fits, else Python's whole numbers."""
        x = whole(matrix(column, d))
        if fits or n * int(np.abs(x).max(initial=0)) + max(map(abs, sums)) < 1 << 62:
            return n * x - np.array(sums, dtype=np.int64)
        return x.astype(object) * n - np.array(sums, dtype=object)

    def centred(column):
        return deviations(column).astype(np.float64) / n

    v = covariance(rows, "v", d, centred) / n
    values, components = leading_eigenpairs(v, k)
    real = values > RANK_EPS * d * max(values[0], 0.0)
    values, components = values[real], components[real]
    if not len(values):
        return empty
    explained = values / np.trace(v)
    shared = spark.sparkContext.broadcast((components / np.sqrt(values)[:, None]).T)

    def project(batches):
        from decimal import Decimal

        import pyarrow as pa

        for batch in batches:
            dev = deviations(batch.column("v"))
            w = (dev.astype(np.float64) / n) @ shared.value
            if dev.dtype == np.int64 and int(np.abs(dev).max(initial=0)) ** 2 * d < 1 << 62:
                squares = (dev * dev).sum(axis=1).tolist()
            else:
                squares = [sum(x * x for x in r) for r in dev.tolist()]
            yield pa.RecordBatch.from_arrays([
                batch.column("vec_id"), pa.array(np.full(batch.num_rows, n)),
                pa.array([Decimal(s) if s < 10 ** 38 else None for s in squares], pa.decimal128(38, 0)), pa.array(list(w), pa.list_(pa.float64()))],
                names=["vec_id", "n", "deviation", "whitened"])

    out = written(rows.mapInArrow(project, SCHEMA), "whitening-projected")
    m = len(values)
    middle = out.agg(*[F.avg(F.col("whitened")[c]).alias(f"c{c}") for c in range(m)]).first()
    middle = np.array([middle[c] for c in range(m)])
    again = covariance(out, "whitened", m, lambda column: matrix(column, m) - middle) / n
    error = float(np.abs(again - np.eye(m)).max())
    shares = F.array(*[F.lit(float(x)) for x in explained])
    return out.select("vec_id", "n", "deviation", F.posexplode("whitened").alias("c", "whitened")).select(
        "vec_id", (F.col("c") + 1).cast("int").alias("component"), "n", "deviation", "whitened", shares[F.col("c")].alias("explained"),
        F.lit(error).alias("identity_error"))
