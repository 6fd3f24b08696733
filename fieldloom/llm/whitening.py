"""Whitening of embeddings: principal components of the distinct vectors, and every row's scores on them.

Vectors are made whole numbers, x = floor(256 * entry).  The fit list is each distinct x once, a
grouping that combines before its shuffle, so copies of one vector cost one row a task.  Over it, in
passes of Spark: the number n and exact sums S; the covariance, centred before multiplying, of which a
task gives a row for each dimension; and the covariance of the whitened scores, whose distance from
the identity tells how good the fit is.

The covariance is dimensions squared in size, whatever the number of rows.  The driver takes it to
tridiagonal form by Householder reflections; counts of sign changes in Sturm sequences find the
leading eigenvalues by bisection; inverse iteration gives their vectors, and those whose eigenvalues
lie close together are made orthogonal again to the ones before in every iteration.  The components
are broadcast, and one pass projects every row.

Rows whose vector is null, empty or holds a null or non-finite entry are left out.  So are rows whose
vector isn't as long as most are (of equally frequent lengths the greater): they have no place in the
covariance.  Repeated rows, and rows of one vec_id or none, come out once for each row and component.
Entries beyond the range of a long are taken to its end.  ``deviation`` is null where the exact sum
doesn't fit a long.  Along a component without variance ``whitened`` is null and ``explained`` is 0,
and such components don't count in ``identity_error``, which is null if no component has any variance.
A component's sign makes its largest entry positive.  Extra columns of any name are ignored.  An
empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm.common import stored

COMPONENTS, SCALE = 4, 256
#: Eigenvalues of less than this share of the largest, times the dimensions, are none.
LEAST_SHARE = 4 * np.finfo(float).eps
#: Bisections after which an interval of doubles can't be halved again, and inverse iterations.
BISECTIONS, ITERATIONS = 120, 6
#: Eigenvalues closer than this share of the matrix's norm are a cluster.
CLUSTER = 1e-3


def reflected(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, off-diagonal and reflection vectors of a symmetric matrix's tridiagonal form."""
    a, vectors = a.astype(np.float64).copy(), []
    d = len(a)
    for k in range(d - 2):
        v = a[k + 1 :, k].copy()
        norm = np.linalg.norm(v)
        v[0] += np.copysign(norm, v[0])
        length = np.linalg.norm(v)
        if length > 0:
            v /= length
            rest = a[k + 1 :, k + 1 :]
            p = rest @ v
            w = 2 * (p - (v @ p) * v)
            rest -= np.outer(v, w) + np.outer(w, v)
            a[k + 1 :, k] -= 2 * v * (v @ a[k + 1 :, k])
        vectors.append(v)
    return np.diag(a).copy(), np.array([a[i + 1, i] for i in range(d - 1)]), vectors


def larger_than(x: float, diagonal: np.ndarray, off: np.ndarray) -> int:
    """How many eigenvalues of a tridiagonal matrix are larger than ``x``: the positive terms of its Sturm sequence."""
    tiny, q, n = np.finfo(float).tiny, 1.0, 0
    for i, b in enumerate(diagonal):
        q = b - x - (off[i - 1] ** 2 / q if i else 0.0)
        if q == 0:
            q = -tiny if i + 1 == len(diagonal) else -np.finfo(float).eps * (abs(off[i]) + tiny)
        n += q > 0
    return n


def leading_eigenvalues(diagonal: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` largest, each by bisection between the bounds of the matrix's discs."""
    radius = np.append(np.abs(off), 0) + np.append(0, np.abs(off))
    least, most = float((diagonal - radius).min()), float((diagonal + radius).max())
    out = []
    for j in range(k):
        lo, hi = least - 1e-300, most + abs(most) * 1e-15 + 1e-300
        for _ in range(BISECTIONS):
            middle = (lo + hi) / 2
            if middle in (lo, hi):
                break
            lo, hi = (middle, hi) if larger_than(middle, diagonal, off) > j else (lo, middle)
        out.append((lo + hi) / 2)
    return np.array(out)


def _solved(diagonal: np.ndarray, off: np.ndarray, x: float, b: np.ndarray, tiny: float) -> np.ndarray:
    """The solution of (T - x) y = b by elimination with interchanges of rows."""
    n = len(diagonal)
    u, up, up2 = np.zeros(n), np.zeros(n), np.zeros(n)
    b = b.copy()
    p, q, r = diagonal[0] - x, off[0] if n > 1 else 0.0, 0.0
    for i in range(n - 1):
        p2, q2, r2 = off[i], diagonal[i + 1] - x, off[i + 1] if i + 2 < n else 0.0
        if abs(p2) > abs(p):
            p, q, r, p2, q2, r2 = p2, q2, r2, p, q, r
            b[i], b[i + 1] = b[i + 1], b[i]
        u[i], up[i], up2[i] = p if p else tiny, q, r
        m = p2 / u[i]
        b[i + 1] -= m * b[i]
        p, q, r = q2 - m * q, r2 - m * r, 0.0
    u[n - 1] = p if p else tiny
    y = np.zeros(n)
    for i in range(n - 1, -1, -1):
        y[i] = (b[i] - (up[i] * y[i + 1] if i + 1 < n else 0) - (up2[i] * y[i + 2] if i + 2 < n else 0)) / u[i]
    return y


def leading_vectors(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues of a symmetric matrix, falling, and their unit vectors as rows."""
    scale = float(np.abs(matrix).max())
    if not scale:
        return np.zeros(k), np.eye(k, len(matrix))
    diagonal, off, reflections = reflected(matrix / scale)
    values = leading_eigenvalues(diagonal, off, k)
    norm = float((np.abs(diagonal) + np.append(np.abs(off), 0) + np.append(0, np.abs(off))).max())
    rng, vectors = np.random.default_rng(7), []
    for j, value in enumerate(values):
        close = [vectors[i] for i in range(j) if values[i] - value <= CLUSTER * norm]
        # equal eigenvalues are shifted by a hair, so their iterations start apart
        shift = value - j * 4 * np.finfo(float).eps * norm if close else value
        y = rng.standard_normal(len(diagonal))
        for _ in range(ITERATIONS):
            y = _solved(diagonal, off, shift, y / np.linalg.norm(y), np.finfo(float).eps * norm)
            y /= np.abs(y).max()
            for _ in range(2):
                for other in close:
                    y = y - (other @ y) * other
        vectors.append(y / np.linalg.norm(y))
    out = np.array(vectors)
    for i in range(len(reflections) - 1, -1, -1):
        v = reflections[i]
        out[:, i + 1 :] -= 2 * np.outer(out[:, i + 1 :] @ v, v)
    out /= np.linalg.norm(out, axis=1)[:, None]
    out *= np.where(out[np.arange(k), np.abs(out).argmax(1)] < 0, -1.0, 1.0)[:, None]
    return values * scale, out


def _whole(batch: pa.RecordBatch, dimensions: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows of a batch that remain, and their x."""
    column = batch.column("vector")
    right = np.flatnonzero(column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False) == dimensions)
    entries = column.take(pa.array(right)).flatten().cast(pa.float64())
    c = entries.fill_null(np.nan).to_numpy(zero_copy_only=False).reshape(len(right), dimensions)
    good = np.isfinite(c).all(1)
    x = np.floor(SCALE * c[good])
    beyond = np.abs(x) >= 2.0**63
    out = np.where(beyond, 0, x).astype(np.int64)
    out[beyond] = np.where(x[beyond] > 0, np.iinfo(np.int64).max, np.iinfo(np.int64).min)
    return right[good], out


def _packed(x: np.ndarray) -> list[bytes]:
    """One form for each vector: in two bytes an entry where all fit, in eight where not."""
    small = (np.abs(np.clip(x, -40000, 40000)) < 32768).all(1)
    return [(row.astype("<i2") if s else row).tobytes() for row, s in zip(x, small)]


def _unpacked(column: pa.Array, dimensions: int) -> np.ndarray:
    """The vectors of packed rows, in any order."""
    size = pc.binary_length(column).to_numpy(zero_copy_only=False)
    parts = []
    for item, kind in ((2, "<i2"), (8, "<i8")):
        rows = column.filter(pa.array(size == item * dimensions))
        if len(rows):
            parts.append(np.frombuffer(b"".join(rows.to_pylist()), kind).reshape(len(rows), dimensions).astype(np.int64))
    return np.concatenate(parts) if parts else np.zeros((0, dimensions), np.int64)


def _exact_sums(x: np.ndarray) -> list[int]:
    """Column sums as Python's integers."""
    if not len(x):
        return [0] * x.shape[1]
    if max(abs(int(x.min())), abs(int(x.max()))) < (1 << 62) // len(x):
        return [int(v) for v in x.sum(0)]
    return [sum(map(int, column)) for column in x.T]


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Exact sums over dimensions of (n * x - S)^2; null beyond a long."""
    if not len(x):
        return []
    most = n * max(abs(int(x.min())), abs(int(x.max()))) + max(map(abs, sums), default=0)
    if most * most * x.shape[1] < 1 << 63:
        by = n * x - np.array(sums, np.int64)
        return (by * by).sum(1).tolist()
    exact = [sum((n * int(v) - s) ** 2 for v, s in zip(row, sums)) for row in x]
    return [v if v < 1 << 63 else None for v in exact]


def _over_fit_list(fit: DataFrame, dimensions: int, columns: int, of) -> np.ndarray:
    """A matrix of sums over the fit list: ``of`` turns vectors into a matrix, tasks add theirs up, and rows of the partial sums are added by their number."""

    def partial(batches):
        total = 0.0
        for batch in batches:
            x = _unpacked(batch.column("x"), dimensions)
            if len(x):
                total = total + of(x)
        if np.ndim(total):
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(list(total), pa.list_(pa.float64()))], ["i", "sums"])

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, v in zip(batch.column("i").to_pylist(), batch.column("sums")):
                sums[i] = sums.get(i, 0.0) + np.array(v.as_py())
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array(list(sums.values()), pa.list_(pa.float64()))], ["i", "sums"])

    schema = "i long, sums array<double>"
    out = np.zeros((columns, columns))
    for i, v in fit.mapInArrow(partial, schema).repartition("i").mapInArrow(add, schema).collect():
        out[i] = v
    return out


def whitened(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Per row that remains and component: the id, component, n, deviation, whitened, explained, identity_error."""
    rows = vectors.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{vector_column}`").alias("vector"))
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"`{id_column}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    full = rows.where("vector is not null and size(vector) > 0 and not exists(vector, v -> v is null or isnan(v) or abs(cast(v as double)) = double('Infinity'))")
    usual = full.groupBy(F.size("vector").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if usual is None:
        return vectors.sparkSession.createDataFrame([], schema)
    d = usual["d"]
    k = min(components, d)

    def packed(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_packed(_whole(batch, d)[1]), pa.binary())], ["x"])

    fit = stored(rows.select("vector").mapInArrow(packed, "x binary").distinct(), "fit-list")

    def sums_of(batches):
        n, sums = 0, [0] * d
        for batch in batches:
            x = _unpacked(batch.column("x"), d)
            n, sums = n + len(x), [a + b for a, b in zip(sums, _exact_sums(x))]
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([[str(s) for s in sums]], pa.list_(pa.string()))], ["n", "sums"])

    n, sums = 0, [0] * d
    totals = fit.mapInArrow(sums_of, "n long, sums array<string>").select("n", F.posexplode("sums").alias("i", "s"))
    for i, s, part in totals.groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.sum("n").alias("n")).collect():
        sums[i], n = int(s), part
    mean = np.array([s / n for s in sums])
    covariance = _over_fit_list(fit, d, d, lambda x: (x - mean).T @ (x - mean)) / n
    covariance = (covariance + covariance.T) / 2
    values, axes = leading_vectors(covariance, k)
    trace = float(np.trace(covariance))
    real = values > LEAST_SHARE * d * max(values[0], 0.0)
    scales = np.where(real, 1 / np.sqrt(np.where(real, values, 1)), np.nan)
    error = None
    if real.any():
        own, by = axes[real], scales[real]

        def moments(x):
            w = np.hstack([np.ones((len(x), 1)), (x - mean) @ own.T * by])
            return w.T @ w

        m = _over_fit_list(fit, d, len(own) + 1, moments) / n
        error = float(np.abs(m[1:, 1:] - np.outer(m[0, 1:], m[0, 1:]) - np.eye(len(own))).max())
    explained = np.where(real, values / trace if trace > 0 else 0.0, 0.0)
    fitted = vectors.sparkSession.sparkContext.broadcast((mean, axes, scales, explained, sums))

    def project(batches):
        mean, axes, scales, explained, sums = fitted.value
        for batch in batches:
            at, x = _whole(batch, d)
            w = ((x - mean) @ axes.T * scales).ravel()
            each = np.repeat(np.arange(len(at)), k)
            columns = [batch.column("id").take(pa.array(at)).take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(at))), pa.array(np.full(len(each), n)), pa.array(_deviations(x, n, sums), pa.int64()).take(pa.array(each)), pa.array(w, mask=np.isnan(w)), pa.array(np.tile(explained, len(at))), pa.array([error] * len(each), pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, [id_column, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(project, schema)


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {"op11_embedding_whitening": op11_embedding_whitening}
#: Eigenvectors are beyond SQL; the query is held against another library's.
ORACLE_SQL: dict[str, str] = {}
