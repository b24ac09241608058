"""Whitening of vectors along the leading components of their covariance.

Sums and centred products are partial matrices of tasks, merged row by row. The eigenvectors of
the covariance come from spectral divide and conquer: the polar factor of the shifted matrix (by
dynamically weighted Halley iteration, QR based while ill-conditioned, then by Cholesky) has
eigenvalues +1 above and -1 below the shift, so (U + I) / 2 projects on the invariant subspace
above it. Each half is a smaller problem of the same kind, until a block is a multiple of the
identity; halves beyond the wanted components are left unsplit. The outcome, a few vectors of
known size, goes to all tasks, which project their rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.storage import materialize
from .common import arrow_map
from .vectors import filled, scaled, whole_rows

COMPONENTS = 8
SHIFT = 100_000
# Doubles of vectors that a task multiplies at a time.
CHUNK = 1 << 20
EPS = float(np.finfo(np.float64).eps)
_LONG = np.iinfo(np.int64).max


# -- spectral divide and conquer --------------------------------------------- #


def polar(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix."""
    eye = np.eye(len(a))
    x = a / np.linalg.norm(a)  # the Frobenius norm bounds the largest singular value
    least = EPS / len(a)
    for _ in range(30):
        before = x
        square = least * least
        weight = np.cbrt(4 * (1 - square) / (square * square))
        root = np.sqrt(1 + weight)
        p = root + np.sqrt(8 - 4 * weight + 8 * (2 - square) / (square * root)) / 2
        q = (p - 1) ** 2 / 4
        r = p + q - 1
        if r > 100:
            both = np.linalg.qr(np.vstack([np.sqrt(r) * x, eye]))[0]
            x = (q / r) * x + (p - q / r) / np.sqrt(r) * (both[: len(a)] @ both[len(a) :].T)
        else:
            factor = np.linalg.cholesky(eye + r * (x.T @ x))
            half = np.linalg.solve(factor, x.T)
            x = (q / r) * x + (p - q / r) * np.linalg.solve(factor.T, half).T
        x = (x + x.T) / 2
        least = min(1.0, least * (p + q * square) / (1 + r * square))
        if abs(1 - least) < 10 * EPS and np.linalg.norm(x - before) < np.cbrt(5 * EPS):
            break
    return x


def _halves(a: np.ndarray, scale: float) -> tuple[np.ndarray, np.ndarray] | None:
    """Orthonormal bases of the invariant subspaces above and below a shift near the mean
    eigenvalue; None if the eigenvalues are equal within rounding of ``scale``."""
    n = len(a)
    mean = np.trace(a) / n
    spread = np.linalg.norm(a - mean * np.eye(n)) / np.sqrt(n)
    if spread <= 4 * n * EPS * scale:
        return None
    best, least = None, np.inf
    draw = np.random.default_rng(n)
    # The mean lies between eigenvalues that differ; another shift if one is too near to it.
    for part in (0.0, 0.05, -0.05, 0.2, -0.2, 0.4, -0.4):
        u = polar(a - (mean + part * spread) * np.eye(n))
        projector = (u + np.eye(n)) / 2
        above = int(round(np.trace(projector)))
        if not 0 < above < n:
            continue
        basis = np.linalg.qr(projector @ draw.standard_normal((n, above)), mode="complete")[0]
        basis = np.linalg.qr(np.hstack([projector @ basis[:, :above], basis[:, above:]]))[0]
        upper, lower = basis[:, :above], basis[:, above:]
        left = np.linalg.norm(upper.T @ a @ lower)
        if left < least:
            best, least = (upper, lower), left
        if left <= 4 * n * EPS * scale:
            break
    return best


def components(covariance: np.ndarray, wanted: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors as rows) of a symmetric matrix, the ``wanted`` largest by
    falling eigenvalue; the largest entry of each vector is positive."""
    a = (covariance + covariance.T) / 2
    scale = float(np.linalg.norm(a))
    found: list[np.ndarray] = []
    # Blocks still to be split, as (basis, block), the one of the largest eigenvalues on top.
    todo = [(np.eye(len(a)), a)]
    while todo and len(found) < wanted:
        basis, block = todo.pop()
        halves = _halves(block, scale) if len(block) > 1 else None
        if halves is None:
            found += list(basis.T)
            continue
        for half in reversed(halves):
            inner = half.T @ block @ half
            todo.append((basis @ half, (inner + inner.T) / 2))
    vectors = np.array(found).reshape(len(found), len(a))
    values = np.einsum("ij,jk,ik->i", vectors, a, vectors)
    order = np.argsort(-values, kind="stable")[:wanted]
    vectors, values = vectors[order], values[order]
    signs = np.sign(vectors[np.arange(len(vectors)), np.abs(vectors).argmax(axis=1)])
    return values, vectors * signs[:, None]


# -- sums over the table ----------------------------------------------------- #


def _vectors(column: pa.Array, kind=np.int64) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0), kind)


def _slices(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    rows = max(1, CHUNK // max(1, width))
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _products(centre, width: int):
    """One matrix of centred products per task, a line for each of its rows."""

    def run(batches):
        total = np.zeros((width, width))
        for batch in _slices(batches, width):
            some = centre(batch.column(0))
            total += some.T @ some
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(width, dtype=np.int32)), pa.array(list(total), pa.list_(pa.float64()))], ["line", "products"])

    return run


def _merged(width: int):
    """The sums of equal lines, one for each line of the task."""

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for line, row in zip(batch.column(0).to_pylist(), _vectors(batch.column(1), np.float64)):
                sums[line] = sums[line] + row if line in sums else row.copy()
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.int32()), pa.array(list(sums.values()), pa.list_(pa.float64()))], ["line", "products"])

    return run


def covariance(rows: DataFrame, count: int, width: int, centre) -> np.ndarray:
    """The covariance (divisor ``count``) of the one column of ``rows``. ``centre`` makes an Arrow
    column a matrix of differences from the mean. Tasks add up whole matrices, which are merged
    by lines; ``width`` lines come to the driver."""
    schema = "line int, products array<double>"
    partial = arrow_map(rows, _products(centre, width), schema)
    shuffles = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    merged = arrow_map(partial.repartition(min(width, shuffles), "line"), _merged(width), schema)
    out = np.zeros((width, width))
    for r in merged.collect():
        out[r.line] = r.products
    return (out + out.T) / (2 * max(1, count))


def _from_whole(count: int, sums: list[int]):
    """Differences of longs from their means: the whole part exactly, then the fraction."""
    whole = np.array([s // count for s in sums], np.int64)
    rest = np.array([(s % count) / count for s in sums])

    def run(column: pa.Array) -> np.ndarray:
        return (_vectors(column) - whole) - rest

    return run


def _from_means(means: np.ndarray):
    def run(column: pa.Array) -> np.ndarray:
        return _vectors(column, np.float64) - means

    return run


def _sums(rows: DataFrame, width: int) -> tuple[list[int], int]:
    """(exact sum of each component, largest distance of two values of a component)."""
    low = F.col("x").bitwiseAND(F.lit((1 << 20) - 1))
    lines = rows.select(F.posexplode("v").alias("at", "x")).groupBy("at").agg(
        F.sum(F.shiftright("x", 20)).alias("high"), F.sum(low).alias("low"), F.min("x").alias("least"), F.max("x").alias("most")).collect()
    sums, far = [0] * width, 0
    for r in lines:
        sums[r["at"]] = (r["high"] << 20) + r["low"]
        far = max(far, r["most"] - r["least"])
    return sums, far


def _projected(count: int, sums: list[int], far: int, matrix: np.ndarray):
    """Adds ``deviation`` and ``whitened`` to (vector, id)."""
    centre = _from_whole(count, sums)
    whole = np.array([s // count for s in sums], np.int64)
    rest = np.array([s % count for s in sums], np.int64)
    small = len(sums) * (count * (far + 1)) ** 2 < 2**62

    def deviations(v: np.ndarray) -> list[int]:
        away = v - whole
        if small:
            return ((count * away - rest) ** 2).sum(axis=1).tolist()
        away = count * away.astype(object) - rest.astype(object)
        return [min(_LONG, int(x)) for x in (away * away).sum(axis=1)]

    def run(batches):
        for batch in _slices(batches, len(sums)):
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), pa.array(deviations(_vectors(batch.column(0))), pa.int64()),
                 pa.array(list(centre(batch.column(0)) @ matrix.T), pa.list_(pa.float64()))],
                ["id", "deviation", "whitened"])

    return run


def whiten(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", wanted: int = COMPONENTS,
) -> tuple[DataFrame, dict]:
    """((id, deviation, whitened array), model): every vector along the ``wanted`` leading components of
    the covariance of all, in units of their deviation. The model has ``n``, ``values``, ``vectors``,
    ``explained`` and ``identity_error``.

    Rows whose vector is null or holds a null or non-finite component take no part. Components
    become floor(1024 * x) + 100000; shorter vectors are filled up with x = 0. Repeated rows, and
    rows of a null or repeated id, count and are answered each. Components without variance (as all
    of a single row or of equal rows) are left out, so ``whitened`` may be shorter than ``wanted`` or
    empty. Deviations beyond a long are held at its largest value. An empty table gives no row.
    Other columns are not read."""
    rows = materialize(whole_rows(vectors, vector_col).select(
        scaled(F.col(vector_col), SHIFT).alias("v"), F.col(id_col).cast("bigint").alias("id")), "vectors")
    count, width = rows.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    if not count or not width:
        nothing = rows.select("id", F.lit(0).cast("bigint").alias("deviation"), F.array().cast("array<double>").alias("whitened"))
        return nothing, {"n": count, "values": np.zeros(0), "vectors": np.zeros((0, 0)), "explained": np.zeros(0), "identity_error": 0.0}
    rows = rows.select(filled(F.col("v"), width, SHIFT).alias("v"), "id")
    sums, far = _sums(rows, width)
    spread = covariance(rows.select("v"), count, width, _from_whole(count, sums))
    values, found = components(spread, wanted)
    real = values > width * EPS * max(1e-300, np.linalg.norm(spread))
    values, found = values[real], found[real]
    matrix = found / np.sqrt(values)[:, None]
    done = materialize(arrow_map(
        rows, _projected(count, sums, far, matrix), "id bigint, deviation bigint, whitened array<double>"), "whitened")
    error = 0.0
    if len(values):
        lines = done.select(F.posexplode("whitened").alias("at", "w")).groupBy("at").agg(F.avg("w").alias("mean")).collect()
        means = np.array([r["mean"] for r in sorted(lines)])
        error = float(np.abs(covariance(done.select("whitened"), count, len(values), _from_means(means)) - np.eye(len(values))).max())
    return done, {"n": count, "values": values, "vectors": found, "explained": values / np.trace(spread), "identity_error": error}


def op13_whitening(spark, folder):
    done, model = whiten(spark.read.parquet(f"{folder}/embeddings.parquet"))
    explained = F.array(*(F.lit(float(e)) for e in model["explained"])).cast("array<double>")
    return done.select(
        F.col("id").alias("vec_id"), "deviation", F.posexplode("whitened").alias("at", "whitened")).select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(model["n"]).cast("bigint").alias("n"), "deviation", "whitened",
        explained[F.col("at")].alias("explained"), F.lit(model["identity_error"]).alias("identity_error"))
