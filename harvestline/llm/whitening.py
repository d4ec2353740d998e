"""Embedding whitening on components found by spectrum slicing.

Entries become whole numbers floor(64 * c) + 1000000; the fit list holds each distinct vector of
them once. Sums are exact. The covariance is a tree of partial d x d products of exactly centred
rows. Its leading eigenvalues are isolated by bisection: an LDL' factorisation (symmetric
pivoting with 1 x 1 and 2 x 2 blocks) of the covariance minus a shift has as many negative pivots
as there are eigenvalues below the shift. In an interval with a single eigenvalue, Rayleigh quotient
iteration converges cubically; the counts on both sides of the result certify its number.
Eigenvalues that doubles can't tell apart share an interval and get an orthonormal basis.

Only d sums and one d x d matrix reach the driver, d being the length of a vector. The fit list
is written once; three scans of it give the sums, the covariance and the identity error.

Defined cases: rows whose vector is null or holds a null or non-finite entry are dropped, likewise
one with an entry beyond the range of a long. The list is fitted on the most frequent length of its
vectors (on a tie the longer); rows of other lengths, empty ones among them, are dropped. Components
whose eigenvalue is zero up to rounding (at most d * 2^-50 of the largest) are left out, so a
single distinct vector gives no rows. Repeated rows are returned as often as they occur; a
deviation beyond a long is null. Only the id and the vector are read, so other columns may have any
name. No rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harvestline.llm.support import Scratch, bound_batches, table

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
FAN_IN = 16             # partial matrices one task adds up
OUT_ROWS = 50_000       # rows of one result batch
EXACT = 1 << 62


def _pivot(a: np.ndarray, k: int) -> int:
    """Move a stable pivot to row k by equal swaps of rows and columns; its order, 1 or 2."""
    def swap(i: int, j: int) -> None:
        if i != j:
            a[[i, j]] = a[[j, i]]
            a[:, [i, j]] = a[:, [j, i]]

    alpha = (1 + 17 ** 0.5) / 8
    rest = np.abs(a[k:, k:])
    diagonal = np.diagonal(rest)
    best = int(diagonal.argmax())
    off = rest - np.diag(diagonal)
    at = int(off.argmax())
    if diagonal[best] >= alpha * off.flat[at]:
        swap(k, k + best)
        return 1
    i, j = sorted(divmod(at, len(rest)))
    swap(k, k + i)
    swap(k + 1, k + j)
    return 2


def inertia(matrix: np.ndarray, shift: float) -> int:
    """Eigenvalues of a symmetric matrix below `shift`: negative pivots of its LDL' factorisation."""
    a = matrix - shift * np.eye(len(matrix))
    tiny = np.finfo(float).tiny
    k = negative = 0
    while k < len(a):
        order = _pivot(a, k) if k + 1 < len(a) else 1
        if order == 1:
            d = a[k, k]
            if abs(d) <= tiny:  # all that is left is zero: eigenvalues at the shift
                break
            negative += d < 0
            column = a[k + 1:, k].copy()
            a[k + 1:, k + 1:] -= np.outer(column, column / d)
        else:                   # such a block has a negative determinant: one eigenvalue of each sign
            negative += 1
            block, columns = a[k:k + 2, k:k + 2].copy(), a[k + 2:, k:k + 2].copy()
            a[k + 2:, k + 2:] -= columns @ np.linalg.solve(block, columns.T)
        k += order
    return int(negative)


def _refined(matrix: np.ndarray, low: float, high: float, found: list[np.ndarray], seed: int) -> tuple[float, np.ndarray]:
    """Rayleigh quotient iteration from the middle of an interval, kept orthogonal to `found`."""
    size, norm = len(matrix), float(np.abs(matrix).sum(axis=1).max())
    eye = np.eye(size)
    nudge = norm * np.finfo(float).eps

    def solved(shift: float, v: np.ndarray) -> np.ndarray:
        for step in range(4):
            try:
                w = np.linalg.solve(matrix - (shift + nudge * step) * eye, v)
            except np.linalg.LinAlgError:
                continue
            if np.isfinite(w).all() and w.any():
                w = w / np.abs(w).max()
                break
        else:
            return v
        for other in found * 2:
            w = w - other * (other @ w)
        return w / np.linalg.norm(w)

    v = np.random.default_rng(seed).standard_normal(size)
    middle = value = (low + high) / 2
    for _ in range(3):
        v = solved(middle, v)
    least = np.inf
    for _ in range(12):
        value = float(v @ (matrix @ v))
        residual = float(np.linalg.norm(matrix @ v - value * v))
        if residual >= least or not low <= value <= high:
            break
        least, best = residual, (value, v)
        v = solved(value, v)
    return best if least < np.inf else (value, v)


def leading(matrix: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The `count` largest eigenvalues, falling, and unit eigenvectors as columns.

    Slices are split until each holds one eigenvalue that Rayleigh quotients confirm: the value
    stays in its slice and the counts just below and above it give its number.
    """
    size = len(matrix)
    count = min(count, size)
    radius = np.abs(matrix).sum(axis=1) - np.abs(np.diagonal(matrix))
    low = float((np.diagonal(matrix) - radius).min())
    high = float((np.diagonal(matrix) + radius).max())
    norm = max(abs(low), abs(high))
    fine = 4 * size * np.finfo(float).eps * norm  # closer eigenvalues are one to doubles
    low, high = low - fine - np.finfo(float).tiny, high + fine + np.finfo(float).tiny
    above = {high: 0, low: size}

    def over(shift: float) -> int:
        """Eigenvalues at or above the shift."""
        if shift not in above:
            above[shift] = size - inertia(matrix, shift)
        return above[shift]

    values: list[float] = []
    vectors: list[np.ndarray] = []
    slices = [(low, high)]
    while slices and len(values) < count:
        a, b = slices.pop()     # the topmost slice that is left
        inside = over(a) - over(b)
        if inside <= 0:
            continue
        middle = (a + b) / 2
        close = b - a <= fine or not a < middle < b
        if inside == 1 and not close:
            near = [v for e, v in zip(values, vectors) if e - b <= 1e-3 * norm]
            value, vector = _refined(matrix, a, b, near, len(values))
            error = max(float(np.linalg.norm(matrix @ vector - value * vector)), fine)
            if a <= value <= b and error <= 100 * fine and over(value - 2 * error) - over(value + 2 * error) == 1 \
                    and over(value + 2 * error) == len(values):
                values.append(value)
                vectors.append(vector)
                continue
        if close:               # one value to doubles, perhaps with several vectors
            near = [v for e, v in zip(values, vectors) if e - b <= 1e-3 * norm]
            for _ in range(inside):
                value, vector = _refined(matrix, a - 4 * fine, b + 4 * fine, near, len(values))
                values.append(value)
                vectors.append(vector)
                near.append(vector)
            continue
        slices += [(a, middle), (middle, b)]
    return np.array(values[:count]), np.array(vectors[:count]).reshape(-1, size).T


@dataclass
class Model:
    """What whitening needs: distinct vectors, their sums, components as columns, eigenvalues."""
    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float = 0.0


def lattice(rows: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(id, x) of rows with finite vectors in the range of a long."""
    entry = F.transform(vector_column, lambda c: c.cast("double"))
    kept = rows.select(F.col(id_column).alias("id"), entry.alias("entry")).where(F.forall(
        "entry", lambda c: F.coalesce(F.abs(c) <= (2.0 ** 62) / SCALE, F.lit(False)) & ~F.isnan(c)))
    return kept.select("id", F.transform("entry", lambda c: F.floor(c * SCALE) + F.lit(SHIFT).cast("long")).alias("x"))


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    """Rows of whole numbers."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def _off_mean(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S exactly: 64-bit numbers where they suffice, else Python's."""
    most = int(np.abs(x).max(initial=0))
    if n * most + max(map(abs, sums)) < EXACT:
        return x * n - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    return (_off_mean(x, n, sums) / n).astype(float)


def _deviation(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    off = _off_mean(x, n, sums)
    if off.dtype != object and int(np.abs(off).max(initial=0)) ** 2 * off.shape[1] < EXACT:
        return (off * off).sum(axis=1).tolist()
    totals = [sum(int(v) ** 2 for v in row) for row in off.tolist()]
    return [t if t < 1 << 63 else None for t in totals]


PRODUCT = "total binary"


def _products(batches: Iterator[pa.RecordBatch], model: Model, whitened: bool) -> Iterator[pa.RecordBatch]:
    """One partial sum per task: centred products, or sums and products of whitened rows."""
    total = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = _centred(_matrix(batch["x"], len(model.sums)), model.n, model.sums)
        if whitened:
            rows = rows @ model.vectors / np.sqrt(model.values)
            rows = np.hstack([rows, np.ones((len(rows), 1))])
        total = rows.T @ rows + (0 if total is None else total)
    if total is not None:
        yield pa.record_batch([pa.array([total.tobytes()], pa.binary())], names=["total"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        for raw in batch["total"]:
            part = np.frombuffer(raw.as_buffer(), float)
            total = part if total is None else total + part
    if total is not None:
        yield pa.record_batch([pa.array([total.tobytes()], pa.binary())], names=["total"])


def _tree_sum(parts: DataFrame, scratch: Scratch, label: str, size: int) -> np.ndarray:
    """Add partial matrices in rounds; no task holds more than one sum and its inputs one by one."""
    level = scratch.write(parts, f"{label}-0")
    left, step = level.count(), 0
    while left > 1:
        step += 1
        left = -(-left // FAN_IN)
        level = scratch.write(level.repartition(left).mapInArrow(_added, PRODUCT), f"{label}-{step}")
    return np.frombuffer(bytes(level.first()[0]), float).reshape(size, size)


def fit(rows: DataFrame, scratch: Scratch, components: int = COMPONENTS) -> tuple[Model | None, int]:
    """Model of the distinct vectors among `rows` (id, x), and the length of its vectors."""
    distinct = scratch.write(rows.select("x").distinct(), "fit")
    lengths = distinct.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n")).where("d > 0").orderBy(
        F.desc("n"), F.desc("d")).first()
    if lengths is None:
        return None, 0
    size, n = lengths
    fitted = distinct.where(F.size("x") == size)
    sums = fitted.select(F.posexplode("x").alias("at", "v")).groupBy("at").agg(
        F.sum(F.col("v").cast("decimal(38,0)")).alias("s")).orderBy("at").collect()
    model = Model(n, [int(r.s) for r in sums], np.zeros(0), np.zeros((size, 0)), 0.0)
    covariance = _tree_sum(fitted.mapInArrow(lambda b: _products(b, model, False), PRODUCT), scratch, "covariance", size) / n
    covariance = (covariance + covariance.T) / 2
    values, vectors = leading(covariance, components)
    real = values > size * 2.0 ** -50 * (values[0] if len(values) else 0.0)
    model = Model(n, model.sums, values[real], vectors[:, real], float(np.trace(covariance)))
    if not len(model.values):
        return model, size
    k = len(model.values)
    sums_too = _tree_sum(fitted.mapInArrow(lambda b: _products(b, model, True), PRODUCT), scratch, "whitened", k + 1)
    mean = sums_too[:k, k] / n
    model.identity_error = float(np.abs(sums_too[:k, :k] / n - np.outer(mean, mean) - np.eye(k)).max())
    return model, size


def _whiten(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    k = len(model.values)
    for batch in batches:
        for start in range(0, batch.num_rows, max(1, OUT_ROWS // k)):
            part = batch.slice(start, max(1, OUT_ROWS // k))
            x = _matrix(part["x"], len(model.sums))
            scores = _centred(x, model.n, model.sums) @ model.vectors / np.sqrt(model.values)
            each = np.repeat(np.arange(len(x)), k)
            yield pa.record_batch([
                part["id"].take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                pa.array(np.full(len(each), model.n, np.int64)),
                pa.array(_deviation(x, model.n, model.sums), pa.int64()).take(pa.array(each)), pa.array(scores.ravel()),
                pa.array(np.tile(model.values / model.trace, len(x))), pa.array(np.full(len(each), model.identity_error))],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])


def whiten(rows: DataFrame, scratch: Scratch, id_column: str = "vec_id", vector_column: str = "embedding",
           components: int = COMPONENTS) -> DataFrame:
    """One row per kept vector and component: vec_id, component, n, deviation, whitened,
    explained and identity_error."""
    spark = rows.sparkSession
    bound_batches(spark)
    every = lattice(rows, id_column, vector_column)
    kind = every.schema["id"].dataType
    model, size = fit(every, scratch, components)
    names = (f"vec_id {kind.simpleString()}, component int, n long, deviation long, whitened double, explained double, "
             "identity_error double")
    if model is None or not len(model.values):
        return spark.createDataFrame([], names)
    return every.where(F.size("x") == size).mapInArrow(lambda b: _whiten(b, model), names)


def query(spark, sf_dir):
    return whiten(table(spark, sf_dir, "embeddings"), Scratch(spark, "whitening"))
