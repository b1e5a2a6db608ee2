"""Whitening of embeddings by shifted CholeskyQR.

Vectors are put on a grid of whole numbers, ``floor(scale * c)``, so that equal ones
can be found and sums are exact. The fit list holds each distinct grid vector once. Its
centred rows are the tall matrix A: n rows, spread over the cluster, p columns.

1. A Gram pass sums Q'Q over all rows, Q being A in the first pass. Every task adds up
   its own rows, p x p numbers leave it.
2. The driver takes the Cholesky factor of that small matrix. Where it is not safely
   positive definite (first pass, dependent columns) a shift is added to its diagonal.
3. The next pass solves Q R = A row by row, by forward substitution through all factors
   so far. Three passes orthogonalise A to rounding; more follow only where a shift was
   needed again.
4. The factors' product R has A's singular values and right vectors: its SVD gives the
   components without ever squaring A's condition into them.

What grows with the corpus stays in Spark tables; the driver sees p sums and one p x p
matrix a pass.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caudal.llm.tables import kept

SCALE = 256
COMPONENTS = 4
_ROWS = 4096  # rows worked on at once
_PASSES = 12  # Gram passes at most; three do where the columns are independent
_UNIT = np.finfo(np.float64).eps / 2


@dataclass(frozen=True)
class Whitening:
    """A fitted transform: ``n`` vectors with exact ``sums``; ``axes`` (p x k) unit components.

    ``values`` are the variances along the axes, falling; ``total`` is the sum of all
    variances; ``identity_error`` the measured distance of the whitened covariance from
    the identity (None without a component that varies).
    """

    n: int
    sums: tuple[int, ...]
    axes: np.ndarray
    values: np.ndarray
    total: float
    identity_error: float | None

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums], np.float64)


def usable(rows: DataFrame, column: str = "embedding") -> DataFrame:
    """Rows whose vector is neither null nor empty and has only finite entries."""
    finite = F.forall(column, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))))
    return rows.filter(F.col(column).isNotNull() & (F.size(column) > 0) & finite)


def on_grid(rows: DataFrame, column: str = "embedding", scale: int = SCALE, into: str = "x") -> DataFrame:
    """``rows`` with their vectors as whole numbers, ``floor(scale * c)``."""
    return rows.withColumn(into, F.transform(column, lambda c: F.floor(F.lit(float(scale)) * c.cast("double"))))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False)).reshape(-1, width)


def _pieces(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[np.ndarray]:
    for batch in batches:
        for at in range(0, batch.num_rows, _ROWS):
            yield _matrix(batch.column(0).slice(at, _ROWS), width)


def _solved(rows: np.ndarray, factor: np.ndarray) -> np.ndarray:
    """Q of Q R = rows, for an upper triangular R."""
    out = np.empty_like(rows)
    for j in range(factor.shape[0]):
        out[:, j] = (rows[:, j] - out[:, :j] @ factor[:j, j]) / factor[j, j]
    return out


def _summed(parts: DataFrame) -> list:
    """Sums over all tasks of the arrays in ``v``, position by position."""
    sums = parts.select(F.posexplode("v").alias("at", "v")).groupBy("at").agg(F.sum("v").alias("v"))
    return [r["v"] for r in sums.orderBy("at").collect()]


def _exact_sums(fit: DataFrame, width: int) -> tuple[int, list[int]]:
    """Rows and the sum of every dimension, as whole numbers of any size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * (width + 1)
        for x in _pieces(batches, width):
            # Halves of 32 bits: 4,096 of them can't leave 64 bits.
            high, low = (x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)
            total[0] += len(x)
            for j in range(width):
                total[j + 1] += (int(high[j]) << 32) + int(low[j])
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.decimal128(38, 0)))], ["v"])

    n, *sums = [int(v) for v in _summed(fit.mapInArrow(run, "v array<decimal(38,0)>"))] or [0] * (width + 1)
    return n, sums


def _gram(fit: DataFrame, mean: np.ndarray, factors: list[np.ndarray]) -> np.ndarray:
    """Q'Q over all rows, Q being the centred rows solved through ``factors``."""
    width = len(mean)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for x in _pieces(batches, width):
            q = x - mean
            for factor in factors:
                q = _solved(q, factor)
            total += q.T @ q
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel()], pa.list_(pa.float64()))], ["v"])

    total = np.array(_summed(fit.mapInArrow(run, "v array<double>")), np.float64).reshape(width, width)
    return (total + total.T) / 2


def _factor(gram: np.ndarray, n: int, first: bool) -> tuple[np.ndarray, bool]:
    """The Cholesky factor of ``gram`` and whether its diagonal had to be shifted."""
    p = len(gram)
    values = np.linalg.eigvalsh(gram)
    shift = 11 * (n * p + p * (p + 1)) * _UNIT * float(values[-1])
    shifted = first or values[0] <= shift
    while True:
        try:
            return np.linalg.cholesky(gram + shift * shifted * np.eye(p)).T, shifted
        except np.linalg.LinAlgError:
            shifted, shift = True, 2 * shift


def _decomposed(fit: DataFrame, n: int, mean: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Singular values of the centred rows, falling, and their right vectors as columns."""
    p = len(mean)
    factors: list[np.ndarray] = []
    product = np.eye(p)
    for turn in range(_PASSES):
        gram = _gram(fit, mean, factors)
        if not np.any(gram):
            return np.zeros(p), np.eye(p)
        if turn > 2 and not shifted:
            break  # two passes without a shift: orthogonal to rounding
        factor, shifted = _factor(gram, n, turn == 0)
        factors.append(factor)
        product = factor @ product
        if turn >= 2 and not shifted:
            break
    _, singular, right = np.linalg.svd(product)
    return singular, right.T


def _whitened(x: np.ndarray, mean: np.ndarray, axes: np.ndarray, values: np.ndarray) -> np.ndarray:
    return (x - mean) @ axes / np.sqrt(values)


def _identity_error(fit: DataFrame, mean: np.ndarray, axes: np.ndarray, values: np.ndarray, n: int) -> float | None:
    """Largest entry of the whitened rows' covariance minus the identity, measured over all rows."""
    width, k = axes.shape
    if k == 0:
        return None

    def sums_of(centre: np.ndarray | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(k) if centre is None else np.zeros((k, k))
            for x in _pieces(batches, width):
                w = _whitened(x, mean, axes, values)
                total += w.sum(axis=0) if centre is None else (w - centre).T @ (w - centre)
            yield pa.RecordBatch.from_arrays([pa.array([total.ravel()], pa.list_(pa.float64()))], ["v"])

        return np.array(_summed(fit.mapInArrow(run, "v array<double>")), np.float64)

    centre = sums_of(None) / n
    covariance = sums_of(centre).reshape(k, k) / n
    return float(np.abs(covariance - np.eye(k)).max())


def fit(vectors: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """Fit on ``vectors`` (one column of equally long arrays of whole numbers), each distinct one once.

    None for an empty table. Vectors of different lengths are an error, found before the
    fit. Entries must fit 53 bits. A direction in which nothing varies (rank below
    ``components``, equal vectors, a single one) is no component.
    """
    found = kept(vectors.distinct(), "grid-vectors")
    column = found.columns[0]
    widths = found.select(F.min(F.size(column)), F.max(F.size(column))).first()
    if widths[0] is None:
        return None
    if widths[0] != widths[1]:
        raise ValueError(f"vectors of {widths[0]} to {widths[1]} dimensions can't be whitened together")
    n, sums = _exact_sums(found, widths[0])
    mean = np.array([s / n for s in sums], np.float64)
    singular, right = _decomposed(found, n, mean)
    least = singular[0] * max(n, len(mean)) * 2 * _UNIT
    k = min(components, int((singular > least).sum()))
    axes, values = right[:, :k], singular[:k] ** 2 / n
    # One sign for an axis: its largest entry is positive.
    axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(k)])
    error = _identity_error(found, mean, axes, values, n)
    return Whitening(n, tuple(sums), axes, values, float((singular**2).sum() / n), error)


def _deviations(x: np.ndarray, n: int, sums: tuple[int, ...]) -> list[int | None]:
    """Exact sums over dimensions of (n x - S) squared; None beyond 64 bits."""
    farthest = n * int(np.abs(x).max(initial=0)) + max(map(abs, sums))
    if len(sums) * farthest**2 < 2**63:
        return ((n * x - np.array(sums, np.int64)) ** 2).sum(axis=1).tolist()
    exact = ((n * x.astype(object) - np.array(sums, object)) ** 2).sum(axis=1)
    return [int(v) if v < 2**63 else None for v in exact]


def whiten(
    rows: DataFrame, id_column: str = "vec_id", column: str = "embedding", components: int = COMPONENTS, scale: int = SCALE
) -> DataFrame:
    """Each usable row's coordinates along the first components, fitted on all usable rows.

    ``id_column, component (from 1), n, deviation, whitened, explained, identity_error``:
    a row for each usable input row and component. Rows whose vector is null, empty or
    holds a null or non-finite entry are left out; repeated ids and null ids each keep
    their rows; other columns are ignored, whatever their names. ``deviation`` is null
    where the exact value exceeds 64 bits. Components without variance are not returned;
    where no component varies (equal vectors, one vector) and in an empty table there
    are no rows. Vectors of different lengths are an error.
    """
    kind = rows.schema[id_column].dataType.simpleString()
    schema = (
        f"`{id_column}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    )
    grid = on_grid(usable(rows.select(F.col(id_column).alias("id"), F.col(column).alias("v")), "v"), "v", scale)
    grid = grid.select("x", "id")
    fitted = fit(grid.select("x"), components)
    if fitted is None:
        return rows.sparkSession.createDataFrame([], schema)
    mean, k = fitted.mean, len(fitted.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                part = batch.slice(at, _ROWS)
                x = _matrix(part.column(0), len(mean))
                w = _whitened(x, mean, fitted.axes, fitted.values)
                each = np.repeat(np.arange(len(x)), k)
                deviation = pa.array(_deviations(x, fitted.n, fitted.sums), pa.int64())
                size = len(each)
                columns = [
                    part.column(1).take(pa.array(each)),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(size, fitted.n, np.int64)),
                    deviation.take(pa.array(each)),
                    pa.array(w.ravel()),
                    pa.array(np.tile(fitted.values / fitted.total, len(x)) if k else np.zeros(0)),
                    pa.array(np.full(size, fitted.identity_error if k else 0.0)),
                ]
                names = [id_column, "component", "n", "deviation", "whitened", "explained", "identity_error"]
                yield pa.RecordBatch.from_arrays(columns, names)

    return grid.mapInArrow(run, schema)
