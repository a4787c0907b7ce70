"""Whitening of embeddings by shifted Cholesky QR (operator 11).

1. Entries become integers x = floor(64 c) + 1000000. The fit list holds each distinct x vector once; count and sums over it
   are exact, so rows are centred without loss: x - S/n is an integer less a fraction below 1.
2. A pass over the fit list solves each centred row against the triangular factor so far and adds up the Gram matrix G of
   the solutions, a matrix per task. Its Cholesky factor, of G plus a small shift while G is far from the identity, is multiplied
   onto the factor. Passes end once G is the identity but for rounding, after three as a rule. Linearly dependent dimensions
   show in the second pass and are taken out.
3. The last G is factored by its eigenvectors, which needs no shift, so the composed factor R has R'R = X'X. The singular
   values s and right singular vectors of R give the components: eigenvalues s^2/n of the covariance.

No covariance of uncentred entries is formed, and the condition of the data enters R once, not squared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedforge.llm.exchange import record_batch
from feedforge.llm.vectors import as_long, task_sums, whole_vectors
from feedforge.session import written

SCALE = 64
OFFSET = 1_000_000
COMPONENTS = 16
#: Entries beyond this are taken for it, so that sums of x stay within 64 bits.
LARGEST = 1 << 40
MOST_PASSES = 6
#: Singular values below this share of the largest are rounding, not variance.
LEAST = 1e-10
_UNIT = float(np.finfo(float).eps) / 2


def integer_rows(table: DataFrame, vector: str) -> DataFrame:
    """All columns of the rows that remain, and ``its_x``, their integer entries."""
    x = F.transform(vector, lambda c: F.floor(F.greatest(F.least(SCALE * c.cast("double"), F.lit(LARGEST)), F.lit(-LARGEST))) + OFFSET)
    return table.select(x.cast("array<bigint>").alias("its_x"), "*")


def _integers(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column(0).flatten().to_numpy().reshape(batch.num_rows, -1)


class Centre:
    """n and S; rows are centred in two steps, first by the integer below S/n, then by the fraction that is left."""

    def __init__(self, n: int, sums: list[int]):
        self.n = n
        self.low = np.array([s // n for s in sums], np.int64)
        self.left = np.array([s % n for s in sums], np.int64)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.low) - self.left / self.n

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """Sum over dimensions of (n x - S)^2, exactly."""
        most = self.n * (int(np.abs(x - self.low).max(initial=0)) + 1)
        kind = np.int64 if most * most * max(1, x.shape[1]) < 1 << 62 else object
        apart = (x - self.low).astype(kind) * self.n - self.left.astype(kind)
        return (apart * apart).sum(axis=1)


def _gram(fit: DataFrame, centre: Centre, inverse: np.ndarray) -> np.ndarray:
    """Gram matrix of the centred rows times ``inverse``."""

    def part(batch: pa.RecordBatch) -> np.ndarray:
        rows = centre.centred(_integers(batch)) @ inverse
        return rows.T @ rows

    return task_sums(fit, ["its_x"], (inverse.shape[1], inverse.shape[1]), part)


def _cholesky(gram: np.ndarray, n: int) -> np.ndarray:
    """Upper factor of ``gram`` plus the least shift for which it exists and is safe."""
    d = len(gram)
    most = float(np.linalg.eigvalsh(gram)[-1])
    shift = min(11 * (n * d + d * (d + 1)) * _UNIT, 1e-6) * most
    if float(np.linalg.eigvalsh(gram)[0]) > 0.1 * most:
        shift = 0.0
    return np.linalg.cholesky(gram + shift * np.eye(d)).T


def triangular_factor(fit: DataFrame, centre: Centre, d: int) -> np.ndarray:
    """R with R'R = X'X for the centred fit list X, by repeated Gram passes.

    From the second pass on, directions whose singular value is below ``LEAST`` of the largest are taken out, as further
    passes would only orthogonalise their rounding. What is left is mapped by ``inwards``, whose right inverse is ``back``.
    """
    inwards, back, factor = np.eye(d), np.eye(d), np.eye(d)
    gram = _gram(fit, centre, back)
    for done in range(MOST_PASSES):
        values = np.linalg.eigvalsh(gram)
        if not values[-1] > 0 or (np.abs(values - 1) < 1e-6).all():
            break
        _, s, axes = np.linalg.svd(_root(gram) @ factor @ inwards, full_matrices=False)
        whole = s > LEAST * s[0]
        if done and not whole.all():
            inwards, back = s[whole, None] * axes[whole], axes[whole].T / s[whole]
            factor = np.eye(int(whole.sum()))
        else:
            factor = _cholesky(gram, centre.n) @ factor
        gram = _gram(fit, centre, back @ np.linalg.solve(factor, np.eye(len(factor))))
    return _root(gram) @ factor @ inwards


def _root(gram: np.ndarray) -> np.ndarray:
    """Some F with F'F = gram, which need not have full rank."""
    values, vectors = np.linalg.eigh(gram)
    return np.sqrt(np.maximum(values, 0))[:, None] * vectors.T


def whitened(table: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Per remaining row of ``table`` and component: ``key``, component, n, deviation, whitened, explained, identity_error.

    Rows whose vector is null or holds null or non-finite entries, and rows of another length than most, are left out. n is the
    number of distinct x vectors, deviation the exact sum of (n x - S)^2 (null beyond a long), whitened the projection of x - S/n
    over the square root of the component's variance, explained the component's share of all variance, identity_error the
    largest absolute entry of the covariance of whitened rows minus the identity, measured by a pass. Components are numbered
    from 1 by falling variance and signed so that their largest entry is positive; those without variance do not exist, so a table
    with a single distinct vector gives no rows. Rows that repeat a key, and null keys, have rows of their own; other columns are
    ignored; an empty table gives no rows. The fit list is one row per distinct vector, so copies do not gather; what tasks and
    driver hold is the square of the dimension.
    """
    rows = integer_rows(whole_vectors(table.select(F.col(key).cast("long").alias(key), vector), vector), vector).select("its_x", key)
    fit = written(rows.select("its_x").distinct(), "fit-list")
    spark = table.sparkSession
    out = f"{key} long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    first = fit.select(F.size("its_x")).first()
    if first is None:
        return spark.createDataFrame([], out)
    d = first[0]

    halves = task_sums(fit, ["its_x"], (3, d), _halves)
    n = int(halves[2, 0])
    centre = Centre(n, [int(high) * (1 << 20) + int(low) for high, low in zip(halves[0], halves[1], strict=True)])
    _, s, axes = np.linalg.svd(triangular_factor(fit, centre, d), full_matrices=False)
    count = min(components, int((s > LEAST * s[0]).sum()) if s[0] > 0 else 0)
    if not count:
        return spark.createDataFrame([], out)
    axes = axes[:count] * np.sign(axes[np.arange(count), np.abs(axes[:count]).argmax(axis=1)])[:, None]
    project = (axes / (s[:count, None] / np.sqrt(n))).T
    error = float(np.abs(_gram(fit, centre, project) / n - np.eye(count)).max())
    explained = s[:count] ** 2 / (s**2).sum()

    names = (key, "component", "n", "deviation", "whitened", "explained", "identity_error")
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64())
    schema = pa.schema(list(zip(names, kinds, strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = batch.num_rows
            if not m:
                continue
            x = _integers(batch)
            each = pa.array(np.repeat(np.arange(m), count))
            yield record_batch(
                schema,
                [
                    batch.column(1).take(each),
                    np.tile(np.arange(1, count + 1), m),
                    np.full(m * count, n),
                    as_long(centre.deviations(x)).take(each),
                    (centre.centred(x) @ project).ravel(),
                    np.tile(explained, m),
                    np.full(m * count, error),
                ],
            )

    return rows.mapInArrow(run, out)


def _halves(batch: pa.RecordBatch) -> np.ndarray:
    """Sums of the high and low parts of x, exact as doubles for up to 2**32 rows a part, and the number of rows."""
    x = _integers(batch)
    return np.stack([(x >> 20).sum(axis=0), (x & ((1 << 20) - 1)).sum(axis=0), np.full(x.shape[1], len(x))]).astype(float)
