"""What the operators on vectors share: which rows count, integer entries, sums of per-task matrices."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of per-task sums that the driver adds up.
SUMS = 16
#: Largest absolute entry for which plain 64-bit arithmetic is used.
_PLAIN = 1 << 20


def whole_vectors(table: DataFrame, vector: str = "embedding") -> DataFrame:
    """Rows of ``table`` whose vector is neither null nor empty and has finite entries only.

    Vectors are of one length, the commonest of these rows (of several, the largest); rows of another length are left out.
    """
    good = F.col(vector).isNotNull() & F.forall(vector, lambda c: c.isNotNull() & (F.abs(c) < float("inf")) & ~F.isnan(c))
    rows = table.filter(good & (F.size(vector) > 0))
    sizes = rows.groupBy(F.size(vector).alias("size")).agg(F.count(F.lit(1)).alias("n"))
    common = sizes.orderBy(F.desc("n"), F.desc("size")).select("size").first()
    return rows.filter(F.size(vector) == (common[0] if common else 0))


def matrix_of(column: pa.Array) -> np.ndarray:
    """A column of arrays of equal length as rows of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def floored(values: np.ndarray, factor: int) -> np.ndarray:
    """floor(factor * value) exactly: 64-bit integers, or Python integers where some value is large."""
    if not values.size or np.abs(values).max() * factor < _PLAIN:
        return np.floor(values * factor).astype(np.int64)
    exact = [int(v) * factor if abs(v) >= 1 << 53 else int(np.floor(v * factor)) for v in values.ravel().tolist()]
    return np.array(exact, object).reshape(values.shape)


def as_long(values: np.ndarray) -> pa.Array:
    """Integers as a long column, null where one does not fit."""
    if values.dtype != object:
        return pa.array(values.astype(np.int64))
    return pa.array([int(v) if -(1 << 63) <= v < 1 << 63 else None for v in values], pa.int64())


def task_sums(
    rows: DataFrame, columns: list[str], shape: tuple[int, int], part: Callable[[pa.RecordBatch], np.ndarray]
) -> np.ndarray:
    """The sum of ``part(batch)``, a matrix of doubles of this shape, over all batches of ``rows``.

    Each task sends one matrix, ``SUMS`` tasks add those up, and the driver adds ``SUMS`` matrices, at any size of the table.
    """
    schema = pa.schema([("data", pa.binary())])

    def total(matrices: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(shape)
        for matrix in matrices:
            held += matrix
        yield pa.RecordBatch.from_arrays([pa.array([held.tobytes()], pa.binary())], schema=schema)

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return total(part(batch) for batch in batches if batch.num_rows)

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return total(np.frombuffer(v.as_buffer()).reshape(shape) for batch in batches for v in batch.column(0))

    parts = rows.select(*columns).mapInArrow(one, "data binary").repartition(SUMS).mapInArrow(again, "data binary")
    return sum((np.frombuffer(r.data).reshape(shape) for r in parts.collect()), np.zeros(shape))
