"""Many small numbers sent between tasks as few rows: compressed arrays under a key that Spark shuffles by.

Also fixed-size key filters: a bitmap with as many bits at every input size, which lets a later scan send fewer rows.
A filter only ever lets too much through, so results do not depend on it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedforge.llm.words import chunks, mixed

#: Bits of a key filter: 2 MB, whatever the input.
FILTER_BITS = 24
#: Keys that may be broadcast: about 32 MB as Spark holds them.
BROADCAST_KEYS = 1 << 20


def packed(values: np.ndarray, rising: bool = False) -> bytes:
    """An array as compressed bytes; ``rising`` stores differences, which suit sorted integers."""
    if rising and len(values):
        values = np.diff(values, prepend=values.dtype.type(0))
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values).tobytes())


def unpacked(data: bytes, dtype: str, rising: bool = False) -> np.ndarray:
    values = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype)
    return np.cumsum(values, dtype=dtype) if rising else values


def by_part(part: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """A stable order by ``part`` and the bounds of each part in it."""
    small = part.astype(np.uint16 if parts <= 1 << 16 else np.int64)
    order = np.argsort(small, kind="stable")
    return order, np.searchsorted(small[order], np.arange(parts + 1))


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    """Bytes of all texts; sets how many parts later steps use."""
    return docs.agg(F.sum(F.octet_length(text))).first()[0] or 0


def parts_for(size: int, each: int, least: int = 12) -> int:
    return max(least, -(-size // each))


def key_filter(keys: DataFrame, key: str, bits: int = FILTER_BITS) -> np.ndarray:
    """A bitmap of ``keys`` (long): combined on the executors, at most 2**bits / 64 rows reach the driver."""
    place = F.shiftrightunsigned(F.col(key), 8).bitwiseAND((1 << bits) - 1).alias("place")
    words = keys.select(place).select(
        F.shiftright("place", 6).alias("word"), F.expr("shiftleft(1L, cast(place & 63 as int))").alias("bit")
    )
    rows = words.groupBy("word").agg(F.bit_or("bit").alias("bit")).toPandas()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[rows["word"].to_numpy(np.int64)] = rows["bit"].to_numpy(np.int64).view(np.uint64)
    return out


def passes(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of ``keys`` (uint64) the filter lets through."""
    place = (keys >> np.uint64(8)) & np.uint64(64 * len(bitmap) - 1)
    return (bitmap[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def own_columns(df: DataFrame) -> list[str]:
    """Column names quoted for select, whatever characters they have."""
    return ["`" + c.replace("`", "``") + "`" for c in df.columns]


def rows_without(df: DataFrame, key: Column, gone: DataFrame, once: DataFrame | None = None) -> DataFrame:
    """Rows of ``df`` whose ``key`` (long) is not in ``gone`` (key long); of those whose key is in ``once``, one per key stays.

    Both tables of keys should be written: they are counted and read more than once. ``key`` must be computed from the row's own
    values, so that every scan gives a row the same one. Up to ``BROADCAST_KEYS`` keys are broadcast, after counting them, and no row
    moves. With more, rows that a filter of keys lets through are joined; all others, which are most of a large table as
    long as the filter is not full, stay in their task. The result is the same.
    """
    columns, name = own_columns(df), free_name(df, "key_of_row")
    if once is not None and once.isEmpty():
        once = None
    listed = gone.select("key") if once is None else gone.select("key").union(once.select("key"))
    marked = listed.select(F.col("key").alias(name))
    keyed = df.withColumn(name, key)
    if listed.count() <= BROADCAST_KEYS:
        kept = keyed.join(F.broadcast(marked), name, "left_anti").select(*columns)
        return kept if once is None else kept.union(_once(keyed, name, F.broadcast(once)).select(*columns))
    bitmap = key_filter(listed, "key")

    def passing(wanted: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keys = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False)
                yield batch.filter(pa.array(passes(bitmap, keys.view(np.uint64)) == wanted))

        plain = keyed.toDF(*(f"c{i}" for i in range(len(keyed.columns))))  # names with dots cannot enter Arrow functions
        return plain.mapInArrow(run, plain.schema).toDF(*keyed.columns)

    doubtful = passing(True)
    kept = passing(False).select(*columns).union(doubtful.join(marked, name, "left_anti").select(*columns))
    return kept if once is None else kept.union(_once(doubtful, name, once).select(*columns))


def _once(keyed: DataFrame, name: str, once: DataFrame) -> DataFrame:
    """One row per key of ``once``."""
    return keyed.join(once.select(F.col("key").alias(name)), name, "left_semi").dropDuplicates([name])


def record_batch(schema: pa.Schema, columns: Iterable) -> pa.RecordBatch:
    """A batch of ``schema`` from numpy arrays, lists or Arrow arrays."""
    made = [c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)]
    return pa.RecordBatch.from_arrays(made, schema=schema)



def numbered(docs: DataFrame) -> DataFrame:
    """doc_id, text and ``row``, a number that every scan of the same table gives the same row."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.monotonically_increasing_id().alias("row"))


def block_of(rows: np.ndarray, blocks: int) -> np.ndarray:
    return (mixed(rows.astype(np.int64).view(np.uint64)) % np.uint64(blocks)).astype(np.int64)


def text_blocks(rows: DataFrame, blocks: int) -> DataFrame:
    """Whole rows of :func:`numbered` dealt evenly to ``blocks`` groups: (block, data), many compressed rows in each."""
    schema = pa.schema([("block", pa.int64()), ("data", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        options = pa.ipc.IpcWriteOptions(compression="zstd")
        for chunk in chunks(batches, limit=8 << 20):
            rows = chunk.batch.slice(chunk.first, len(chunk))
            order, bounds = by_part(block_of(rows.column("row").to_numpy(), blocks), blocks)
            found, data = [], []
            for block in np.flatnonzero(np.diff(bounds)):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, rows.schema, options=options) as out:
                    out.write_batch(rows.take(pa.array(order[bounds[block] : bounds[block + 1]])))
                found.append(block)
                data.append(sink.getvalue().to_pybytes())
            yield record_batch(schema, [found, data])

    return rows.mapInArrow(run, "block long, data binary")


def texts_of(table: pa.Table) -> Iterator[pa.RecordBatch]:
    """The rows that :func:`text_blocks` put into the rows of ``table``."""
    for data in table.column("data"):
        yield from pa.ipc.open_stream(data.as_buffer())
