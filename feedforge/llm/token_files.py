"""Token ids of documents in ORC files (operator 2).

Layout: one row per document with ``doc_id``, ``block`` (the file's place in the order), ``place`` (the row's place in
its block), ``block_start`` (ids of the block before this row), ``n_tokens`` and ``tokens``. Rows ascend by ``doc_id``
over blocks and within them. ORC keeps integers in run-length encoded stripes with a row index per ``ROW_INDEX_STRIDE``
rows and a Bloom filter on ``doc_id``; stripes are read in parallel, and a filter on ``doc_id`` skips files, stripes and
row groups by their statistics and Bloom filters.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from feedforge.llm.exchange import BROADCAST_KEYS, parts_for, record_batch, text_bytes
from feedforge.llm.tokens import encoder
from feedforge.llm.words import chunks
from feedforge.session import written

#: Bytes of text per block, bytes of a stripe, rows between two entries of the row index.
BLOCK_BYTES = 32 << 20
STRIPE_BYTES = 16 << 20
ROW_INDEX_STRIDE = 1000
#: Blocks whose totals are summed in one group.
SPAN = 4096

SCHEMA = "doc_id long, block int, place int, block_start long, n_tokens long, tokens array<int>"
_ARROW = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("block", pa.int32()),
        ("place", pa.int32()),
        ("block_start", pa.int64()),
        ("n_tokens", pa.int64()),
        ("tokens", pa.list_(pa.int32())),
    ]
)


def write_token_files(
    docs: DataFrame, path: str, tokenizer: str, spaces_dropped: bool = True, end_id: int = 1, block_bytes: int = BLOCK_BYTES
) -> None:
    """Encode every text of ``docs`` (doc_id, text) and write the rows in ascending doc_id order.

    A null text counts as empty, so each document has at least ``end_id``. Null ids come first. Rows with equal ids
    follow one another, ordered by a hash of their text, then by their place in the input; none is dropped. Other columns are ignored.
    An empty table gives no rows. Hot ids cause no large block, since the order is cut by range over (id, hash, place).
    """
    parts = parts_for(text_bytes(docs), block_bytes, least=4)
    order = [F.col("doc_id").asc_nulls_first(), "text_hash", "row"]
    ordered = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
        .withColumn("text_hash", F.xxhash64("text"))
        .withColumn("row", F.monotonically_increasing_id())
        .repartitionByRange(parts, *order)
        .sortWithinPartitions(*order)
        .select("doc_id", "text")
    )

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to_ids = encoder(tokenizer, spaces_dropped, end_id)
        block, place, start = TaskContext.get().partitionId(), 0, 0
        for chunk in chunks(batches):
            ids, offsets = to_ids.encode(chunk.texts())
            n = len(chunk)
            yield record_batch(
                _ARROW,
                [
                    chunk.column("doc_id"),
                    np.full(n, block),
                    place + np.arange(n),
                    start + offsets[:-1],
                    np.diff(offsets),
                    pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids)),
                ],
            )
            place, start = place + n, start + int(offsets[-1])

    (
        ordered.mapInArrow(encode, SCHEMA)
        .write.option("orc.compress", "ZSTD")
        .option("orc.stripe.size", STRIPE_BYTES)
        .option("orc.create.index", "true")
        .option("orc.row.index.stride", ROW_INDEX_STRIDE)
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .orc(path)
    )


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """The written rows with ``start``: the ids of all documents before each one.

    Block totals come from two narrow columns and are written, one row per block. Up to ``BROADCAST_KEYS`` blocks they are
    broadcast after counting them, so that no array of ids moves; a longer table of blocks (some 32 TB of text by
    default) is joined by shuffle, with the same result.
    """
    rows = spark.read.schema(SCHEMA).orc(path)
    totals = rows.groupBy("block").agg(F.max(F.col("block_start") + F.col("n_tokens")).alias("block_tokens"))
    starts = written(_block_starts(written(totals, "token-blocks")), "token-starts")
    if starts.count() <= BROADCAST_KEYS:
        starts = F.broadcast(starts)
    return rows.join(starts, "block").withColumn("start", F.col("before") + F.col("block_start")).drop("before")


def _block_starts(totals: DataFrame) -> DataFrame:
    """(block, before): ids of all earlier blocks, summed within spans of ``SPAN`` blocks and over the spans' totals."""
    span = F.floor(F.col("block") / SPAN)
    spans = totals.groupBy(span.alias("span")).agg(F.sum("block_tokens").alias("span_tokens"))
    spans = spans.select("span", (F.sum("span_tokens").over(Window.orderBy("span")) - F.col("span_tokens")).alias("spans_before"))
    inside = F.sum("block_tokens").over(Window.partitionBy("span").orderBy("block")) - F.col("block_tokens")
    placed = totals.withColumn("span", span).withColumn("inside", inside).join(spans, "span")
    return placed.select("block", (F.col("spans_before") + F.col("inside")).alias("before"))


def token_digests(rows: DataFrame) -> DataFrame:
    """Per document of :func:`read_token_files`: doc_id, start, n_tokens and the crc32 of its ids."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            offsets = lists.offsets.to_numpy()
            data = lists.values.to_numpy().astype("<u4").tobytes()
            crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield record_batch(schema, [batch.column(0), batch.column(1), np.diff(offsets), crc])

    return rows.select("doc_id", "start", "tokens").mapInArrow(
        digest, "doc_id long, start long, n_tokens long, ids_crc32 long"
    )
