"""Removal of repeated passages by fixed-block anchors (operator 10).

Reference blocks are the non-overlapping ``BLOCK``-word blocks of every document; each ``WINDOW``-word passage holds at
least one whole block, as ``WINDOW >= 2 * BLOCK - 1``. All rolling ``BLOCK``-word windows of all documents probe the blocks:
both go, as 32-bit prints under a shard of their fingerprint, to the shard's task, which marks every place that meets a
block elsewhere. Marks go back to the texts, where every passage around a mark is a candidate; neighbouring ones form the
extended, maximal repeats. Candidates are compared exactly, by 64-bit fingerprints of their whole word sequence: the first
one by (doc_id, row, start) stays, the words of all later ones are removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from feedforge.llm.exchange import (
    block_of,
    by_part,
    numbered,
    packed,
    parts_for,
    record_batch,
    text_blocks,
    text_bytes,
    texts_of,
    unpacked,
)
from feedforge.llm.words import chunks, ranges, rolling

WINDOW = 20
BLOCK = 10
#: Bytes of text per shard of fingerprints and per block of texts.
SHARD_BYTES = 12 << 20
BLOCK_BYTES = 12 << 20

_LEAST = -(1 << 63)
_PROBES = "shard long, rows binary, ids binary, first binary, at binary, prints binary, anchors binary"
_PROBE_SCHEMA = pa.schema([("shard", pa.int64()), *((n, pa.binary()) for n in ("rows", "ids", "first", "at", "prints", "anchors"))])
_PLACES = "block long, rows binary, places binary"
_PLACE_SCHEMA = pa.schema([("block", pa.int64()), ("rows", pa.binary()), ("places", pa.binary())])


def _dealt(keys: np.ndarray, at: np.ndarray, shards: int, rows, ids, first, width: str, anchors=None) -> pa.RecordBatch:
    """One row per shard with the prints of ``keys`` that belong to it; ``at``: their places in the chunk."""
    order, bounds = by_part(((keys >> np.uint64(40)) % np.uint64(shards)).astype(np.int64), shards)
    some = np.flatnonzero(np.diff(bounds))
    rows, ids, first = packed(rows), packed(ids), packed(first.astype(np.int32), rising=True)
    columns = [some, [rows] * len(some), [ids] * len(some), [first] * len(some), [], [], []]
    prints = keys.astype(width)
    for shard in some:
        own = order[bounds[shard] : bounds[shard + 1]]
        columns[4].append(packed(at[own].astype(np.int32), rising=True))
        columns[5].append(prints[own].tobytes())
        columns[6].append(b"" if anchors is None else packed(np.packbits(anchors[own])))
    return record_batch(_PROBE_SCHEMA, columns)


def _probes(rows: DataFrame, shards: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, limit=4 << 20):
            words, first = chunk.words()
            long_enough = np.diff(first) >= WINDOW
            counts = np.where(long_enough, np.diff(first) - BLOCK + 1, 0)
            at = ranges(first[:-1], counts)
            if len(at):
                start = np.repeat(first[:-1], counts)
                ids = chunk.column("doc_id").fill_null(_LEAST).to_numpy()
                yield _dealt(
                    rolling(words, BLOCK)[at], at, shards, chunk.column("row").to_numpy(), ids, first, "uint32",
                    (at - start) % BLOCK == 0,
                )

    return rows.mapInArrow(run, _PROBES)


def _gathered(table: pa.Table, width: str):
    """All probes of a shard: row, doc_id, place in the document, print, whether it is a block."""
    rows, ids, places, prints, anchors = [], [], [], [], []
    for row in table.to_pylist():
        at, first = unpacked(row["at"], "int32", rising=True), unpacked(row["first"], "int32", rising=True)
        own = np.searchsorted(first, at, side="right") - 1
        rows.append(unpacked(row["rows"], "int64")[own])
        ids.append(unpacked(row["ids"], "int64")[own])
        places.append(at - first[own])
        prints.append(np.frombuffer(row["prints"], width))
        if row["anchors"]:
            anchors.append(np.unpackbits(unpacked(row["anchors"], "uint8"), count=len(at)).astype(bool))
    return (np.concatenate(x) if x else None for x in (rows, ids, places, prints, anchors))


def _sent_back(rows: np.ndarray, places: np.ndarray, blocks: int) -> pa.Table:
    """Places under the block of texts that their row is in."""
    order = np.lexsort((places, rows))
    rows, places = rows[order], places[order]
    order, bounds = by_part(block_of(rows, blocks), blocks)
    some = np.flatnonzero(np.diff(bounds))
    own = [order[bounds[b] : bounds[b + 1]] for b in some]
    columns = [some, [packed(rows[o], rising=True) for o in own], [packed(places[o].astype(np.int32)) for o in own]]
    return pa.Table.from_batches([record_batch(_PLACE_SCHEMA, columns)])


def _marks(probes: DataFrame, blocks: int) -> DataFrame:
    def run(table: pa.Table) -> pa.Table:
        rows, _, places, prints, anchors = _gathered(table, "uint32")
        order = np.argsort(prints, kind="stable")
        heads = np.flatnonzero(np.concatenate([[True], prints[order][1:] != prints[order][:-1]]))
        counts = np.diff(np.append(heads, len(order)))
        good = (counts > 1) & (np.add.reduceat(anchors[order].astype(np.int64), heads) > 0)
        hit = order[np.repeat(good, counts)]
        return _sent_back(rows[hit], places[hit], blocks)

    return probes.groupBy("shard").applyInArrow(run, _PLACES)


def _repeated(candidates: DataFrame, blocks: int) -> DataFrame:
    def run(table: pa.Table) -> pa.Table:
        rows, ids, places, prints, _ = _gathered(table, "uint64")
        order = np.lexsort((places, rows, ids, prints))
        later = np.concatenate([[False], prints[order][1:] == prints[order][:-1]])
        hit = order[later]
        return _sent_back(rows[hit], places[hit], blocks)

    return candidates.groupBy("shard").applyInArrow(run, _PLACES)


def _by_row(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    rows = [unpacked(x, "int64", rising=True) for x in table.column("rows").to_pylist()]
    places = [unpacked(x, "int32") for x in table.column("places").to_pylist()]
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    rows, places = np.concatenate(rows), np.concatenate(places).astype(np.int64)
    order = np.argsort(rows, kind="stable")
    return rows[order], places[order]


def _placed(chunk, first: np.ndarray, rows: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Places in the chunk's word sequence of those (row, place) that belong to its documents."""
    own = chunk.column("row").to_numpy()
    low, high = np.searchsorted(rows, own), np.searchsorted(rows, own, side="right")
    return places[ranges(low, high - low)] + np.repeat(first[:-1], high - low)


def _candidates(texts: DataFrame, marks: DataFrame, shards: int) -> DataFrame:
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows, places = _by_row(right)
        out = []
        for chunk in chunks(texts_of(left), limit=4 << 20):
            words, first = chunk.words()
            marked = np.zeros(len(words) + 1, np.int64)
            marked[_placed(chunk, first, rows, places) + 1] = 1
            marked = np.cumsum(marked)
            at = ranges(first[:-1], np.maximum(np.diff(first) - WINDOW + 1, 0))
            at = at[marked[at + WINDOW - BLOCK + 1] > marked[at]]
            if len(at):
                ids = chunk.column("doc_id").fill_null(_LEAST).to_numpy()
                out.append(
                    _dealt(rolling(words, WINDOW)[at], at, shards, chunk.column("row").to_numpy(), ids, first, "uint64")
                )
        return pa.Table.from_batches(out, _PROBE_SCHEMA)

    return texts.groupBy("block").cogroup(marks.groupBy("block")).applyInArrow(run, _PROBES)


def without_repeats(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_words, n_removed, kept (its other words, joined by a space), kept_sha256.

    A null text has no words. Rows that repeat an id count as different documents, in the order of the input; null ids
    come first. Texts of fewer than ``WINDOW`` words lose nothing; other columns are ignored; an empty table gives no rows.
    Texts and fingerprints are dealt evenly to groups of bounded size, whatever repeats in them; fingerprints of one
    passage meet in one group as 5 to 9 bytes each.
    """
    size = text_bytes(docs)
    shards, blocks = parts_for(size, SHARD_BYTES), parts_for(size, BLOCK_BYTES)
    rows = numbered(docs)
    texts = text_blocks(rows, blocks)
    marks = _marks(_probes(rows, shards), blocks)
    repeated = _repeated(_candidates(texts, marks, shards), blocks)
    schema = pa.schema(
        [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string()), ("kept_sha256", pa.string())]
    )

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        of, places = _by_row(right)
        out = []
        for chunk in chunks(texts_of(left), limit=4 << 20):
            _, _, first = chunk.bounds()
            starts = _placed(chunk, first, of, places)
            cover = np.zeros(first[-1] + 1, np.int64)
            np.add.at(cover, starts, 1)
            np.add.at(cover, starts + WINDOW, -1)
            keep = np.cumsum(cover)[:-1] == 0
            kept_before = np.concatenate([[0], np.cumsum(keep)])
            removed = np.diff(first) - np.diff(kept_before[first])
            data, kept, digests = chunk.data.tobytes(), [], []
            for d, (a, b) in enumerate(zip(chunk.offsets[:-1], chunk.offsets[1:], strict=True)):
                words = data[a:b].split()
                if removed[d]:
                    words = compress(words, keep[first[d] : first[d + 1]].tolist())
                text = b" ".join(words)
                kept.append(text)
                digests.append(hashlib.sha256(text).hexdigest())
            out.append(record_batch(schema, [chunk.column("doc_id"), np.diff(first), removed, pa.array(kept, pa.binary()), digests]))
        return pa.Table.from_batches(out, schema)

    return texts.groupBy("block").cogroup(repeated.groupBy("block")).applyInArrow(
        run, "doc_id long, n_words long, n_removed long, kept string, kept_sha256 string"
    )


def removal_digests(docs: DataFrame) -> DataFrame:
    return without_repeats(docs).drop("kept")
