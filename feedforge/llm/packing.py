"""Bounded-space online packing of token ids into fixed windows (operator 3).

Each partition keeps at most ``OPEN_WINDOWS`` windows open. A document first fills whole windows by itself; the rest goes
to the open window it leaves the least room in. If it fits none, and no further window may be opened, the fullest window
is filled up with the document's next ids (if it has ``SHORTEST_CUT`` or more free places) and emitted. Windows still open
at a partition's end are merged over a tree of groups, each holding a bounded number of them, by the same rule; the last
group closes with cuts at any place, so all but its last sequence are full.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedforge.llm.exchange import record_batch
from feedforge.llm.tokens import encoder
from feedforge.llm.words import chunks
from feedforge.session import written

WINDOW = 2048
OPEN_WINDOWS = 64
SHORTEST_CUT = 16
#: Partitions whose open windows meet in one group of the merge.
FAN_IN = 16

#: Bytes of text encoded at once.
ENCODED_BYTES = 2 << 20

_NUMBERS = ("sequence_id", "offset", "doc_id", "start", "length", "doc_tokens")
#: Ids are little-endian integers of 2 bytes, or of 4 where one needs more; ``length`` tells which.
PIECES = ", ".join(f"{n} long" for n in _NUMBERS) + ", ids binary, part long"
_ARROW = pa.schema([(n, pa.int64()) for n in _NUMBERS] + [("ids", pa.binary()), ("part", pa.int64())])

#: (doc_id, start, ids of the piece, ids of the document)
Piece = tuple[int | None, int, np.ndarray, int]


class Packer:
    """Windows of one partition or merge group; ``emit`` gets the pieces of each finished window."""

    def __init__(self, emit: Callable[[list[Piece]], None], window: int, open_windows: int, shortest_cut: int):
        self.emit, self.window, self.most, self.shortest = emit, window, open_windows, shortest_cut
        self.free: list[int] = []
        self.held: list[list[Piece]] = []

    def add(self, doc_id: int | None, start: int, ids: np.ndarray, doc_tokens: int) -> None:
        while len(ids) >= self.window:
            self.emit([(doc_id, start, ids[: self.window], doc_tokens)])
            start, ids = start + self.window, ids[self.window :]
        while len(ids):
            fits = [f for f in self.free if f >= len(ids)]
            if fits:
                at = self.free.index(min(fits))
                self.held[at].append((doc_id, start, ids, doc_tokens))
                self.free[at] -= len(ids)
                if not self.free[at]:
                    self._close(at)
                return
            if len(self.free) < self.most:
                self.free.append(self.window - len(ids))
                self.held.append([(doc_id, start, ids, doc_tokens)])
                return
            at = self.free.index(min(self.free))
            room = self.free[at]
            if room >= self.shortest:
                self.held[at].append((doc_id, start, ids[:room], doc_tokens))
                start, ids = start + room, ids[room:]
            self._close(at)

    def _close(self, at: int) -> None:
        self.emit(self.held[at])
        del self.held[at], self.free[at]


class _Rows:
    """Pieces of finished windows until they are yielded as one Arrow batch."""

    def __init__(self, first_id: int):
        self.next_id = first_id
        self.rows: list[tuple] = []
        self.size = 0

    def close(self, pieces: list[Piece]) -> None:
        self.add(pieces, None)

    def add(self, pieces: list[Piece], part: int | None) -> None:
        offset = 0
        for doc_id, start, ids, doc_tokens in pieces:
            self.rows.append((self.next_id, offset, doc_id, start, len(ids), doc_tokens, ids, part))
            offset += len(ids)
        self.next_id += 1
        self.size += offset

    def batch(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows, strict=True)) if self.rows else [[] for _ in _ARROW]
        lengths = np.array(columns[4], np.int64)
        ids = np.concatenate(columns[6]) if self.rows else np.zeros(0, np.int32)
        ids = ids.astype("<u2" if not len(ids) or ids.max() < 1 << 16 else "<u4")
        offsets = np.concatenate([[0], np.cumsum(lengths) * ids.itemsize]).astype(np.int32)
        columns[6] = pa.BinaryArray.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(ids)])
        self.rows, self.size = [], 0
        return record_batch(_ARROW, columns)


def _ids(data: bytes, length: int) -> np.ndarray:
    """The ids of a piece as uint32."""
    return np.frombuffer(data, "<u2" if len(data) == 2 * length else "<u4").astype("<u4")


def pack(
    docs: DataFrame,
    tokenizer: str,
    end_id: int = 1,
    window: int = WINDOW,
    open_windows: int = OPEN_WINDOWS,
    shortest_cut: int = SHORTEST_CUT,
) -> DataFrame:
    """The pieces of :func:`pack_bytes` with their ids as arrays."""
    schema = pa.schema([*((n, pa.int64()) for n in _NUMBERS), ("ids", pa.list_(pa.int32()))])

    def arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column("length").to_pylist()
            ids = [_ids(data, n).view(np.int32) for data, n in zip(batch.column("ids").to_pylist(), lengths, strict=True)]
            yield record_batch(schema, [*batch.columns[:-1], ids])

    pieces = pack_bytes(docs, tokenizer, end_id, window, open_windows, shortest_cut).select(*_NUMBERS, "ids")
    return pieces.mapInArrow(arrays, ", ".join(f"{n} long" for n in _NUMBERS) + ", ids array<int>")


def pack_bytes(
    docs: DataFrame,
    tokenizer: str,
    end_id: int = 1,
    window: int = WINDOW,
    open_windows: int = OPEN_WINDOWS,
    shortest_cut: int = SHORTEST_CUT,
) -> DataFrame:
    """Pieces of all documents (doc_id, text) in windows of at most ``window`` ids.

    Rows: sequence_id, offset (in the sequence, gapless), doc_id, start (in the document), length, doc_tokens, ids (bytes,
    which Spark moves as a whole: little-endian, 2 bytes an id or 4, as ``length`` tells). Each id of each document is in
    one piece. A null text counts as empty: its piece holds ``end_id`` alone. Null and repeated ids are packed like others, row by row; other columns are ignored; an empty table gives no rows. Sequence ids are
    unique, not gapless. A partition's windows are written once to the shared folder, so a lost executor costs its own
    partitions only, and what was already packed keeps its sequence.
    """

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to_ids = encoder(tokenizer, False, end_id)
        part = TaskContext.get().partitionId()
        out = _Rows(part << 32)
        packer = Packer(out.close, window, open_windows, shortest_cut)
        for chunk in chunks(batches, limit=ENCODED_BYTES):
            ids, offsets = to_ids.encode(chunk.texts())
            for doc_id, a, b in zip(chunk.column("doc_id").to_pylist(), offsets[:-1], offsets[1:], strict=True):
                packer.add(doc_id, 0, ids[a:b], int(b - a))
                if out.size > 500_000:
                    yield out.batch()
        for pieces in packer.held:
            out.add(pieces, part)
        yield out.batch()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(first, PIECES)
    done = written(rows, "packed")
    level, parts = 1, (done.agg(F.max("part")).first()[0] or 0) + 1
    closed = done.filter("part is null")
    held = done.filter("part is not null")
    while True:
        parts = -(-parts // FAN_IN)
        last = parts == 1
        done = written(_merged(held, level, last, window, open_windows, shortest_cut), "packed")
        closed = closed.unionByName(done.filter("part is null"))
        held = done.filter("part is not null")
        level += 1
        if last:
            return closed.drop("part")


def _merged(held: DataFrame, level: int, last: bool, window: int, open_windows: int, shortest_cut: int) -> DataFrame:
    """Pack the open windows of ``FAN_IN`` neighbouring parts together; in the last group only the one open window is cut into."""

    def merge(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        group = key[0].as_py()
        out = _Rows((level << 56) + (group << 32))
        packer = Packer(out.close, window, 1 if last else open_windows, 1 if last else shortest_cut)
        numbers = {n: table.column(n).to_pylist() for n in _NUMBERS}
        windows: dict[int, list[int]] = {}
        for row in sorted(range(table.num_rows), key=lambda r: (numbers["sequence_id"][r], numbers["offset"][r])):
            windows.setdefault(numbers["sequence_id"][row], []).append(row)
        ids = table.column("ids").to_pylist()
        for rows in windows.values():
            for row in rows:
                own = _ids(ids[row], numbers["length"][row])
                packer.add(numbers["doc_id"][row], numbers["start"][row], own, numbers["doc_tokens"][row])
        for pieces in packer.held:
            out.add(pieces, None if last else group)
        return pa.Table.from_batches([out.batch()])

    return held.groupBy(F.floor(F.col("part") / FAN_IN).alias("group")).applyInArrow(merge, PIECES)


def piece_digests(pieces: DataFrame) -> DataFrame:
    """The pieces of :func:`pack_bytes` with the crc32 of their ids, as 4 bytes each, in place of the ids."""
    names = ("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset")
    schema = pa.schema([(n, pa.int64()) for n in (*names, "ids_crc32")])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column("length").to_pylist()
            crc = [zlib.crc32(_ids(data, n)) for data, n in zip(batch.column("ids").to_pylist(), lengths, strict=True)]
            yield record_batch(schema, [*batch.columns[:-1], crc])

    return pieces.select(*names, "ids").mapInArrow(digest, ", ".join(f"{n} long" for n in (*names, "ids_crc32")))
