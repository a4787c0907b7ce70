"""Words of whole texts as 64-bit fingerprints, computed in numpy over Arrow buffers.

A word is a run of bytes other than space, tab, line feed, vertical tab, form feed and carriage return. Fingerprints are
64 bits wide: two different words, or word sequences, are taken for equal with probability 2**-64 per pair.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are handled at once; a longer text is one chunk by itself, hashed piece by piece.
CHUNK_BYTES = 512 << 10
PIECE_BYTES = 256 << 10
#: Longer words go through BLAKE2: sums of powers are equal for some pairs of words of 1024 bytes, whatever the base.
LONG_WORD = 64

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_STEP = 0xD6E8FEB86659FD93


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit integers whose every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_OF_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, PIECE_BYTES + 1), base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if n <= 4 * PIECE_BYTES:
            _powers[base] = have
    return have[:n]


class Chunk:
    """Some whole documents: ``rows`` of the source batch, their bytes, and where each one's bytes begin and end."""

    def __init__(self, batch: pa.RecordBatch, first: int, last: int, data: np.ndarray, offsets: np.ndarray):
        self.batch, self.first, self.last = batch, first, last
        self.data, self.offsets = data, offsets

    def __len__(self) -> int:
        return self.last - self.first

    def column(self, name: str) -> pa.Array:
        return self.batch.column(self.batch.schema.get_field_index(name)).slice(self.first, len(self))

    def only(self, which: np.ndarray) -> Chunk:
        """The chunk of those documents alone for which ``which`` (boolean) holds."""
        batch = self.batch.slice(self.first, len(self)).filter(pa.array(which))
        lengths = np.diff(self.offsets)
        data = self.data[ranges(self.offsets[:-1][which], lengths[which])]
        return Chunk(batch, 0, batch.num_rows, data, np.concatenate([[0], np.cumsum(lengths[which])]))

    def texts(self) -> list[str]:
        data = self.data.tobytes()
        return [data[a:b].decode() for a, b in zip(self.offsets[:-1], self.offsets[1:], strict=True)]

    def bounds(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Begin and end of each word in ``data``, and per document the number of words before it (one entry more)."""
        n = len(self.data)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(self) + 1, np.int64)
        space = _SPACE[self.data]
        opens, closes = ~space, ~space
        inner = self.offsets[(self.offsets > 0) & (self.offsets < n)]
        head, tail = opens[inner], closes[inner - 1]
        opens[1:] &= space[:-1]
        closes[:-1] &= space[1:]
        opens[inner], closes[inner - 1] = head, tail
        begin = np.flatnonzero(opens)
        end = np.flatnonzero(closes) + 1
        return begin, end, np.searchsorted(begin, self.offsets)

    def words(self, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Fingerprints of all words, and per document the number of words before it (one entry more)."""
        begin, end, first = self.bounds()
        return hashed(_LOWER[self.data] if lower else self.data, begin, end), first


def hashed(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A fingerprint of the bytes of each span; spans are in order and do not overlap."""
    out = np.empty(len(begin), np.uint64)
    at = 0
    while at < len(begin):
        to = max(at + 1, int(np.searchsorted(end, begin[at] + PIECE_BYTES, side="right")))
        low, high = int(begin[at]), int(end[to - 1])
        total = np.zeros(high - low + 1, np.uint64)
        np.cumsum(_OF_BYTE[data[low:high]] * _power(_BASE, high - low), out=total[1:])
        b, e = begin[at:to] - low, end[at:to] - low
        sums = (total[e] - total[b]) * _power(_INVERSE, high - low + 1)[b]
        out[at:to] = mixed(sums + (e - b).astype(np.uint64))
        at = to
    for i in np.flatnonzero(end - begin > LONG_WORD):
        digest = hashlib.blake2b(data[begin[i] : end[i]].tobytes(), digest_size=8).digest()
        out[i] = np.frombuffer(digest, np.uint64)[0]
    return out


def rolling(words: np.ndarray, width: int) -> np.ndarray:
    """A fingerprint of every ``width`` consecutive words, by doubling; windows may span documents."""
    if len(words) < width:
        return np.zeros(0, np.uint64)
    made, size, step = words, 1, _STEP
    out, done = None, 0
    while True:
        if width & size:
            if out is None:
                out = made
            else:
                n = len(words) - (done + size) + 1
                out = out[:n] * np.uint64(step) + made[done : done + n]
            done += size
        if 2 * size > width:
            return mixed(out + np.uint64(width))
        n = len(words) - 2 * size + 1
        made = made[:n] * np.uint64(step) + made[size : size + n]
        size, step = 2 * size, step * step % (1 << 64)


def window_counts(first: np.ndarray, width: int) -> np.ndarray:
    """Windows of each document."""
    return np.maximum(np.diff(first) - width + 1, 0)


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The integers start, start + 1, ... of each (start, count), one after another."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(counts)
    return np.arange(total) + np.repeat(starts - (ends - counts), counts)


def chunks(batches: Iterable[pa.RecordBatch], text: str = "text", limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Cut batches into chunks of about ``limit`` bytes of text; a null text counts as empty."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index(text)).cast(pa.large_string()).fill_null("")
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        raw = column.buffers()[2]
        data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
        first = 0
        while first < len(column):
            last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
            last = min(max(last, first + 1), len(column))
            own = offsets[first : last + 1]
            yield Chunk(batch, first, last, data[own[0] : own[-1]], own - own[0])
            first = last
