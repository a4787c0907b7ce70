"""Benchmark passages in documents, found through templates (operator 7).

A text becomes a stream of words without outer punctuation, in lower case (A-Z). A template of it has one placeholder for
each number (with a unit of measure after it), other unit and run of names; the words themselves are the placeholder's value.
Two kinds of windows are hash-joined with those of the benchmark: windows of the words as they are, so that a copy is found
whatever it consists of, and windows of the template that hold a placeholder but are mostly literal. Both match words of the
item with words of the document. The matches of an item are added up in ascending order, over distances that change little
from one match to the next, so words may be inserted or dropped. Each value of the item must always meet the same value
in the document: where it does not, the windows that hold the rarer meeting do not count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedforge.llm.exchange import key_filter, passes, record_batch, rows_without
from feedforge.llm.words import _LOWER, Chunk, chunks, hashed, mixed, ranges, rolling
from feedforge.session import written

WINDOW = 8
#: Least share of literal words in a window of a template, in quarters: windows of placeholders say little.
LEAST_LITERAL = 2
#: An alignment counts if it covers so many words in hundredths of the item, or so many words.
LEAST_SHARE = 50
LEAST_WORDS = 25

# Units of measure.
UNITS = (
    "mm cm m km inch inches ft foot feet yard yards mile miles mg g kg lb lbs ounce ounces ton tons ml l liter liters "
    "litre litres gallon gallons second seconds minute minutes hour hours day days week weeks month months year years "
    "percent dollar dollars cent cents euro euros pound pounds degree degrees watt watts volt volts joule joules mph kmh"
).split()

_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[c for c in range(33, 127) if not chr(c).isalnum()]] = True
_NUMBER, _UNIT, _NAME = (mixed(np.array([x], np.uint64))[0] for x in (11, 12, 13))


def _hash_of(words: list[str]) -> np.ndarray:
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    return np.sort(hashed(data, ends - np.array([len(w) for w in words]), ends))


class _Stream:
    """Canonical words of a chunk, the tokens of its template, and how many of either lie before each document."""

    def __init__(self, chunk: Chunk):
        data = chunk.data
        begin, end, first = chunk.bounds()
        solid = np.flatnonzero(~_PUNCTUATION[data])
        head = np.searchsorted(solid, begin)
        tail = np.searchsorted(solid, end) - 1
        full = tail >= head
        last = data[end - 1] if len(end) else np.zeros(0, np.uint8)
        opens = np.ones(len(begin), bool)  # whether a word begins a sentence
        opens[1:] = np.isin(last[:-1], np.frombuffer(b".!?:", np.uint8))
        opens[first[:-1][np.diff(first) > 0]] = True
        lines = np.cumsum(np.concatenate([[0], data == 10]))
        opens[1:] |= lines[begin[1:]] > lines[begin[:-1]] if len(begin) else False
        before = np.concatenate([[0], np.cumsum(full)])
        begin, end, opens = solid[head[full]], solid[tail[full]] + 1, opens[full]
        self.first = before[first]
        self.words = words = hashed(_LOWER[data], begin, end)
        digits = np.concatenate([[0], np.cumsum((data >= 48) & (data <= 57))])
        number = digits[end] > digits[begin]
        capital = (data[begin] >= 65) & (data[begin] <= 90) if len(begin) else np.zeros(0, bool)
        small = np.concatenate([[0], np.cumsum((data >= 97) & (data <= 122))])
        name = capital & ~opens & ~number & (small[end] > small[begin])
        unit = np.isin(words, _hash_of(UNITS)) & ~number & ~name
        starts = np.ones(len(words), bool)  # whether a word begins a token
        starts[1:] = ~((name[1:] & name[:-1]) | (unit[1:] & number[:-1]))
        starts[self.first[:-1][np.diff(self.first) > 0]] = True
        #: The word each token begins with (one entry more).
        self.at = np.append(np.flatnonzero(starts), len(words))
        own, sizes = self.at[:-1], np.diff(self.at)
        kind = np.where(number, _NUMBER, np.where(name, _NAME, np.where(unit, _UNIT, np.uint64(0))))[own]
        value = words[own]
        for t in np.flatnonzero(sizes > 1).tolist():
            value[t] = rolling(words[self.at[t] : self.at[t + 1]], int(sizes[t]))[0]
        self.template = np.where(kind > 0, kind, value)
        self.value = np.where(kind > 0, value, np.uint64(0))
        self.tokens = np.searchsorted(own, self.first)

    def copies(self, width: int, each: np.ndarray):
        """Start (a word), document and key of the windows of ``width`` words of the documents ``each``."""
        return _windows(self.words, self.first, width, each, 0)

    def templates(self, width: int, each: np.ndarray):
        """Start (a token), document and key of the windows of ``width`` tokens, mostly literal ones with a placeholder."""
        at, owner, keys = _windows(self.template, self.tokens, width, each, 1)
        until = np.concatenate([[0], np.cumsum(self.value == 0)])
        literal = until[at + width] - until[at]
        good = (4 * literal >= LEAST_LITERAL * width) & (literal < width)
        return at[good], owner[good], keys[good]

    def slots(self, start: int, end: int) -> tuple[list[int], list[int]]:
        """Values and numbers of words of the tokens of some words; a token that is cut counts as single literal words."""
        values, sizes = [], []
        t = int(np.searchsorted(self.at, start, side="right")) - 1
        while self.at[t] < end:
            a, b = int(self.at[t]), int(self.at[t + 1])
            whole = start <= a and b <= end
            n = min(b, end) - max(a, start)
            values += [int(self.value.view(np.int64)[t])] if whole else [0] * n
            sizes += [n] if whole else [1] * n
            t += 1
        return values, sizes


def _windows(stream: np.ndarray, first: np.ndarray, width: int, each: np.ndarray, kind: int):
    counts = np.where(each, np.maximum(np.diff(first) - width + 1, 0), 0)
    at = ranges(first[:-1], counts)
    if not len(at):
        return at, at, np.zeros(0, np.uint64)
    keys = mixed(rolling(stream, width)[at] ^ np.uint64(2 * width + kind))
    return at, np.repeat(np.arange(len(counts)), counts), keys


def _rows(table: DataFrame, ident: str, kinds: list[tuple[int, int]] | None, wanted: np.ndarray | None) -> DataFrame:
    """Rows (key, id, row, place, kind, width, n_words, values, sizes): a window and its first word in the text.

    ``kind`` is 0 for windows of words and 1 for those of the template. ``values`` and ``sizes`` tell the tokens' values and
    numbers of words. Without ``kinds``, a text shorter than ``WINDOW`` gives one window of all it has; with them (kind,
    width), windows of words come without values and sizes, which are those of the item.
    """
    names = ("key", ident, "row", "place", "kind", "width", "n_words")
    lists = ("values", "sizes")
    schema = pa.schema([*((n, pa.int64()) for n in names), *((n, pa.list_(pa.int64())) for n in lists)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches):
            stream = _Stream(chunk)
            words = np.diff(stream.first)
            for kind, width in kinds or [(k, w) for k in (0, 1) for w in range(1, WINDOW + 1)]:
                size = np.diff(stream.tokens) if kind else words
                each = np.ones(len(chunk), bool) if kinds or width == WINDOW else size == width
                at, owner, keys = (stream.templates if kind else stream.copies)(width, each)
                if wanted is not None:
                    through = passes(wanted, keys)
                    at, owner, keys = at[through], owner[through], keys[through]
                if kind:
                    value = stream.value.view(np.int64)
                    values = [value[a : a + width] for a in at.tolist()]
                    sizes = [np.diff(stream.at[a : a + width + 1]) for a in at.tolist()]
                    at = stream.at[at]
                elif kinds is None:
                    slots = [stream.slots(a, a + width) for a in at.tolist()]
                    values, sizes = [v for v, _ in slots], [n for _, n in slots]
                else:
                    values = sizes = [()] * len(at)
                yield record_batch(
                    schema,
                    [
                        keys.view(np.int64),
                        chunk.column(ident).take(pa.array(owner)),
                        chunk.column("row").take(pa.array(owner)),
                        at - stream.first[owner],
                        np.full(len(at), kind),
                        np.full(len(at), width),
                        words[owner],
                        values,
                        sizes,
                    ],
                )

    types = ", ".join(f"{n} long" for n in names) + "".join(f", {n} array<long>" for n in lists)
    numbered = table.select(F.col(ident).cast("long").alias(ident), "text", F.monotonically_increasing_id().alias("row"))
    return numbered.mapInArrow(run, types)


#: Matched words: where they begin and end in the item, the same in the document, and their values (0: literal).
Cell = tuple[int, int, int, int, int, int]


def _cells(hit: dict) -> list[Cell]:
    """The matched words of a hit, token by token."""
    i, d, out = hit["item_place"], hit["place"], []
    values, sizes = hit["item_values"], hit["item_sizes"]
    pairs = zip(values, sizes, hit["values"] or values, hit["sizes"] or sizes, strict=True)
    for item_value, item_size, value, size in pairs:
        out.append((i, i + item_size, d, d + size, item_value, value))
        i, d = i + item_size, d + size
    return out


def _chain(cells: set[Cell], near: int) -> list[Cell]:
    """Cells in ascending order that cover most words of the item; among such ones those with most equal values.

    From one cell to the next the distance between item and document changes by at most ``near`` words.
    """
    if not cells:
        return []
    some = sorted(cells, key=lambda x: (x[2], x[0]))
    a, b, c, d = (np.array([x[k] for x in some]) for k in range(4))
    equal = np.array([x[4] == x[5] for x in some])
    score = (b - a) * (len(some) + 1) + equal
    back = np.full(len(some), -1)
    low = np.searchsorted(c, c - int(b.max()) - near - int((d - c).max()))
    for j in range(1, len(some)):
        at = slice(int(low[j]), j)
        apart, inside = c[j] - d[at], a[j] - b[at]
        before = np.where((apart >= 0) & (inside >= 0) & (np.abs(apart - inside) <= near), score[at], 0)
        if len(before) and before.max() > 0:
            back[j] = low[j] + int(before.argmax())
            score[j] += score[back[j]]
    at, out = int(score.argmax()), []
    while at >= 0:
        out.append(some[at])
        at = int(back[at])
    return out[::-1]


def _conflicts(chain: list[Cell]) -> set[Cell]:
    """Cells whose value meets another value than it does most often in the chain (then: an equal one, the first one)."""
    met: dict[int, dict[int, int]] = {}
    for *_, item_value, value in chain:
        if item_value:
            own = met.setdefault(item_value, {})
            own[value] = own.get(value, 0) + 1
    chosen = {v: max(own, key=lambda x: (own[x], x == v)) for v, own in met.items()}
    return {x for x in chain if x[4] and chosen[x[4]] != x[5]}


def _judged(hits: list[dict], n_words: int, least_share: int, least_words: int) -> tuple[int, bool]:
    """Words of the item that its best consistent alignment covers (0: too few), and whether one has equal values."""
    near = max(WINDOW, n_words // 2)
    size = lambda chain: sum(x[1] - x[0] for x in chain)
    enough = lambda n: n > 0 and (100 * n >= least_share * n_words or n >= least_words)
    if not enough(len({i for h in hits for i in range(h["item_place"], h["item_place"] + sum(h["item_sizes"]))})):
        return 0, False
    alive = [frozenset(_cells(h)) for h in hits]
    best, exact = 0, False
    while not exact and enough(size(chain := _chain(set().union(*alive), near))):
        used, left = set(chain), alive
        while wrong := _conflicts(chain):
            left = [h for h in left if not h & wrong]
            chain = _chain(set().union(*left), near)
        if enough(size(chain)):
            best, exact = max(best, size(chain)), all(x[4] == x[5] for x in chain)
        used |= set(chain)
        alive = [h for h in alive if not h & used]
    return best, exact


def contaminated(
    docs: DataFrame, benchmark: DataFrame, least_share: int = LEAST_SHARE, least_words: int = LEAST_WORDS
) -> DataFrame:
    """Alignments of benchmark items (item_id, text) in documents (doc_id, text).

    Columns: doc_id, item_id, n_words (of the item), n_matched (its words that are matched), exact (all values are
    equal), row (which input row, as ids may repeat). An item of fewer than ``WINDOW`` words matches as a whole. Only
    alignments whose consistent windows cover ``least_share`` hundredths of the item or ``least_words`` words are returned,
    the best one per document and item. Null texts and texts without words match nothing; rows with null ids are matched and
    carry null; other columns are ignored; an empty table on either side gives no rows. Documents send only windows that a
    fixed-size filter of the benchmark's lets through; the join is Spark's to choose. The hits of one item in one document
    meet in one row, whose size is bounded by these two texts, so a passage in a third of all documents costs a row per
    document and window.
    """
    items = written(_rows(benchmark, "item_id", None, None), "item-windows")
    kinds = [(r.kind, r.width) for r in items.select("kind", "width").distinct().orderBy("kind", "width").collect()]
    found = _rows(docs, "doc_id", kinds or [(0, WINDOW)], key_filter(items, "key"))
    d, b = found.alias("d"), items.alias("b")
    of_item = (F.col(f"b.{n}").alias(f"item_{n}") for n in ("place", "values", "sizes"))
    same = [F.col(f"d.{n}") == F.col(f"b.{n}") for n in ("key", "kind", "width")]
    hits = d.join(b, same[0] & same[1] & same[2]).select(
        "d.doc_id",
        F.col("d.row").alias("row"),
        "b.item_id",
        F.col("b.row").alias("item_row"),
        F.col("b.n_words").alias("n_words"),
        F.struct("d.place", "d.values", "d.sizes", *of_item).alias("hit"),
    )
    aligned = hits.groupBy("doc_id", "row", "item_id", "item_row", "n_words").agg(F.collect_list("hit").alias("hits"))
    names = ("doc_id", "row", "item_id", "n_words", "n_matched")
    schema = pa.schema([*((n, pa.int64()) for n in names), ("exact", pa.bool_())])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = (zip(batch.column("hits"), batch.column("n_words").to_pylist(), strict=True))
            verdicts = [_judged(h.as_py(), n, least_share, least_words) for h, n in found]
            matched = np.array([n for n, _ in verdicts], np.int64)
            columns = [*(batch.column(n) for n in names[:-1]), matched, [e for _, e in verdicts]]
            yield record_batch(schema, columns).filter(pa.array(matched > 0))

    judged = aligned.select(*names[:-1], "hits").mapInArrow(judge, ", ".join(f"{n} long" for n in names) + ", exact boolean")
    return judged.groupBy("doc_id", "row", "item_id").agg(
        F.max_by("n_words", "n_matched").alias("n_words"),
        F.max("n_matched").alias("n_matched"),
        F.max("exact").alias("exact"),
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text holds no benchmark item.

    Rows are told by a hash of 64 bits of their text, never by their place, so it makes no difference how ``docs`` comes about.
    """
    text = F.xxhash64("text")
    bad = contaminated(docs.select(text.alias("doc_id"), "text"), benchmark)
    return rows_without(docs, text, written(bad.select(F.col("doc_id").alias("key")).distinct(), "contaminated"))
