"""Near-duplicate texts by HyperMinHash sketches (operator 13).

A text's set holds the fingerprints of its word n-grams; equal sets form one class, named by a fingerprint of the set.

1. Sketch. Each class has ``BUCKETS`` buckets. A pass deals all tokens to buckets by a hash and an empty bucket takes the
   smallest hash that falls into it; ``PASSES`` passes fill nearly all, and for the rest every token competes in every
   empty bucket. So each bucket draws one token by the order (pass, hash), the same order for every set, and two sets draw the
   same one with probability equal to their Jaccard similarity, however small they are. A bucket keeps the number of leading
   zeros of the hash and the ``MANTISSA`` bits behind its first one: 16 bits.
2. Bands. ``BAND`` neighbouring registers make a key. At similarity 0.8 a pair shares none of the 42 keys with probability
   3e-6.
3. Estimate. The share of equal registers, less the share that unequal tokens of sets of these sizes have by chance, estimates
   the similarity; pairs ``MARGIN`` standard errors below the threshold are let go (4e-6 of the pairs at the threshold).
4. Links. Each key proposes its members with its smallest one; what passes the estimate is compared on full sets, and
   components label the classes. Keys whose members still have several labels compare every pair of different labels: small
   keys propose them by a join; large ones are cut into blocks of bounded size, where registers are compared in numpy, each pair
   in the first band it shares, full sets of those that pass the estimate follow in the same task, and one link per pair of labels
   leaves it. So what travels grows with the members of a key, not with their pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedforge.llm.components import components
from feedforge.llm.exchange import key_filter, packed, passes, record_batch, unpacked
from feedforge.llm.words import Chunk, chunks, mixed, ranges, rolling
from feedforge.session import written

WORDS = 2
#: In hundredths.
SIMILARITY = 80
BUCKETS = 256
PASSES = 16
MANTISSA = 10
BAND = 6
#: Standard errors of the estimate.
MARGIN = 4.5
#: Members of a key that are paired by a join; larger keys are compared in blocks of this many rows a side.
SMALL_KEY = 16
BLOCK = 1024
#: Cells of one numpy comparison.
CELLS = 1 << 18

_STEP = np.uint64(0x9E3779B97F4A7C15)
#: A different summand for every pass.
_OF_PASS = np.arange(1, PASSES + 1, dtype=np.uint64) * _STEP


def token_sets(chunk: Chunk, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-gram fingerprints of each text, one text after another, and where each one's begin (one entry more).

    A text of fewer than ``width`` words has one n-gram, all its words; one without words has none.
    """
    words, first = chunk.words(lower=True)
    n_words = np.diff(first)
    size = np.where(n_words >= width, width, n_words)
    found, owner = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for own in range(1, width + 1):
        which = np.flatnonzero(size == own)
        counts = np.maximum(n_words[which] - own + 1, 0) if own == width else np.ones(len(which), np.int64)
        grams = rolling(words, own)
        if len(which) and len(grams):
            found.append(grams[ranges(first[which], counts)])
            owner.append(np.repeat(which, counts))
    tokens, owner = np.concatenate(found), np.concatenate(owner)
    order = np.lexsort((tokens, owner))
    tokens, owner = tokens[order], owner[order]
    new = np.ones(len(tokens), bool)
    new[1:] = (tokens[1:] != tokens[:-1]) | (owner[1:] != owner[:-1])
    tokens, owner = tokens[new], owner[new]
    return tokens, np.searchsorted(owner, np.arange(len(chunk) + 1))


def set_names(tokens: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A fingerprint of each set, never 0; 0 for the empty set."""
    sizes = np.diff(offsets)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(tokens + _STEP))])
    names = mixed((sums[offsets[1:]] - sums[offsets[:-1]]) + mixed(sizes.astype(np.uint64) * _STEP))
    return np.where(sizes > 0, names | np.uint64(1), np.uint64(0))


def registers(tokens: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Compressed registers of each set, one row of ``BUCKETS`` uint16 each; rows of empty sets are 0."""
    n = len(offsets) - 1
    empty = np.uint64(1 << 63)
    least = np.full(n * BUCKETS, empty, np.uint64)
    owner = np.repeat(np.arange(n), np.diff(offsets))
    active_tokens, active_owner = tokens, owner
    for step in range(PASSES):
        if not len(active_tokens):
            break
        hashes = mixed(active_tokens + _OF_PASS[step])
        slot = active_owner * BUCKETS + (hashes % np.uint64(BUCKETS)).astype(np.int64)
        open_before = least[slot] == empty
        np.minimum.at(least, slot[open_before], hashes[open_before] // np.uint64(BUCKETS))
        unfilled = (least.reshape(n, BUCKETS) == empty).any(axis=1)
        stays = unfilled[active_owner]
        active_tokens, active_owner = active_tokens[stays], active_owner[stays]
    sizes = np.diff(offsets)
    open_slots = np.flatnonzero((least == empty) & np.repeat(sizes > 0, BUCKETS))
    at = 0
    while at < len(open_slots):
        counts = np.cumsum(sizes[open_slots[at:] // BUCKETS])
        to = at + max(1, int(np.searchsorted(counts, CELLS)))
        some = open_slots[at:to]
        own = sizes[some // BUCKETS]
        salt = np.repeat((some % BUCKETS).astype(np.uint64) + np.uint64(PASSES + 1), own) * _STEP
        hashes = mixed(tokens[ranges(offsets[some // BUCKETS], own)] + salt) // np.uint64(BUCKETS)
        least[some] = np.minimum.reduceat(hashes, np.concatenate([[0], np.cumsum(own)[:-1]]))
        at = to
    least[least == empty] = 0
    # the exponent of a double counts leading zeros, its first mantissa bits follow the leading one
    bits = least.astype(np.float64).view(np.int64) >> (52 - MANTISSA)
    zeros = np.where(least > 0, 55 + 1023 - (bits >> MANTISSA), 56)
    made = (zeros << MANTISSA) | (bits & ((1 << MANTISSA) - 1))
    return np.where(np.repeat(sizes > 0, BUCKETS), made, 0).astype(np.uint16).reshape(n, BUCKETS)


def chance(n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Probability that the registers of two different tokens are equal, for sets of these sizes."""
    a, b = np.maximum(n_a / BUCKETS, 1.0), np.maximum(n_b / BUCKETS, 1.0)
    total = np.zeros(np.broadcast(a, b).shape)
    for zeros in range(56):
        low, high = 2.0 ** -(zeros + 1), 2.0**-zeros
        total += low * 2.0**-MANTISSA * (np.exp(-(a + b) * low) - np.exp(-(a + b) * high))
    return total * a * b / (a + b)


def estimate(equal: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Similarity from the number of equal registers, corrected for equality by chance."""
    by_chance = chance(n_a, n_b)
    return (equal / BUCKETS - by_chance) / (1 - by_chance)


def _floor(similarity: int) -> float:
    t = similarity / 100
    return t - MARGIN * float(np.sqrt(max(t * (1 - t), 0.04) / BUCKETS))


def band_keys(rows: np.ndarray) -> np.ndarray:
    """Keys of each row of registers."""
    n = BUCKETS // BAND
    parts = rows[:, : n * BAND].reshape(len(rows), n, BAND).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, n + 1, dtype=np.uint64) * _STEP, parts.shape[:2])
    for i in range(BAND):
        key = mixed(key ^ (parts[:, :, i] + np.uint64(i << 16)))
    return key


def _matrix(column: pa.Array) -> np.ndarray:
    """Registers of a binary column, one row each."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data.view(np.uint16).reshape(len(column), BUCKETS)


class _Sketches:
    def __init__(self, docs: DataFrame, width: int, similarity: int):
        self.docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        self.width, self.similarity = width, similarity

    def rows(self) -> DataFrame:
        """Per document: doc_id, node (its class; null for an empty set), n_shingles and registers."""
        width = self.width
        schema = pa.schema([("doc_id", pa.int64()), ("node", pa.int64()), ("n_shingles", pa.int64()), ("registers", pa.binary())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for chunk in chunks(batches):
                tokens, offsets = token_sets(chunk, width)
                names = set_names(tokens, offsets)
                made = registers(tokens, offsets)
                nodes = pa.array(names.view(np.int64), mask=names == 0)
                kept = [row.tobytes() if name else None for row, name in zip(made, names, strict=True)]
                yield record_batch(schema, [chunk.column("doc_id"), nodes, np.diff(offsets), kept])

        return self.docs.mapInArrow(run, "doc_id long, node long, n_shingles long, registers binary")

    def sets(self, nodes: np.ndarray) -> DataFrame:
        """Rows (node, tokens) of documents whose class the filter lets through."""
        width = self.width
        schema = pa.schema([("node", pa.int64()), ("tokens", pa.binary())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for chunk in chunks(batches):
                tokens, offsets = token_sets(chunk, width)
                names = set_names(tokens, offsets)
                last = {name: i for i, name in enumerate(names)}
                which = [i for i in last.values() if names[i] and passes(nodes, names[i : i + 1])[0]]
                found = [packed(tokens[offsets[i] : offsets[i + 1]], rising=True) for i in which]
                yield record_batch(schema, [names[which].view(np.int64), found])

        return self.docs.mapInArrow(run, "node long, tokens binary")

    def full_sets(self, ends: DataFrame) -> DataFrame:
        """Rows (node, tokens) of the nodes of ``ends``, written."""
        ends = written(ends.select("node").distinct(), "ends")
        wanted = key_filter(ends.select(F.col("node").alias("key")), "key")
        return written(self.sets(wanted).join(ends, "node", "left_semi").dropDuplicates(["node"]), "full-sets")

    def links(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """The pairs (a, b) whose full sets are similar, written."""
        similarity = self.similarity
        side = lambda name: sets.select(F.col("node").alias(name), F.col("tokens").alias(f"tokens_{name}"))

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                good = []
                for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                    x, y = unpacked(x, "uint64", rising=True), unpacked(y, "uint64", rising=True)
                    union = len(np.union1d(x, y))
                    good.append(100 * (len(x) + len(y) - union) >= similarity * union)
                yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

        joined = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b")
        return written(joined.select("a", "b", "tokens_a", "tokens_b").mapInArrow(compare, "a long, b long"), "links")

    def screened(self, pairs: DataFrame, classes: DataFrame) -> DataFrame:
        """Pairs (a, b) that pass sizes and estimate, written."""
        similarity, floor = self.similarity, _floor(self.similarity)
        side = lambda name: classes.select(
            F.col("node").alias(name), F.col("n_shingles").alias(f"n_{name}"), F.col("registers").alias(f"registers_{name}")
        )

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                n_a, n_b = batch.column(2).to_numpy(), batch.column(3).to_numpy()
                equal = (_matrix(batch.column(4)) == _matrix(batch.column(5))).sum(axis=1)
                good = (100 * np.minimum(n_a, n_b) >= similarity * np.maximum(n_a, n_b)) & (estimate(equal, n_a, n_b) >= floor)
                yield batch.select(["a", "b"]).filter(pa.array(good))

        joined = pairs.join(side("a"), "a").join(side("b"), "b")
        joined = joined.select("a", "b", "n_a", "n_b", "registers_a", "registers_b")
        return written(joined.mapInArrow(run, "a long, b long"), "likely")

    def block_links(self, members: DataFrame, classes: DataFrame, sets: DataFrame) -> DataFrame:
        """Links (a, b) between labels of large keys, one per pair of labels and block, written.

        ``members``: key, band, node, label, n (rows of the key).
        """
        similarity, floor = self.similarity, _floor(self.similarity)
        parts = F.ceil(F.col("n") / BLOCK)
        own = members.withColumn("parts", parts).withColumn("own", F.pmod(F.xxhash64("node"), "parts"))
        dealt = own.withColumn("other", F.explode(F.expr("sequence(0L, parts - 1)"))).select(
            "key", "band", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "label"
        )
        about = classes.select("node", "n_shingles", "registers").join(sets, "node")
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

        def run(key: tuple, group: pa.Table) -> pa.Table:
            i, j, band = key[1].as_py(), key[2].as_py(), group.column("band")[0].as_py()
            own, node, label, size = (group.column(c).to_numpy() for c in ("own", "node", "label", "n_shingles"))
            kept = _matrix(group.column("registers"))
            texts = _Members(group.column("tokens"))
            left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
            linked, a, b = set(), [], []
            for x in left:
                y = right[(label[right] != label[x]) & ((node[right] > node[x]) | (i != j))]
                y = y[100 * np.minimum(size[x], size[y]) >= similarity * np.maximum(size[x], size[y])]
                for at in range(0, len(y), CELLS // BUCKETS):
                    z = y[at : at + CELLS // BUCKETS]
                    same = kept[z] == kept[x]
                    z = z[(estimate(same.sum(axis=1), size[x], size[z]) >= floor) & (_first_band(same) == band)]
                    both = texts.shared(x, z)
                    for v in z[100 * both >= similarity * (size[x] + size[z] - both)]:
                        if (label[x], label[v]) not in linked:
                            linked |= {(label[x], label[v]), (label[v], label[x])}
                            a.append(node[x])
                            b.append(node[v])
            return pa.Table.from_batches([record_batch(schema, [np.array(a, np.int64), np.array(b, np.int64)])])

        return written(dealt.join(about, "node").groupBy("key", "i", "j").applyInArrow(run, "a long, b long"), "links")


def _first_band(same: np.ndarray) -> np.ndarray:
    """The first band whose registers are all equal, for rows of which some band is."""
    n = BUCKETS // BAND
    return same[:, : n * BAND].reshape(len(same), n, BAND).all(axis=2).argmax(axis=1)


class _Members:
    """Full sets of a block, their tokens numbered; numbers of one text are marked to count what others share with it."""

    def __init__(self, tokens: pa.ChunkedArray):
        found = [unpacked(t, "uint64", rising=True) for t in tokens.to_pylist()]
        self.sizes = np.array([len(t) for t in found])
        self.starts = np.cumsum(self.sizes) - self.sizes
        distinct, self.numbers = np.unique(np.concatenate(found), return_inverse=True)
        self.marks = np.zeros(len(distinct), bool)

    def shared(self, one: int, others: np.ndarray) -> np.ndarray:
        """Tokens that each of ``others`` shares with ``one``."""
        if not len(others):
            return np.zeros(0, np.int64)
        own = self.numbers[self.starts[one] : self.starts[one] + self.sizes[one]]
        self.marks[own] = True
        sizes = self.sizes[others]
        hit = self.marks[self.numbers[ranges(self.starts[others], sizes)]].astype(np.int64)
        self.marks[own] = False
        return np.add.reduceat(hit, np.cumsum(sizes) - sizes)


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("node"))


def near_duplicates(docs: DataFrame, width: int = WORDS, similarity: int = SIMILARITY) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id and kept.

    ``component_id`` is the smallest doc_id that links reach, ``kept`` whether it is the row's own. ``similarity`` is in
    hundredths. Texts are lower-cased (A-Z); a text of fewer than ``width`` words has one n-gram, all its words; without words,
    or null, it has none, stays alone and is kept. Every link is confirmed on full sets; a pair at the threshold is overlooked
    with probability below 1e-5, a closer one with less. Rows with equal texts are linked whatever their ids, and rows that repeat
    an id each have a row; a row with a null id is linked like others but names no component unless all of its rows lack an
    id, and only then is kept. Other columns are ignored; an empty table gives no rows. All copies of a text count as one
    class; texts are not shuffled.
    """
    work = _Sketches(docs, width, similarity)
    rows = written(work.rows(), "sketches")
    classes = written(
        rows.filter("node is not null")
        .groupBy("node")
        .agg(F.min("doc_id").alias("first_doc"), F.first("n_shingles").alias("n_shingles"), F.first("registers").alias("registers")),
        "classes",
    )

    schema = pa.schema([("key", pa.int64()), ("band", pa.int32()), ("node", pa.int64())])

    def bands(wanted: np.ndarray | None) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    keys = band_keys(_matrix(batch.column(1)))
                    nodes = np.repeat(batch.column(0).to_numpy(), keys.shape[1])
                    number = np.tile(np.arange(keys.shape[1]), len(keys))
                    keys = keys.ravel()
                    through = slice(None) if wanted is None else passes(wanted, keys)
                    yield record_batch(schema, [keys[through].view(np.int64), number[through], nodes[through]])

        return classes.select("node", "registers").mapInArrow(run, "key long, band int, node long")

    ends = F.min("node").alias("low"), F.max("node").alias("high")
    live = written(bands(None).groupBy("key").agg(*ends).filter("low <> high").select("key", "low"), "live-keys")
    members = written(bands(key_filter(live, "key")).join(live, "key"), "members")

    stars = members.filter("node <> low").select(F.col("low").alias("a"), F.col("node").alias("b")).distinct()
    stars = written(stars, "stars")
    near = work.screened(stars, classes)
    links = work.links(near, work.full_sets(_ends(near)))
    labels = written(components(links), "labels")

    own = members.join(labels, "node", "left").select("key", "band", "node", F.coalesce("label", "node").alias("label"))
    several = own.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("one"), F.max("label").alias("another"))
    rest = written(own.join(several.filter("one <> another").select("key", "n"), "key"), "unsettled")
    small, large = rest.filter(F.col("n") <= SMALL_KEY), rest.filter(F.col("n") > SMALL_KEY)
    x, y = small.alias("x"), small.alias("y")
    apart = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.label") < F.col("y.label")))
    pairs = apart.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()
    near = work.screened(written(pairs.join(stars, ["a", "b"], "left_anti"), "pairs"), classes)
    sets = work.full_sets(_ends(near).union(large.select("node")))
    links = links.union(work.links(near, sets)).union(work.block_links(large, classes, sets))
    labels = written(components(links), "labels")

    of_class = classes.join(labels, "node", "left").select("node", "first_doc", F.coalesce("label", "node").alias("label"))
    least = of_class.groupBy("label").agg(F.min("first_doc").alias("component_id"))
    component = of_class.join(least, "label").select("node", "component_id")
    named = rows.select("doc_id", "node", "n_shingles").join(component, "node", "left")
    its = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return named.select("doc_id", "n_shingles", its.alias("component_id")).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id"))
    )
