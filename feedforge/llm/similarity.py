"""Exact join of texts whose sets of word n-grams have a Jaccard similarity of at least a threshold (operator 4).

A text's set holds the fingerprints of its n-grams. Equal sets form one class, named by a fingerprint of the set, and
only classes are joined.

1. Token classes. A token is frequent if ``FREQUENT`` texts or more have it. Every pair of text and token is counted, as sorted
   numbers of ``COUNT_BITS`` bits that tasks send to shards by range; tokens equal in these bits count together. A
   fixed-size filter holds the frequent tokens; what it lets through counts as frequent everywhere. The global order has
   rare tokens before frequent ones, each ascending. Which tokens are frequent changes the work, not the links.
2. Single tokens. Similar sets of size n share a token among their first ``n - ceil(t n) + 1`` in that order. Each rare one among
   these is a key.
3. Token combinations. A set with r rare tokens whose prefix reaches its frequent ones extends it there, and each pair of
   neighbouring frequent tokens in it is a key. Proof that nothing is lost: let x and y be similar and share no rare
   token. Then both reach their frequent ones. Up to the smaller of the two prefix ends, say x's at L frequent tokens, let
   a' of them be missing in y and b' of y's in x. The L - a' shared ones have L - a' - 1 gaps, and each of the a' + b'
   others spoils at most one, so L - 1 - 2a' - b' pairs are shared. With a = |x - y| and b = |y - x|, similarity t gives
   a + b <= (n - a)(1 - t)/t and a <= (1 - t) n, hence 2a + b <= 2 (1 - t) n for t >= 1/2; a' <= a - r and b' <= b, so
   ``L = floor(2 (1 - t) n) - 2r + 2`` leaves one shared pair. Small sets use all pairs of frequent tokens in a prefix
   extended by one token, of which two are shared.
4. Links. Each key proposes its members with its smallest and its largest one. Proposals pass a bitmap test that bounds
   the difference of two sets from below, then the exact comparison. Components of these links label the texts. These
   two of each key are then done. Keys whose other members have different labels propose them with ``HUBS`` of these each,
   drawn by hash, and labels are found anew. Then those of one key that still have different labels are proposed too, all
   of them, unless their sizes, their rare tokens where they share none, or their bitmaps already tell them apart. The join
   itself compares these, so that it makes a row only for pairs that may well be linked.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedforge.llm.components import components
from feedforge.llm.exchange import key_filter, packed, parts_for, passes, record_batch, rows_without, text_bytes, unpacked
from feedforge.llm.words import Chunk, chunks, mixed, ranges, rolling, window_counts
from feedforge.session import written

WORDS = 5
#: In hundredths.
SIMILARITY = 80
#: Texts (copies included) that share a token before it counts as frequent.
FREQUENT = 32
#: Bits of a token that are counted, above its lowest 8; the filter of frequent tokens uses fewer.
COUNT_BITS = 40
#: Tokens that a task sorts and sends together, and bytes of text for each shard of the counts.
COUNTED_AT_ONCE = 1 << 20
SHARD_BYTES = 8 << 20
HUBS = 4
#: Sets up to this size use all pairs of their prefix as combinations, and so do sets similar to them.
SMALL_SET = 16
#: Bits of a set's bitmap at least, and of its mask in joins.
MASK_BITS = 1024


def _sets(chunk: Chunk, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-gram fingerprints of each document, and where each document's begin (one entry more)."""
    words, first = chunk.words(lower=True)
    counts = window_counts(first, width)
    has = np.diff(first)
    grams = rolling(words, width)
    tokens = grams[ranges(first[:-1], counts)] if len(grams) else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(chunk)), counts)
    short = np.flatnonzero((has > 0) & (has < width))
    if len(short):
        own = [rolling(words[first[d] : first[d + 1]], int(has[d]))[0] for d in short]
        tokens, owner = np.concatenate([tokens, np.array(own, np.uint64)]), np.concatenate([owner, short])
    order = np.lexsort((tokens, owner))
    tokens, owner = tokens[order], owner[order]
    if len(tokens):
        new = np.ones(len(tokens), bool)
        new[1:] = (tokens[1:] != tokens[:-1]) | (owner[1:] != owner[:-1])
        tokens, owner = tokens[new], owner[new]
    return tokens, np.searchsorted(owner, np.arange(len(chunk) + 1))


def _names(tokens: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A fingerprint of each set; 0 for the empty one."""
    sizes = np.diff(offsets)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(tokens ^ np.uint64(0x5851F42D4C957F2D)))])
    names = mixed((total[offsets[1:]] - total[offsets[:-1]]) ^ mixed(sizes.astype(np.uint64)))
    return np.where(sizes > 0, names | np.uint64(1), np.uint64(0))


def _prefixes(sizes: np.ndarray, similarity: int) -> np.ndarray:
    """Lengths of prefixes of which similar sets share a token; none where only an equal set is similar."""
    return np.where(sizes * 100 >= similarity * (sizes + 1), sizes - -(-sizes * similarity // 100) + 1, 0)


def _keys(tokens: np.ndarray, offsets: np.ndarray, similarity: int, common: np.ndarray) -> tuple:
    """Keys, the document of each, which are single tokens, and rare tokens per document."""
    sizes = np.diff(offsets)
    length = _prefixes(sizes, similarity)
    each = np.arange(len(sizes))
    frequent = passes(common, tokens)
    tokens = tokens[np.lexsort((frequent, np.repeat(each, sizes)))]
    rare = sizes - np.diff(np.concatenate([[0], np.cumsum(frequent)])[offsets])
    single = np.minimum(length, rare)
    made, owners = [tokens[ranges(offsets[:-1], single)]], [np.repeat(each, single)]
    reach = length > rare
    extended = np.minimum(sizes * 2 * (100 - similarity) // 100 - 2 * rare + 2, sizes - rare)
    pairs = np.where(reach & (sizes > SMALL_SET), extended - 1, 0)
    at = ranges(offsets[:-1] + rare, pairs)
    if len(at):
        made.append(mixed(tokens[at] * np.uint64(3) ^ mixed(tokens[at + 1])))
        owners.append(np.repeat(each, pairs))
    for d in np.flatnonzero(reach & (sizes <= SMALL_SET * 100 // similarity)):
        own = tokens[offsets[d] + rare[d] : offsets[d] + min(length[d] + 1, sizes[d])]
        i, j = np.triu_indices(len(own), 1)
        made.append(mixed(own[i] * np.uint64(5) ^ mixed(own[j] + np.uint64(1))))
        owners.append(np.full(len(i), d))
    keys = np.concatenate(made)
    return keys, np.concatenate(owners), np.arange(len(keys)) < len(made[0]), rare


def _bitmap(tokens: np.ndarray) -> bytes:
    """Parities of counts per bit, in ``MASK_BITS`` or the least power of two that has a bit per token: differing bits <= differing tokens."""
    bits = max(MASK_BITS, 1 << int(len(tokens) - 1).bit_length())
    at = (tokens & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def _may_link(a: bytes, b: bytes, n_a: int, n_b: int, similarity: int) -> bool:
    if 100 * min(n_a, n_b) < similarity * max(n_a, n_b):
        return False
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    differ = int(np.bitwise_count(x ^ y).sum())
    return (100 + similarity) * differ <= (100 - similarity) * (n_a + n_b)


class _Join:
    def __init__(self, docs: DataFrame, width: int, similarity: int, frequent: int):
        self.docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        self.width, self.similarity, self.frequent = width, similarity, frequent

    def sizes(self) -> DataFrame:
        """Per document: doc_id, node (its class; null for an empty set), n_shingles and the class's bitmap."""
        width = self.width
        schema = pa.schema([("doc_id", pa.int64()), ("node", pa.int64()), ("n_shingles", pa.int64()), ("bitmap", pa.binary())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for chunk in chunks(batches):
                tokens, offsets = _sets(chunk, width)
                names = _names(tokens, offsets)
                maps = [_bitmap(tokens[a:b]) if b > a else None for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                nodes = pa.array(names.view(np.int64), mask=names == 0)
                yield record_batch(schema, [chunk.column("doc_id"), nodes, np.diff(offsets), maps])

        return self.docs.mapInArrow(run, "doc_id long, node long, n_shingles long, bitmap binary")

    def counts(self, least: int) -> DataFrame:
        """Tokens that ``least`` texts or more have, by their counted bits: rows (key)."""
        width, shards = self.width, parts_for(text_bytes(self.docs), SHARD_BYTES)
        bounds = np.array([(s << COUNT_BITS) // shards for s in range(shards + 1)], np.uint64)
        schema = pa.schema([("shard", pa.int64()), ("tokens", pa.binary()), ("counts", pa.binary())])
        found = pa.schema([("key", pa.int64())])

        def sorted_rows(held: list[np.ndarray]) -> pa.RecordBatch:
            some, n = np.unique(np.concatenate(held), return_counts=True)
            ends = np.searchsorted(some, bounds)
            full = np.flatnonzero(np.diff(ends))
            spans = [slice(ends[s], ends[s + 1]) for s in full]
            columns = [full, [packed(some[x], rising=True) for x in spans], [packed(n[x].astype(np.int32)) for x in spans]]
            return record_batch(schema, columns)

        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, n = [], 0
            for chunk in chunks(batches):
                tokens, _ = _sets(chunk, width)
                held.append((tokens >> np.uint64(8)) & np.uint64((1 << COUNT_BITS) - 1))
                n += len(tokens)
                if n >= COUNTED_AT_ONCE:
                    yield sorted_rows(held)
                    held, n = [], 0
            if n:
                yield sorted_rows(held)

        def total(table: pa.Table) -> pa.Table:
            tokens = np.concatenate([unpacked(x, "uint64", rising=True) for x in table.column("tokens").to_pylist()])
            counts = np.concatenate([unpacked(x, "int32") for x in table.column("counts").to_pylist()])
            order = np.argsort(tokens)
            tokens, counts = tokens[order], counts[order].astype(np.int64)
            heads = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
            frequent = tokens[heads][np.add.reduceat(counts, heads) >= least]
            return pa.Table.from_batches([record_batch(found, [(frequent << np.uint64(8)).view(np.int64)])])

        sent = self.docs.mapInArrow(send, "shard long, tokens binary, counts binary")
        return sent.groupBy("shard").applyInArrow(total, "key long")

    def keys(self, common: np.ndarray, wanted: np.ndarray | None = None) -> DataFrame:
        """Rows (key, node) of :func:`_keys`; given ``wanted``, only keys that it lets through, with single, rare and size."""
        width, similarity = self.width, self.similarity
        narrow = [("key", pa.int64()), ("node", pa.int64())]
        wide = [*narrow, ("single", pa.bool_()), ("rare", pa.int64()), ("size", pa.int64())]
        schema = pa.schema(narrow if wanted is None else wide)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for chunk in chunks(batches):
                tokens, offsets = _sets(chunk, width)
                names = _names(tokens, offsets)
                keys, owner, single, rare = _keys(tokens, offsets, similarity, common)
                if wanted is None:
                    yield record_batch(schema, [keys.view(np.int64), names[owner].view(np.int64)])
                    continue
                through = passes(wanted, keys)
                keys, owner = keys[through], owner[through]
                about = [single[through], rare[owner], np.diff(offsets)[owner]]
                yield record_batch(schema, [keys.view(np.int64), names[owner].view(np.int64), *about])

        more = "" if wanted is None else ", single boolean, rare long, size long"
        return self.docs.mapInArrow(run, "key long, node long" + more)

    def sets(self, members: np.ndarray) -> DataFrame:
        """Rows (node, tokens) of the classes' first documents that the filter lets through."""
        width = self.width
        schema = pa.schema([("node", pa.int64()), ("tokens", pa.binary())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for chunk in chunks(batches):
                tokens, offsets = _sets(chunk, width)
                names = _names(tokens, offsets)
                ids = chunk.column("doc_id").fill_null(-(1 << 63)).to_numpy(zero_copy_only=False).astype(np.int64)
                which = np.flatnonzero(passes(members, mixed(names ^ mixed(ids.view(np.uint64)))) & (names != 0))
                yield record_batch(
                    schema, [names[which].view(np.int64), [packed(tokens[offsets[d] : offsets[d + 1]]) for d in which]]
                )

        return self.docs.mapInArrow(run, "node long, tokens binary")

    def verified(self, proposals: DataFrame, classes: DataFrame) -> DataFrame:
        """The links (a, b) among proposals (a, b)."""
        similarity = self.similarity
        of = lambda side: classes.select(
            F.col("node").alias(side), F.col("n_shingles").alias(f"n_{side}"), F.col("bitmap").alias(f"bitmap_{side}")
        )

        def screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                a, b, n_a, n_b, x, y = (c.to_pylist() for c in batch.columns)
                good = [_may_link(*row, similarity) for row in zip(x, y, n_a, n_b, strict=True)]
                yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

        likely = (
            proposals.join(of("a"), "a").join(of("b"), "b").select("a", "b", "n_a", "n_b", "bitmap_a", "bitmap_b")
        ).mapInArrow(screen, "a long, b long")
        likely = written(likely, "likely-pairs")
        ends = likely.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        firsts = ends.join(classes.select("node", "first_doc"), "node")
        members = key_filter(_member_keys(firsts), "key")
        sets = written(self.sets(members).join(ends, "node", "left_semi").dropDuplicates(["node"]), "sets")

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                good = []
                for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                    x, y = unpacked(x, "uint64"), unpacked(y, "uint64")
                    both = len(x) + len(y) - len(np.union1d(x, y))
                    good.append(100 * both >= similarity * (len(x) + len(y) - both))
                yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

        with_sets = likely.join(sets.select(F.col("node").alias("a"), F.col("tokens").alias("tokens_a")), "a").join(
            sets.select(F.col("node").alias("b"), F.col("tokens").alias("tokens_b")), "b"
        )
        links = with_sets.select("a", "b", "tokens_a", "tokens_b").mapInArrow(compare, "a long, b long")
        return written(links, "links")


def _member_keys(firsts: DataFrame) -> DataFrame:
    """The same mix of class and first document as in :meth:`_Join.sets`, from (node, first_doc)."""
    schema = pa.schema([("key", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, first = (c.fill_null(-(1 << 63)).to_numpy().view(np.uint64) for c in batch.columns)
            yield record_batch(schema, [mixed(node ^ mixed(first)).view(np.int64)])

    return firsts.select("node", "first_doc").mapInArrow(run, "key long")


def similar_texts(
    docs: DataFrame, width: int = WORDS, similarity: int = SIMILARITY, frequent: int = FREQUENT
) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_shingles and component_id, the smallest doc_id it is linked to.

    ``similarity`` is in hundredths, 60 to 100. Texts are lower-cased (A-Z). A text of fewer than ``width`` words has one
    n-gram, all its words; without words, or null, it has none and stays alone. Rows with equal texts are linked whatever
    their ids; a row with a null id is linked like others but names no component unless all of its rows lack an id. Other
    columns are ignored; an empty table gives no rows. Scans send rows through fixed-size filters, so texts are never
    shuffled; each set of up to all copies of a text counts as one node, so hot groups stay narrow.
    """
    join = _Join(docs, width, similarity, frequent)
    rows = written(join.sizes(), "sets")
    named = rows.filter("node is not null")
    classes = written(
        named.groupBy("node").agg(
            F.min("doc_id").alias("first_doc"),
            F.first("n_shingles").alias("n_shingles"),
            F.first("bitmap").alias("bitmap"),
        ),
        "classes",
    )
    common = key_filter(join.counts(frequent), "key")
    shared = F.min("node").alias("low"), F.max("node").alias("high")
    live = written(join.keys(common).groupBy("key").agg(*shared).filter("low <> high"), "keys")
    holders = join.keys(common, key_filter(live, "key")).distinct()
    members = written(holders.join(live, "key"), "members")

    stars = members.select(F.col("node").alias("a"), F.explode(F.array("low", "high")).alias("b"))
    proposed = written(_ordered(stars), "proposed")
    links = join.verified(proposed, classes)
    labels = written(components(links), "labels")

    between = members.filter("node <> low and node <> high").select("key", "single", "node", "size", "rare")
    rest = written(_unsettled(between, labels), "rest")
    drawn = [F.min_by(F.struct(*_SIDE), F.xxhash64("node", F.lit(i))) for i in range(HUBS)]
    hubs = rest.groupBy("key").agg(F.array_distinct(F.array(*drawn)).alias("hubs"))
    hubs = hubs.select("key", F.explode("hubs").alias("y")).select("key", *(F.col(f"y.{n}") for n in _SIDE))
    x, y = rest.alias("x"), hubs.alias("y")
    drawn_pairs = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.label") != F.col("y.label")) & _near(similarity))
    more = join.verified(written(_ordered(_ends(drawn_pairs)), "proposed"), classes)
    links = links.union(more)
    labels = written(components(links), "labels")

    rest = _unsettled(rest.drop("label"), labels).join(_masks(classes), "node")
    rest = written(rest, "rest")
    x, y = rest.alias("x"), rest.alias("y")
    apart = (F.col("x.key") == F.col("y.key")) & (F.col("x.label") < F.col("y.label"))
    across = x.join(y, apart & _near(similarity) & _alike(similarity))
    more = join.verified(written(_ordered(_ends(across)), "proposed"), classes)
    if not more.isEmpty():
        labels = written(components(links.union(more)), "labels")

    of_class = classes.join(labels, "node", "left").select(
        "node", "first_doc", F.coalesce("label", "node").alias("label")
    )
    least = of_class.groupBy("label").agg(F.min("first_doc").alias("component_id"))
    component = of_class.join(least, "label").select("node", "component_id")
    return rows.join(component, "node", "left").select(
        "doc_id",
        "n_shingles",
        F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
    )


_SIDE = ("node", "label", "size", "rare")


def _unsettled(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members of keys that have more than one label, with their labels."""
    labelled = members.join(labels, "node", "left").select(
        "key", "single", *(n for n in _SIDE if n != "label"), F.coalesce("label", "node").alias("label")
    )
    several = labelled.groupBy("key").agg(F.min("label").alias("first"), F.max("label").alias("last"))
    return labelled.join(several.filter("first <> last").select("key"), "key")


def _near(similarity: int):
    """Whether sizes of x and y allow for a link; combinations stand for pairs without a common rare token."""
    least, most = F.least("x.size", "y.size"), F.greatest("x.size", "y.size")
    f, g = F.col("x.size") - F.col("x.rare"), F.col("y.size") - F.col("y.rare")
    apart = F.col("x.rare") + F.col("y.rare") + F.greatest(f, g)
    return (similarity * most <= 100 * least) & (F.col("x.single") | (similarity * apart <= 100 * F.least(f, g)))


def _masks(classes: DataFrame) -> DataFrame:
    """Per node its bitmap, folded to ``MASK_BITS`` bits: columns of 64 bits each, which joins compare by themselves."""
    names = [f"mask_{i}" for i in range(MASK_BITS // 64)]
    schema = pa.schema([(n, pa.int64()) for n in ("node", *names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            maps = [np.frombuffer(x, np.int64).reshape(-1, len(names)) for x in batch.column("bitmap").to_pylist()]
            folded = np.array([np.bitwise_xor.reduce(x, axis=0) for x in maps], np.int64).reshape(-1, len(names))
            yield record_batch(schema, [batch.column("node"), *folded.T])

    return classes.select("node", "bitmap").mapInArrow(run, ", ".join(f"{n} long" for n in ("node", *names)))


def _alike(similarity: int):
    """Whether the masks of x and y allow for a link: bits that differ are at most as many as tokens that do."""
    bits = [F.bit_count(F.col(f"x.mask_{i}").bitwiseXOR(F.col(f"y.mask_{i}"))) for i in range(MASK_BITS // 64)]
    return (100 + similarity) * reduce(add, bits) <= (100 - similarity) * (F.col("x.size") + F.col("y.size"))


def _ends(joined: DataFrame) -> DataFrame:
    return joined.select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))


def _ordered(pairs: DataFrame) -> DataFrame:
    """Pairs of different nodes as (smaller, larger), once each."""
    return pairs.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def one_of_each_group(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that remain when one row of each group of linked texts stays.

    That is the row of the smallest doc_id; of several, or if no row has an id, the one of the smallest text hash; of rows
    with equal ids and texts any one. Texts without words all stay. Rows are told by hashes of 64 bits of text and id, never by
    their place, so it makes no difference how ``docs`` comes about. Any columns may be there, under any names.
    """
    row, text = F.xxhash64(F.col("doc_id"), F.col("text")), F.xxhash64("text")
    own = docs.select(F.col("doc_id").cast("long").alias("id"), text.alias("text_key"), row.alias("key"))
    found = similar_texts(docs.select(text.alias("doc_id"), "text")).filter("n_shingles > 0")
    found = found.select(F.col("doc_id").alias("text_key"), "component_id").distinct()
    rows = own.groupBy("key", "text_key", "id").agg(F.count(F.lit(1)).alias("n"))
    rows = written(rows.join(found, "text_key"), "groups")
    order = F.struct(F.col("id").isNull(), "id", "text_key", "key")
    first = written(rows.groupBy("component_id").agg(F.min(order)["key"].alias("key")).select("key"), "first-rows")
    gone = written(rows.join(first, "key", "left_anti").select("key"), "gone")
    once = written(rows.filter("n > 1").join(first, "key", "left_semi").select("key"), "once")
    return rows_without(docs, row, gone, once)
