"""Vector pooling and exact top-K retrieval."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedforge.session import written

TOP_K = 100
# Scores are compared after rounding, so that the order does not depend on
# the order in which products were added.
SCORE_DECIMALS = 9
# A rounded score may exceed the bound of the exact one by half a unit.
SLACK = 10.0**-SCORE_DECIMALS
ITEM_BLOCK = 4096
# Bytes of item blocks that are broadcast at once.
ROUND_BYTES = 128 << 20
CELLS_AT_ONCE = 4_000_000
# Histories a task pools at once; it holds a sum per dimension for each.
POOLED_ROWS = 65_536
# Tables of vectors, of a round's bytes each, that one join of histories broadcasts.
BROADCASTS = 4


def pooled_vectors(
    histories: DataFrame,
    items: DataFrame,
    key: str,
    history: str = "hist_items",
    decay: float | None = None,
    dim: int | None = None,
    round_bytes: int = ROUND_BYTES,
) -> DataFrame:
    """Mean of the item vectors of a history, or their decayed mean.

    ``items`` has (item_id, vector). Padding and items without a vector do not
    count. With ``decay`` position ``i`` weighs ``decay ** i``. Histories are
    dealt by key, ``POOLED_ROWS`` a task, before their vectors join them. The
    vectors that histories name are written and broadcast, ``round_bytes`` at
    a time and ``BROADCASTS`` times at most, whatever the size of ``items``, so
    ids travel and no sums; beyond that the join is left to Spark. The result has
    (key, vector); rows without any vector are absent. ``dim`` is read from
    the first vector when it is not given.
    """
    if dim is None:
        first = items.select(F.size("vector")).first()
        dim = first[0] if first else 0
    width = int(histories.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    places = histories.select(F.posexplode_outer(history).alias("_at", "item_id"))
    opens = F.count_if(F.coalesce("_at", F.lit(0)) == 0).alias("_histories")
    named = written(places.groupBy("item_id").agg(opens), "history-items")
    rows = named.agg(F.sum("_histories")).first()[0] or 0
    dealt = histories.select(key, history).repartition(max(width, -(-rows // POOLED_ROWS)), key)
    steps = dealt.select(key, F.posexplode(history).alias("_at", "item_id")).where(F.col("item_id") > 0)
    weight = F.lit(1.0) if decay is None else F.pow(F.lit(decay), F.col("_at").cast("double"))
    found = _with_vectors(steps, _named_vectors(items, named), dim, round_bytes).withColumn("_w", weight)
    sums = [F.sum(F.col("_w") * F.get("vector", F.lit(i)).cast("double")).alias(f"_s{i}") for i in range(dim)]
    summed = found.groupBy(key).agg(F.sum("_w").alias("_total"), *sums)
    divisor = F.greatest(F.col("_total"), F.lit(1.0)) if decay is None else F.col("_total")
    return summed.select(key, F.array(*[F.col(f"_s{i}") / divisor for i in range(dim)]).alias("vector"))


def _named_vectors(items: DataFrame, named: DataFrame) -> DataFrame:
    """The rows of ``items`` that histories name, written."""
    return written(items.select("item_id", "vector").join(named, "item_id", "left_semi"), "history-vectors")


def _with_vectors(steps: DataFrame, items: DataFrame, dim: int, round_bytes: int) -> DataFrame:
    """Steps joined to (item_id, vector), where the items' size allows it without moving the steps."""
    parts = max(1, -(-items.count() * (8 * dim + 32) // round_bytes))
    if parts > BROADCASTS:
        return steps.join(items, "item_id")
    if parts == 1:
        return steps.join(F.broadcast(items), "item_id")
    for part in range(parts):
        own = items.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == part)
        own = own.select("item_id", F.struct("vector").alias(f"_item_{part}"))
        steps = steps.join(F.broadcast(own), "item_id", "left")
    names = [f"_item_{part}" for part in range(parts)]
    return steps.withColumn("_item", F.coalesce(*names)).where("_item IS NOT NULL").drop(*names).withColumn("vector", F.col("_item.vector"))


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    rows = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(rows), -1)


def _norm(vector: str) -> Column:
    squares = F.aggregate(vector, F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double"))
    return F.sqrt(squares)


def item_blocks(items: DataFrame, rows: int = ITEM_BLOCK) -> DataFrame:
    """Items (item_id, vector) in blocks of at most ``rows`` of similar norm, written once.

    Columns: max_norm, n, ids and matrix (longs and doubles as bytes). Ranges of (norm, item_id) make the partitions,
    so equal norms spread as well. Items without a vector are left out.
    """
    kinds = [("max_norm", pa.float64()), ("n", pa.int64()), ("ids", pa.binary()), ("matrix", pa.binary())]
    schema = pa.schema(kinds)

    def packed(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        ids = table.column("item_id").to_numpy()
        values = [[table.column("norm").to_numpy().max()], [len(ids)], [ids.tobytes()], [_matrix(table.column("vector")).tobytes()]]
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, (_, t) in zip(values, kinds)], schema=schema)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                held.append(batch.slice(at, rows - count))
                at += held[-1].num_rows
                count += held[-1].num_rows
                if count == rows:
                    yield packed(held)
                    held, count = [], 0
        if held:
            yield packed(held)

    known = items.where(F.size("vector") > 0).select(F.col("item_id").cast("bigint").alias("item_id"), "vector")
    order = [F.col("norm").desc(), F.col("item_id")]
    ordered = known.withColumn("norm", _norm("vector")).repartitionByRange(*order).sortWithinPartitions(*order)
    return written(ordered.mapInArrow(pack, "max_norm double, n long, ids binary, matrix binary"), "item-blocks")


def _step(k: int, blocks: Broadcast, last: bool):
    """Users against some blocks, in order of falling norm, as far as each user needs them."""
    schema = pa.schema(
        [
            ("user_id", pa.int64()),
            ("vector", pa.list_(pa.float64())),
            ("items", pa.list_(pa.int64())),
            ("scores", pa.list_(pa.float64())),
            ("blocks_read", pa.int64()),
            ("done", pa.bool_()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = [(norm, np.frombuffer(ids, np.int64), np.frombuffer(matrix)) for norm, ids, matrix in blocks.value]
        widest = max(len(ids) for _, ids, _ in read) + k
        for batch in batches:
            for at in range(0, batch.num_rows, max(1, CELLS_AT_ONCE // widest)):
                yield some(batch.slice(at, max(1, CELLS_AT_ONCE // widest)), read)

    def some(users: pa.RecordBatch, read: list) -> pa.RecordBatch:
        n = users.num_rows
        vectors = _matrix(users.column("vector"))
        norms = np.sqrt((vectors * vectors).sum(axis=1))
        # Users still without k items have places for no item, which rank below all others.
        scores, ids = np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max)
        for row, (s, i) in enumerate(zip(users.column("scores").to_pylist(), users.column("items").to_pylist())):
            scores[row, : len(s)], ids[row, : len(i)] = s, i
        count = users.column("blocks_read").to_numpy().copy()
        open_ = np.ones(n, bool)
        for norm, block_ids, matrix in read:
            open_ = norms * norm * (1 + 1e-12) + SLACK >= scores[:, k - 1]
            rows = np.flatnonzero(open_)
            if not len(rows):
                break
            count[rows] += 1
            found = np.round(vectors[rows] @ matrix.reshape(len(block_ids), -1).T, SCORE_DECIMALS)
            if len(block_ids) > k:
                edge = np.partition(found, len(block_ids) - k, axis=1)[:, len(block_ids) - k]
                found[found < edge[:, None]] = -np.inf
            for row, own in zip(rows, found):
                good = np.flatnonzero(own >= scores[row, k - 1])
                s, i = np.concatenate([scores[row], own[good]]), np.concatenate([ids[row], block_ids[good]])
                best = np.lexsort((i, -s))[:k]
                scores[row], ids[row] = s[best], i[best]
        held = np.isfinite(scores)
        lists = [[values[m] for values, m in zip(table, held)] for table in (ids, scores)]
        columns = [users.column("user_id"), users.column("vector"), *lists, count, ~open_ | last]
        made = [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema)]
        return pa.RecordBatch.from_arrays(made, schema=schema)

    return run


def top_k_with_work(
    users: DataFrame,
    items: DataFrame,
    k: int = TOP_K,
    item_block: int = ITEM_BLOCK,
    round_bytes: int = ROUND_BYTES,
) -> DataFrame:
    """The ``k`` items with the largest inner product for every user, exactly, with the work that took.

    Input: (user_id, vector), ids unique, and (item_id, vector). Items are written once as blocks of falling norm. In
    each round some blocks, ``round_bytes`` at most, are broadcast, and users stream through them in the order of norms. By
    Cauchy-Schwarz no item of a block scores above |user| x the block's largest norm, so a user whose k-th score is above
    that needs neither this block nor any later one and leaves the rounds. Users are never copied, only those still open are
    written again, and a task holds the blocks of a round and a bounded number of scores. Ties go to the smaller item id;
    users and items without a vector are left out. Columns: user_id, item_id, score, rank, blocks_read.
    """
    spark = users.sparkSession
    blocks = item_blocks(items, item_block)
    sizes = [(r.max_norm, r.ids_from, r.bytes) for r in blocks.select(
        "max_norm", F.substring("ids", 1, 8).alias("ids_from"), (F.length("matrix") + F.length("ids")).alias("bytes")
    ).collect()]
    sizes.sort(key=lambda r: (-r[0], bytes(r[1])))
    rounds: list[list] = []
    room = 0
    for norm, name, size in sizes:
        if not rounds or size > room:
            rounds.append([])
            room = round_bytes
        rounds[-1].append(bytearray(name))
        room -= size

    open_users = users.where(F.size("vector") > 0).select(
        F.col("user_id").cast("bigint").alias("user_id"),
        F.col("vector").cast("array<double>").alias("vector"),
        F.array().cast("array<bigint>").alias("items"),
        F.array().cast("array<double>").alias("scores"),
        F.lit(0).cast("bigint").alias("blocks_read"),
    )
    schema = "user_id long, vector array<double>, items array<long>, scores array<double>, blocks_read long, done boolean"
    found = []
    for at, names in enumerate(rounds):
        own = blocks.where(F.substring("ids", 1, 8).isin(names)).collect()
        own = sorted(((r.max_norm, bytes(r.ids), bytes(r.matrix)) for r in own), key=lambda r: (-r[0], r[1][:8]))
        sent = spark.sparkContext.broadcast(own)
        last = at == len(rounds) - 1
        stepped = written(open_users.mapInArrow(_step(k, sent, last), schema), "top-k")
        sent.unpersist()
        found.append(stepped.where("done"))
        open_users = stepped.where("not done").drop("done")
        if not last and open_users.isEmpty():
            break
    if not found:
        return spark.createDataFrame([], "user_id long, item_id long, score double, rank int, blocks_read long")
    rows = reduce(DataFrame.unionByName, found)
    pairs = rows.select("user_id", "blocks_read", F.posexplode(F.arrays_zip("items", "scores")).alias("at", "pair"))
    return pairs.select(
        "user_id",
        F.col("pair.items").alias("item_id"),
        F.col("pair.scores").alias("score"),
        (F.col("at") + 1).alias("rank"),
        "blocks_read",
    )


def top_k_items(
    users: DataFrame,
    items: DataFrame,
    k: int = TOP_K,
    item_block: int = ITEM_BLOCK,
    round_bytes: int = ROUND_BYTES,
) -> DataFrame:
    """:func:`top_k_with_work` without the work: user_id, item_id, score, rank."""
    return top_k_with_work(users, items, k, item_block, round_bytes).drop("blocks_read")
