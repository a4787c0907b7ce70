"""Global positions without one global task."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from feedforge.functions.draws import PRIME, mix

# Buckets of the hashed order; each holds an even share of the rows.
BUCKETS = 4096


def shuffled_index(
    df: DataFrame, key: str, seed: int = 0, name: str = "idx", buckets: int = BUCKETS
) -> DataFrame:
    """Dense position from 0 in a seeded hash order of a unique key.

    The hash spreads rows evenly over buckets; bucket sizes give the offset of
    each bucket, so only a table of ``buckets`` rows is ordered globally.
    """
    hashed = df.withColumn("_hash", mix(F.col(key), seed))
    width = F.lit(PRIME // buckets + 1).cast("bigint")
    hashed = hashed.withColumn("_bucket", F.floor(F.col("_hash") / width).cast("int"))
    earlier = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = hashed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.select("_bucket", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))
    within = Window.partitionBy("_bucket").orderBy("_hash", key)
    placed = hashed.withColumn("_rn", F.row_number().over(within).cast("bigint"))
    joined = placed.join(F.broadcast(offsets), "_bucket")
    return joined.withColumn(name, F.col("_offset") + F.col("_rn") - 1).drop(
        "_hash", "_bucket", "_rn", "_offset"
    )


# Rows that may be ordered by one task.
SMALL = 1_000_000
# Bits that one level of the search settles; a level gives the driver at most 2**LEVEL_BITS rows per position.
LEVEL_BITS = 10
_HALF = 1 << 63


@dataclass
class _Search:
    """What is known of one position: values of leading columns, the range of the next one, and the place in that range."""

    rest: int
    rows: int
    low: int
    high: int
    known: tuple[int, ...] = ()

    def shift(self) -> int:
        return max(0, (self.low + _HALF ^ self.high + _HALF).bit_length() - LEVEL_BITS)

    def holds(self, order: list[str]) -> Column:
        inside = F.col(order[len(self.known)]).between(F.lit(self.low), F.lit(self.high))
        return reduce(lambda a, b: a & b, [F.col(c) == v for c, v in zip(order, self.known)], inside)

    def bin(self, order: list[str]) -> Column:
        return F.shiftrightunsigned(F.col(order[len(self.known)]).bitwiseXOR(F.lit(-_HALF)), self.shift())


def order_statistics(
    df: DataFrame, order: list[str], positions: Mapping[str, Callable[[int], int]]
) -> dict[str, tuple | None]:
    """The order keys found at given 0-based positions of a total order of integer columns.

    ``positions`` gives a position from the number of rows; rows with a NULL in ``order`` have none. The key is found column
    by column from its highest bits down: each level is one counting scan of the rows that still can hold a position, in
    at most 2**LEVEL_BITS bins of the range that is left, whatever the values are and however many are distinct. So no row is
    shuffled, and the driver sees a fixed number of rows per level. Once few rows are left one task orders them. A
    position past the end has no key.
    """
    rows = df.select(*[F.col(c).cast("bigint").alias(c) for c in order]).dropna()
    total, low, high = rows.agg(F.count(F.lit(1)), F.min(order[0]), F.max(order[0])).first()
    found: dict[str, tuple | None] = dict.fromkeys(positions)
    todo = {n: _Search(at, total, low, high) for n, p in positions.items() if 0 <= (at := p(total)) < total}
    while todo:
        small = {n: s for n, s in todo.items() if s.rows <= SMALL}
        found.update(_ordered(rows, order, small))
        todo = {n: s for n, s in todo.items() if n not in small}
        if not todo:
            break
        states = list(todo.items())
        bins = [F.when(s.holds(order), F.struct(F.lit(i).alias("i"), s.bin(order).alias("bin"))) for i, (_, s) in enumerate(states)]
        after = F.lit(None).cast("bigint")
        for i, (_, s) in reversed(list(enumerate(states))):
            later = order[len(s.known) + 1 :]
            after = F.when(F.col("_at.i") == i, F.col(later[0]) if later else F.lit(None)).otherwise(after)
        counted = (
            rows.select(*order, F.explode(F.array_compact(F.array(*bins))).alias("_at"))
            .groupBy("_at.i", "_at.bin")
            .agg(F.count(F.lit(1)).alias("n"), F.min(after).alias("low"), F.max(after).alias("high"))
        )
        own: dict[int, list] = {}
        for r in counted.collect():
            own.setdefault(r.i, []).append((r.bin % (1 << 64), r.n, r.low, r.high))
        for i, (name, s) in enumerate(states):
            for value, n, low, high in sorted(own[i], key=lambda b: b[0]):
                if s.rest < n:
                    break
                s.rest -= n
            shift = s.shift()
            s.rows = n
            if shift:
                start = (value << shift) - _HALF
                s.low, s.high = max(s.low, start), min(s.high, start + (1 << shift) - 1)
            else:
                s.known += (value - _HALF,)
                s.low, s.high = low, high
            if len(s.known) == len(order):
                found[name] = s.known
                del todo[name]
    return found


def _ordered(rows: DataFrame, order: list[str], searches: Mapping[str, _Search]) -> dict[str, tuple]:
    """Keys of positions among few rows each."""
    if not searches:
        return {}
    names = list(searches)
    own = [F.when(s.holds(order), F.lit(i)) for i, s in enumerate(searches.values())]
    few = rows.select(*order, F.explode(F.array_compact(F.array(*own))).alias("_i"))
    place = F.row_number().over(Window.partitionBy("_i").orderBy(*order)) - 1
    wanted = F.element_at(F.array(*[F.lit(s.rest) for s in searches.values()]), F.col("_i") + 1)
    found = few.withColumn("_place", place).where(F.col("_place") == wanted).collect()
    return {names[r["_i"]]: tuple(r[c] for c in order) for r in found}


def before_key(order: list[str], key: tuple | None) -> Column:
    """True for rows whose order key is smaller than ``key``; always true without one."""
    if key is None:
        return F.lit(True)
    smaller, equal = F.lit(False), F.lit(True)
    for column, value in zip(order, key):
        smaller = smaller | (equal & (F.col(column) < value))
        equal = equal & (F.col(column) == value)
    return smaller
