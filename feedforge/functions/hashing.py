"""Hashed ids: the multiplicative table hash and bucket hashes."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the table hash.
MULTIPLIER = 2654435761
AUTHOR_FACTOR = 31
TABLE_SIZE = 100_000
HISTORY_BUCKETS = 50_000
SURFACES = 16


def table_hash(id_col: Column, which: int = 0, table_size: int = TABLE_SIZE, factor: int = 1) -> Column:
    """Slot of ``id * factor`` in the ``which``-th hash table, from 1 to ``table_size``.

    Computed with residues, which equals unbounded integer arithmetic and
    cannot overflow. Slot 0 is kept for padding.
    """
    size = F.lit(table_size).cast("bigint")
    multiplier = F.lit((MULTIPLIER * (which + 1) * factor) % table_size).cast("bigint")
    return F.pmod(F.pmod(id_col.cast("bigint"), size) * multiplier, size) + F.lit(1).cast("bigint")


def multi_hash(id_col: Column, num_hashes: int = 2, table_size: int = TABLE_SIZE) -> Column:
    """Array of the slots of one id in ``num_hashes`` tables."""
    return F.array(*[table_hash(id_col, i, table_size) for i in range(num_hashes)])


def author_hash(item_id: Column, num_hashes: int = 2, table_size: int = TABLE_SIZE) -> Column:
    """Slots of the author stand-in of an item (the logs have no author)."""
    return F.array(*[table_hash(item_id, i, table_size, AUTHOR_FACTOR) for i in range(num_hashes)])


def product_surface(item_id: Column, surfaces: int = SURFACES) -> Column:
    """Surface an item is shown on."""
    return F.pmod(item_id.cast("bigint"), F.lit(surfaces).cast("bigint"))


def bucket_index(value: Column, buckets: int) -> Column:
    """Hashing trick: bucket of the text form of a value, in ``[0, buckets)``."""
    return F.pmod(F.xxhash64(value.cast("string")), F.lit(buckets).cast("bigint"))


def with_bucket_indices(df: DataFrame, buckets: Mapping[str, int], suffix: str = "_bucket") -> DataFrame:
    """One bucket column per feature column, each with its own number of buckets."""
    return df.withColumns({name + suffix: bucket_index(F.col(name), n) for name, n in buckets.items()})


def encode_history(history: Column, buckets: int = HISTORY_BUCKETS) -> Column:
    """Bucket ``1..buckets`` of every history item; padding and bad ids stay 0."""
    zero = F.lit(0).cast("bigint")

    def encode(x: Column) -> Column:
        slot = F.pmod(F.xxhash64(x.cast("bigint")), F.lit(buckets).cast("bigint")) + F.lit(1).cast("bigint")
        return F.when(x <= 0, zero).otherwise(slot)

    return F.transform(history, encode)
