"""Ordered work inside groups without one task per group.

A plain window sends a whole group to one task. Before such a window the group sizes are counted, which is one aggregated
pass over the keys. Usually no group is too large and the plain window is used. Otherwise the rows of all large groups,
however many, are range partitioned by (keys, order) from a sample of quantiles and written once; what a partition holds
of a group is a segment, of about ``hot_rows`` rows, and a window partition of its own. Segment totals form a table, running
totals over it carry the result across segments, and if a group has too many segments for one task, these
running totals are made in the same way: a tree of totals, one level per factor ``hot_rows``. No rows, cut points or totals
pass through the driver. Segments change the plan only, never the result.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from feedforge.session import written

# Rows a group may have before it is cut, and about the rows of a segment.
HOT_ROWS = 5_000_000
# Segments of one group that may be ordered by one task, whatever ``hot_rows``.
LEAST_ROWS = 8

SEGMENT = "_segment"
_PART = "_part"
_INTEGERS = ("tinyint", "smallint", "int", "bigint")


@dataclass(frozen=True)
class Order:
    """One column of a total order."""

    column: str
    descending: bool = False

    def sort(self) -> Column:
        return F.col(self.column).desc() if self.descending else F.col(self.column).asc()

    def ascending_key(self, kind: str) -> Column:
        """The column, of type ``kind``, turned so that ascending comparison gives this order, NULL and NaN included."""
        column = F.col(self.column)
        if not self.descending:
            return column
        if kind in _INTEGERS:
            return F.struct(column.isNull().alias("null"), F.bitwise_not(column).alias("value"))
        nan = F.coalesce(F.isnan(column.cast("double")), F.lit(False))
        return F.struct(column.isNull().alias("null"), (~nan).alias("number"), F.when(~nan, -column).alias("value"))


def asc(column: str) -> Order:
    return Order(column)


def desc(column: str) -> Order:
    """Descending order of a numeric column."""
    return Order(column, True)


def _same(left: Sequence[str], right: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(x).eqNullSafe(F.col(y)) for x, y in zip(left, right)])


def hot_groups(df: DataFrame, keys: Sequence[str], hot_rows: int = HOT_ROWS) -> DataFrame | None:
    """Keys of the groups to cut with ``_rows``, written, or None. There are at most rows / ``hot_rows`` of them."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > hot_rows)
    return None if counts.isEmpty() else written(counts, "large-groups")


def is_bounded(df: DataFrame, keys: Sequence[str], hot_rows: int = HOT_ROWS) -> bool:
    """True when no group of ``keys`` is too large for one task.

    Groups of more keys are smaller still, so one check can serve several
    windows over the same rows.
    """
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    return sizes.where(F.col("_rows") > hot_rows).isEmpty()


def _parted(df: DataFrame, keys: Sequence[str], order: Sequence[Order], hot_rows: int) -> tuple[DataFrame, DataFrame] | None:
    """Rows of ordinary groups, and rows of large groups with their segment, written; or None."""
    hot = hot_groups(df, keys, hot_rows)
    if hot is None:
        return None
    names = [f"_hot_{i}" for i in range(len(keys))]
    large = hot.select(*[F.col(k).alias(n) for k, n in zip(keys, names)])
    segments = -(-hot.agg(F.sum("_rows")).first()[0] // hot_rows) + 1
    ordered = df.join(large, _same(keys, names), "left_semi").repartitionByRange(segments, *keys, *[o.sort() for o in order])
    return df.join(large, _same(keys, names), "left_anti"), written(ordered.withColumn(SEGMENT, F.spark_partition_id()), "segments")


def cut(df: DataFrame, keys: Sequence[str], order: Sequence[Order], hot_rows: int = HOT_ROWS) -> DataFrame | None:
    """Rows with their segment number, or None when no group is too large.

    Ordinary groups are segment 0 and have ``_cut`` false. Segments of a group rise along ``order``; rows that are equal in
    it share a segment.
    """
    parted = _parted(df, list(keys), order, hot_rows)
    if parted is None:
        return None
    cold, hot = parted
    return cold.withColumns({SEGMENT: F.lit(0), "_cut": F.lit(False)}).unionByName(hot.withColumn("_cut", F.lit(True)))


_SUPPORTED = ("count", "sum", "max", "min", "first")


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Order],
    outputs: Mapping[str, tuple[str, Column | None]],
    hot_rows: int = HOT_ROWS,
    bounded: bool = False,
    exclusive: bool = False,
) -> DataFrame:
    """Running aggregates from the start of a group to the current row, or with ``exclusive`` to the row before.

    ``outputs`` maps a new column to (kind, expression); kinds are count, sum, max, min and first (the value of the
    group's first row). ``order`` must be total. Set ``bounded`` when every group is small by construction, which spares
    the count of group sizes. Empty ``keys`` mean one global group.
    """
    for kind, _ in outputs.values():
        if kind not in _SUPPORTED:
            raise ValueError(f"unknown running aggregate {kind}")
    keys = list(keys)
    drop: list[str] = []
    if not keys:
        df, keys, drop = df.withColumn("_all", F.lit(0)), ["_all"], ["_all"]
    inputs = {f"_in_{name}": (F.lit(1).cast("bigint") if e is None else e) for name, (_, e) in outputs.items()}
    drop += list(inputs)
    ready = df.withColumns(inputs)

    def over(rows: DataFrame, *parts: str) -> DataFrame:
        by = Window.partitionBy(*keys, *parts).orderBy(*[o.sort() for o in order])
        return rows.withColumns({n: _over(kind, f"_in_{n}", by, exclusive) for n, (kind, _) in outputs.items()})

    parted = None if bounded else _parted(ready, keys, order, hot_rows)
    if parted is None:
        return over(ready).drop(*drop)

    cold, hot = parted
    kinds = dict(hot.dtypes)
    key = F.struct(*[o.ascending_key(kinds[o.column]) for o in order])
    totals = hot.groupBy(*keys, F.col(SEGMENT).alias(_PART)).agg(*[_total(kind, f"_in_{n}", key).alias(f"_total_{n}") for n, (kind, _) in outputs.items()])
    carried = {f"_before_{n}": ("sum" if kind == "count" else kind, F.col(f"_total_{n}")) for n, (kind, _) in outputs.items()}
    before = running(written(totals, "totals"), keys, [asc(_PART)], carried, max(hot_rows, LEAST_ROWS), exclusive=True)
    names = [f"_key_{i}" for i in range(len(keys) + 1)]
    before = before.select(*[F.col(k).alias(n) for k, n in zip([*keys, _PART], names)], *carried)
    joined = over(hot, SEGMENT).join(before, _same([*keys, SEGMENT], names), "left")
    merged = joined.withColumns({n: _merge(kind, n, f"_before_{n}") for n, (kind, _) in outputs.items()})
    return over(cold).unionByName(merged.drop(*names, *carried, SEGMENT)).drop(*drop)


def row_number(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Order],
    name: str,
    hot_rows: int = HOT_ROWS,
    bounded: bool = False,
) -> DataFrame:
    """Position of a row in its group, from 1."""
    return running(df, keys, order, {name: ("count", None)}, hot_rows, bounded)


def top_n(df: DataFrame, keys: Sequence[str], order: Sequence[Order], n: int, name: str = "rank") -> DataFrame:
    """The first ``n`` rows of every group with their position.

    The filter on the row number lets Spark keep only ``n`` rows per group and
    task before the shuffle, so a large group does not travel whole.
    """
    by = Window.partitionBy(*keys).orderBy(*[o.sort() for o in order])
    return df.withColumn(name, F.row_number().over(by)).where(F.col(name) <= n)


def _over(kind: str, column: str, by, exclusive: bool) -> Column:
    frame = by.rowsBetween(Window.unboundedPreceding, -1 if exclusive else Window.currentRow)
    if kind == "count":
        return F.row_number().over(by).cast("bigint") - int(exclusive)
    if kind == "first":
        return F.first(column).over(frame)
    return {"sum": F.sum, "max": F.max, "min": F.min}[kind](column).over(frame)


def _total(kind: str, column: str, key: Column) -> Column:
    if kind == "first":
        return F.min_by(F.struct(F.col(column).alias("value")), key)
    if kind == "count":
        return F.count(F.lit(1))
    return {"sum": F.sum, "max": F.max, "min": F.min}[kind](column)


def _merge(kind: str, local: str, before: str) -> Column:
    if kind == "first":
        return F.when(F.col(before).isNotNull(), F.col(before)["value"]).otherwise(F.col(local))
    if kind in ("sum", "count"):
        return F.coalesce(F.col(local) + F.col(before), F.col(local), F.col(before))
    return {"max": F.greatest, "min": F.least}[kind](F.col(local), F.col(before))
