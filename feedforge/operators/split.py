"""Splits and subsets of the interaction log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedforge.functions.draws import mix
from feedforge.operators.index import before_key, order_statistics


def time_cuts(df: DataFrame, train_ratio: float = 0.8, val_ratio: float = 0.1) -> dict[str, tuple | None]:
    """First keys of the validation and test parts in (ts_s, row_id) order."""
    positions = {
        "val": lambda total: int(total * train_ratio),
        "test": lambda total: int(total * (train_ratio + val_ratio)),
    }
    return order_statistics(df, ["ts_s", "row_id"], positions)


def temporal_split(df: DataFrame, train_ratio: float = 0.8, val_ratio: float = 0.1) -> DataFrame:
    """Add ``split``: the earliest rows train, the next validate, the rest test.

    Two cut keys are found by counting; then every row is compared with them
    where it lies, so the log is never sorted or shuffled.
    """
    cuts = time_cuts(df, train_ratio, val_ratio)
    order = ["ts_s", "row_id"]
    split = F.when(before_key(order, cuts["val"]), "train").when(before_key(order, cuts["test"]), "val")
    return df.withColumn("split", split.otherwise("test"))


def part(df: DataFrame, name: str) -> DataFrame:
    """Rows of one split."""
    return df.where(F.col("split") == name).drop("split")


def first_users(df: DataFrame, n: int) -> DataFrame:
    """Rows of the first ``n`` users in row order."""
    users = df.groupBy("user_id").agg(F.min("row_id").alias("_first"))
    chosen = users.orderBy("_first").limit(n).select("user_id")
    return df.join(chosen, "user_id", "left_semi")


def earliest_users(df: DataFrame, n: int) -> DataFrame:
    """Rows of the ``n`` users whose first interaction is earliest."""
    users = df.groupBy("user_id").agg(F.min("ts_s").alias("_first"))
    chosen = users.orderBy("_first", "user_id").limit(n).select("user_id")
    return df.join(chosen, "user_id", "left_semi")


def first_rows(df: DataFrame, n: int | None = None) -> DataFrame:
    """The first ``n`` rows in row order, or all of them."""
    return df if n is None else df.orderBy("row_id").limit(n)


def rows_by_id(df: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows named by a list of row ids."""
    return df.join(ids.select("row_id").distinct(), "row_id", "left_semi")


def row_range(df: DataFrame, start: int, stop: int) -> DataFrame:
    """Rows with ``start <= row_id < stop``; the range reaches the scan."""
    return df.where((F.col("row_id") >= start) & (F.col("row_id") < stop))


def subsample(df: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows without replacement, chosen by a seeded hash of the row id.

    The threshold is found by counting bins of hashes, so nothing is sorted.
    """
    hashed = df.withColumn("_hash", mix(F.col("row_id"), seed))
    order = ["_hash", "row_id"]
    cut = order_statistics(hashed, order, {"limit": lambda total: n})["limit"]
    return hashed.where(before_key(order, cut)).drop("_hash")


def rows_of_first_positions(df: DataFrame) -> DataFrame:
    """First row of every user, by row id, among rows with a history."""
    others = [c for c in df.columns if c != "user_id"]
    first = df.groupBy("user_id").agg(F.min_by(F.struct(*others), F.col("row_id")).alias("_first"))
    rows = first.select("user_id", "_first.*").select(df.columns)
    return rows.where(F.size(F.filter("hist_items", lambda x: x > 0)) > 0)
