"""Candidate filters.

A filter returns every row; ``removed_by`` names the filter that removed it,
or is null for a row that is still kept. Rows removed earlier are left alone,
so filters chain. ``(request_id, pos)`` identifies a row.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedforge.operators.keywords import found_keywords
from feedforge.operators.segments import HOT_ROWS, asc, is_bounded, row_number, top_n
from feedforge.session import written

ROW = ["request_id", "pos"]
# Fixed value: two days.
MAX_AGE_SECONDS = 172_800
MAX_PER_CATEGORY = 3
# Seen items a user may have as one array.
SEEN_ITEMS = 1 << 16


def with_removed_by(df: DataFrame) -> DataFrame:
    """Add an empty ``removed_by`` where there is none."""
    if "removed_by" in df.columns:
        return df
    return df.withColumn("removed_by", F.lit(None).cast("string"))


def kept(df: DataFrame) -> DataFrame:
    """Rows no filter removed."""
    return df.where(F.col("removed_by").isNull()).drop("removed_by")


def removed(df: DataFrame) -> DataFrame:
    """Rows some filter removed."""
    return df.where(F.col("removed_by").isNotNull())


def removal_counts(df: DataFrame) -> DataFrame:
    """Rows per filter; kept rows count under ``kept``."""
    return df.groupBy(F.coalesce("removed_by", F.lit("kept")).alias("removed_by")).agg(
        F.count(F.lit(1)).alias("n")
    )


def mark(df: DataFrame, condition: Column, name: str) -> DataFrame:
    """Mark kept rows that meet a condition."""
    df = with_removed_by(df)
    hit = F.col("removed_by").isNull() & F.coalesce(condition, F.lit(False))
    return df.withColumn("removed_by", F.when(hit, F.lit(name)).otherwise(F.col("removed_by")))


def _flag(df: DataFrame, other: DataFrame, on: Sequence[str], flag: str) -> DataFrame:
    """Left join on keys made unique first, so no row is lost or doubled."""
    keys = other.select(*on).distinct().withColumn(flag, F.lit(True))
    return df.join(keys, list(on), "left")


def _nth(df: DataFrame, key: str, hot_rows: int, bounded: bool) -> DataFrame:
    """Add ``_nth``: the place of a kept row among the kept rows of its request and ``key``.

    Group sizes are checked without regard to earlier filters, so the check
    reads only the key columns.
    """
    bounded = bounded or is_bounded(df, ["request_id", key], hot_rows)
    alive = df.withColumn("_alive", F.col("removed_by").isNull())
    return row_number(alive, ["request_id", key, "_alive"], [asc("pos")], "_nth", hot_rows, bounded=bounded)


def dedup(df: DataFrame, name: str = "dedup", hot_rows: int = HOT_ROWS, bounded: bool = False) -> DataFrame:
    """Keep the first occurrence of an item in a request.

    Very many copies of one item are cut into segments and do not meet in one
    task. ``bounded`` states that requests are small, which spares the check.
    """
    df = with_removed_by(df)
    return mark(_nth(df, "item_id", hot_rows, bounded), F.col("_nth") > 1, name).select(df.columns)


def dedup_kept(df: DataFrame) -> DataFrame:
    """Only the first occurrences, in one shuffle."""
    others = [c for c in df.columns if c not in ("request_id", "item_id")]
    first = F.min_by(F.struct(*others), F.col("pos")).alias("_first")
    grouped = df.groupBy("request_id", "item_id").agg(first)
    return grouped.select("request_id", "item_id", "_first.*").select(df.columns)


def _age_condition(now: Column, max_age: int) -> Column:
    return ~F.col("ts_s").between(now - F.lit(max_age), now)


def _clock(now: int) -> Column:
    return F.unix_timestamp(F.current_timestamp()) if now == 0 else F.lit(now)


def age(df: DataFrame, now: int, max_age: int = MAX_AGE_SECONDS, name: str = "age") -> DataFrame:
    """Remove rows older than ``max_age`` seconds and rows from the future."""
    return mark(df, _age_condition(F.lit(now), max_age), name)


@dataclass(frozen=True)
class GroupBlocks:
    """Blocked pairs as two tables: every user of a group blocks every author of it.

    ``users`` has (user_id, group) and ``authors`` (author_id, group). The pairs themselves, users x authors of a group, are
    never built. The groups of one user or author travel as an array.
    """

    users: DataFrame
    authors: DataFrame

    def flag(self, df: DataFrame, flag: str) -> DataFrame:
        """Add a column that is true where a row's user and author have a group in common."""
        groups = F.collect_set("group")
        by_user = self.users.groupBy("user_id").agg(groups.alias("_user_groups"))
        by_author = self.authors.groupBy("author_id").agg(groups.alias("_author_groups"))
        joined = df.join(by_user, "user_id", "left").join(by_author, "author_id", "left")
        return joined.withColumn(flag, F.arrays_overlap("_user_groups", "_author_groups"))


def _flag_blocked(df: DataFrame, blocked: DataFrame | GroupBlocks) -> DataFrame:
    if isinstance(blocked, GroupBlocks):
        return blocked.flag(df, "_blocked")
    return _flag(df, blocked, ["user_id", "author_id"], "_blocked")


def blocked_author(df: DataFrame, blocked: DataFrame | GroupBlocks, name: str = "blocked_author") -> DataFrame:
    """Remove authors the user blocked; ``blocked`` has (user_id, author_id) or is given by groups."""
    df = with_removed_by(df)
    flagged = _flag_blocked(df, blocked)
    return mark(flagged, F.col("_blocked"), name).select(df.columns)


def self_item(df: DataFrame, name: str = "self_item") -> DataFrame:
    """Remove the user's own items."""
    return mark(df, F.col("author_id") == F.col("user_id"), name)


def seen(df: DataFrame, seen_items: DataFrame, name: str = "seen") -> DataFrame:
    """Remove items the user has seen; ``seen_items`` has (user_id, item_id)."""
    df = with_removed_by(df)
    flagged = _flag(df, seen_items, ["user_id", "item_id"], "_seen")
    return mark(flagged, F.col("_seen"), name).select(df.columns)


def seen_by_request(
    df: DataFrame, requests: DataFrame, seen_items: DataFrame, name: str = "seen", most: int | None = None
) -> DataFrame:
    """:func:`seen` for candidates that are dealt by request already and then stay where they are.

    What a user has seen is one array, which goes to the requests of that user. ``requests`` has (request_id, user_id) of
    all candidates. If a user has seen more than ``most`` items, all rows are joined item by item as in :func:`seen`.
    """
    df = with_removed_by(df)
    pairs = written(seen_items.select("user_id", "item_id").dropna().distinct(), "seen-items")
    if not is_bounded(pairs, ["user_id"], SEEN_ITEMS if most is None else most):
        return seen(df, pairs, name)
    sets = pairs.groupBy("user_id").agg(F.collect_list("item_id").alias("items"))
    users = requests.select("request_id", "user_id").distinct().join(sets, "user_id")
    by_request = users.groupBy("request_id").agg(F.collect_list(F.struct("user_id", "items")).alias("_sets"))
    hit = F.exists("_sets", lambda s: (s["user_id"] == F.col("user_id")) & F.array_contains(s["items"], F.col("item_id")))
    return mark(df.join(by_request, "request_id", "left"), hit, name).select(df.columns)


def muted_keyword(df: DataFrame, keywords: Sequence[str], name: str = "muted_keyword") -> DataFrame:
    """Remove texts with any of the given keywords, whatever their case."""
    df = with_removed_by(df)
    # A column of its own, so that each text is lowered once for all keywords.
    lowered = df.withColumn("_text", F.lower("text"))
    hit = F.lit(False)
    for keyword in keywords:
        hit = hit | F.col("_text").contains(F.lower(F.lit(keyword)))
    return mark(lowered, hit, name).select(df.columns)


def muted_keyword_by_user(df: DataFrame, keywords: DataFrame, name: str = "muted_keyword") -> DataFrame:
    """Remove texts with a keyword their user muted; ``keywords`` has (user_id, keyword).

    The keywords of all users are found in one pass over the texts of kept rows; what was found is joined to what the
    user muted by (user, keyword). Only row keys travel.
    """
    df = with_removed_by(df)
    muted = keywords.select("user_id", F.lower("keyword").alias("_word")).where("_word IS NOT NULL").distinct()
    texts = df.where(F.col("removed_by").isNull()).select(*ROW, "user_id", "text")
    hits = found_keywords(texts, muted).join(muted, ["user_id", "_word"], "left_semi")
    flagged = _flag(df, hits, ROW, "_muted")
    return mark(flagged, F.col("_muted"), name).select(df.columns)


def batch_filter(
    df: DataFrame,
    blocked: DataFrame | GroupBlocks,
    seen_items: DataFrame,
    now: int = 0,
    max_age: int = MAX_AGE_SECONDS,
    hot_rows: int = HOT_ROWS,
    bounded: bool = False,
) -> DataFrame:
    """Dedup, age, blocked author, own item and seen item in one pass.

    A later copy is a duplicate even when the first copy is removed by another
    rule. ``now=0`` means the clock.
    """
    df = with_removed_by(df)
    flagged = _nth(df, "item_id", hot_rows, bounded)
    flagged = _flag_blocked(flagged, blocked)
    flagged = _flag(flagged, seen_items, ["user_id", "item_id"], "_seen")
    reason = (
        F.when(F.col("removed_by").isNotNull(), F.col("removed_by"))
        .when(F.col("_nth") > 1, F.lit("dedup"))
        .when(_age_condition(_clock(now), max_age), F.lit("age"))
        .when(F.col("_blocked"), F.lit("blocked_author"))
        .when(F.col("author_id") == F.col("user_id"), F.lit("self_item"))
        .when(F.col("_seen"), F.lit("seen"))
    )
    return flagged.withColumn("removed_by", reason).select(df.columns)


def category_cap(
    df: DataFrame,
    max_per_category: int = MAX_PER_CATEGORY,
    name: str = "category_cap",
    hot_rows: int = HOT_ROWS,
    bounded: bool = False,
) -> DataFrame:
    """Keep the first rows of every category of a request."""
    df = with_removed_by(df)
    placed = _nth(df, "category", hot_rows, bounded)
    return mark(placed, F.col("_nth") > max_per_category, name).select(df.columns)


def category_cap_kept(df: DataFrame, max_per_category: int = MAX_PER_CATEGORY) -> DataFrame:
    """Only the rows :func:`category_cap` keeps; the limit acts before the shuffle."""
    return top_n(df, ["request_id", "category"], [asc("pos")], max_per_category, "_nth").drop("_nth")


def category_counts(df: DataFrame) -> DataFrame:
    """Kept rows per request and category."""
    return kept(df).groupBy("request_id", "category").agg(F.count(F.lit(1)).alias("n"))


def chain(df: DataFrame, filters: Sequence[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Run filters in order; a row keeps the name of the first one that removed it."""
    df = with_removed_by(df)
    for one in filters:
        df = one(df)
    return df
