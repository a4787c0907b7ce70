"""Statistics of the interaction log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedforge.functions.actions import ACTIONS
from feedforge.operators.segments import HOT_ROWS, asc, running


def _plural(action: str) -> str:
    return f"total_{action}s"


def dataset_statistics(df: DataFrame) -> DataFrame:
    """Rows, users, items, action totals and action rates; zeros when empty.

    Distinct users and items are counted as grouped scans, each with its own
    partial aggregation, which avoids expanding every row per distinct column.
    """
    users = df.select("user_id").distinct().agg(F.count(F.lit(1)).alias("n")).scalar()
    items = df.select("item_id").distinct().agg(F.count(F.lit(1)).alias("n")).scalar()
    sums = [F.coalesce(F.sum(F.col(a).cast("bigint")), F.lit(0)).alias(_plural(a)) for a in ACTIONS]
    totals = df.agg(F.count(F.lit(1)).alias("total_interactions"), *sums)
    rates = [
        F.coalesce(F.try_divide(F.col(_plural(a)).cast("double"), F.col("total_interactions")), F.lit(0.0)).alias(
            f"{a}_rate"
        )
        for a in ACTIONS
    ]
    return totals.select("*", users.alias("total_users"), items.alias("total_items"), *rates)


def headline(df: DataFrame) -> DataFrame:
    """Rows, users, items and click rate."""
    stats = dataset_statistics(df)
    return stats.select("total_interactions", "total_users", "total_items", F.col("click_rate").alias("ctr"))


def action_totals(df: DataFrame) -> DataFrame:
    """One row per action."""
    sums = df.agg(*[F.coalesce(F.sum(F.col(a).cast("bigint")), F.lit(0)).alias(a) for a in ACTIONS])
    return sums.unpivot([], list(ACTIONS), "action", "n")


def item_popularity(df: DataFrame) -> DataFrame:
    """Interactions per item."""
    return df.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))


def popular_items(df: DataFrame, n: int = 20) -> DataFrame:
    """The ``n`` most frequent items."""
    return item_popularity(df).orderBy(F.col("n").desc(), "item_id").limit(n)


def user_items(df: DataFrame) -> DataFrame:
    """Distinct items of every user, one row each."""
    return df.select("user_id", "item_id").distinct()


def distinct_ids(df: DataFrame, column: str) -> DataFrame:
    """Distinct users or items."""
    return df.select(column).distinct()


def max_ids(df: DataFrame) -> DataFrame:
    """Largest user and item id."""
    return df.agg(F.max("user_id").alias("max_user_id"), F.max("item_id").alias("max_item_id"))


def item_dimension(df: DataFrame) -> DataFrame:
    """Latest category of every item."""
    latest = F.max_by("video_category", F.struct("ts_s", "row_id")).alias("category")
    return df.groupBy("item_id").agg(latest)


def with_category(df: DataFrame, items: DataFrame, name: str = "category") -> DataFrame:
    """Category of each row's item, 0 when the item is unknown."""
    dim = items.select("item_id", F.col("category").alias("_category"))
    joined = df.join(dim, "item_id", "left")
    return joined.withColumn(name, F.coalesce("_category", F.lit(0))).drop("_category")


def score_spread(df: DataFrame, score: str = "score") -> DataFrame:
    """Population deviation, minimum and maximum of a score."""
    return df.agg(
        F.stddev_pop(score).alias("score_std"), F.min(score).alias("score_min"), F.max(score).alias("score_max")
    )


def non_finite_report(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Number of NaN or infinite values per column."""
    inf = float("inf")
    counts = df.agg(
        *[F.count_if(F.isnan(c) | (F.abs(F.col(c)) == F.lit(inf))).alias(c) for c in columns]
    )
    return counts.unpivot([], list(columns), "column_name", "non_finite")


def min_max_normalize(df: DataFrame, column: str, name: str, keys: Sequence[str] = ()) -> DataFrame:
    """Column scaled to [0, 1] over the table, or inside each group of ``keys``.

    A constant column becomes 0.5. NaN is left out of the range and stays NaN.
    """
    value = F.nanvl(F.col(column), F.lit(None).cast("double"))
    low, high = F.min(value).alias("_low"), F.max(value).alias("_high")
    if keys:
        bounds = df.groupBy(*(F.col(k).alias(f"_key_{k}") for k in keys)).agg(low, high)
        same = [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys]
        df = df.join(bounds, same).drop(*(f"_key_{k}" for k in keys))
        first, last = F.col("_low"), F.col("_high")
    else:
        bounds = df.agg(low, high)
        first, last = bounds.select("_low").scalar(), bounds.select("_high").scalar()
    span = last - first
    scaled = F.when(F.abs(span) < 1e-12, F.lit(0.5)).otherwise(F.try_divide(F.col(column) - first, span))
    return df.withColumn(name, scaled).drop("_low", "_high")


def category_diversity(df: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Distinct categories, entropy and Gini coefficient per request.

    Categories of equal size are merged first, so a request with very many
    categories brings only its distinct sizes to the ordered step.
    """
    sizes = df.groupBy("request_id", "category").agg(F.count(F.lit(1)).alias("c"))
    shapes = sizes.groupBy("request_id", "c").agg(F.count(F.lit(1)).alias("m"))
    ordered = running(shapes, ["request_id"], [asc("c")], {"_until": ("sum", F.col("m"))}, hot_rows)
    ahead = F.col("_until") - F.col("m")
    total, k = F.sum(F.col("m") * F.col("c")), F.sum("m")
    log_part = F.sum(F.col("m") * F.col("c") * F.log(F.col("c").cast("double")))
    weighted = F.sum((F.col("m") * F.col("c")).cast("double") * (F.lit(2) * ahead + F.col("m")))
    parts = ordered.groupBy("request_id").agg(
        total.alias("_n"), k.alias("_k"), log_part.alias("_log"), weighted.alias("_w")
    )
    n, k = F.col("_n").cast("double"), F.col("_k").cast("double")
    return parts.select(
        "request_id",
        F.col("_k").alias("num_categories"),
        (F.log(n) - F.col("_log") / n).alias("entropy"),
        ((F.col("_w") - k * n) / (k * n)).alias("gini"),
    )
