"""User profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedforge.functions.actions import ACTIONS

DAY = 86_400.0


def category_scores(df: DataFrame) -> DataFrame:
    """Share of each category in a user's clicks and double-counted likes."""
    points = (F.col("click") + F.lit(2) * F.col("like")).cast("double")
    per_category = df.groupBy("user_id", "video_category").agg(F.sum(points).alias("_points"))
    totals = per_category.groupBy("user_id").agg(F.sum("_points").alias("_total"))
    share = F.when(F.col("_total") > 0, F.col("_points") / F.col("_total")).otherwise(F.lit(0.0))
    return per_category.join(totals, "user_id").select(
        "user_id", F.col("video_category").alias("category"), share.alias("preference")
    )


def category_preference(df: DataFrame, num_categories: int = 100) -> DataFrame:
    """Preference vector of every user, ``num_categories`` long.

    Categories outside the vector count in the total but have no slot.
    """
    scores = category_scores(df)
    inside = F.col("category").between(0, num_categories - 1)
    entries = F.collect_list(F.when(inside, F.struct("category", "preference")))
    per_user = scores.groupBy("user_id").agg(F.map_from_entries(entries).alias("_by_category"))
    slots = F.sequence(F.lit(0), F.lit(num_categories - 1))
    vector = F.transform(slots, lambda i: F.coalesce(F.try_element_at("_by_category", i), F.lit(0.0)))
    return per_user.select("user_id", vector.alias("preference"))


def activity_score(count: Column, kinds: Column, days: Column) -> Column:
    """Activity from volume, variety and daily rate."""
    count = count.cast("double")
    daily = F.when(days > 0, F.try_divide(count, days)).otherwise(count)
    volume = F.least(count / F.lit(100.0), F.lit(1.0))
    frequency = F.least(daily / F.lit(10.0), F.lit(1.0))
    return volume * F.lit(0.4) + kinds.cast("double") / F.lit(4.0) * F.lit(0.3) + frequency * F.lit(0.3)


def activity_level(count: Column, score: Column) -> Column:
    """Level 0 (new) to 4 (very active)."""
    return (
        F.when(count < 5, 0).when(score < 0.2, 1).when(score < 0.5, 2).when(score < 0.8, 3).otherwise(4)
    )


def user_activity(df: DataFrame) -> DataFrame:
    """Activity score and level of every user, with the counts behind them."""
    per_user = df.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(F.col(a).cast("bigint")).alias(f"n_{a}") for a in ACTIONS],
        ((F.max("ts_s") - F.min("ts_s")).cast("double") / F.lit(DAY)).alias("days"),
    )
    kinds = sum((F.col(f"n_{a}") > 0).cast("int") for a in ACTIONS)
    scored = per_user.withColumn("activity_score", activity_score(F.col("n"), kinds, F.col("days")))
    return scored.withColumn("activity_level", activity_level(F.col("n"), F.col("activity_score")))
