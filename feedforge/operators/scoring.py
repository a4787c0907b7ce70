"""Candidate scores."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Default weights.
ACTION_WEIGHTS = {"click": 1.0, "like": 2.0, "share": 4.0, "follow": 3.0, "block": -10.0, "mute": -5.0}
ENGAGEMENT_WEIGHTS = {"click": 0.4, "like": 0.3, "share": 0.2, "follow": 0.1}
PARETO_LAMBDA = 0.3


def weighted_score(predictions: Column, weights: Mapping[str, float] = ACTION_WEIGHTS) -> Column:
    """Sum of weight times prediction; actions absent from the map count 0."""
    terms = [F.lit(w) * F.coalesce(predictions[action], F.lit(0.0)) for action, w in weights.items()]
    return reduce(lambda a, b: a + b, terms, F.lit(0.0))


def engagement_score(
    click: Column, like: Column, share: Column, follow: Column, weights: Mapping[str, float] | None = None
) -> Column:
    """Multi-task engagement; any default weight can be replaced."""
    w = {**ENGAGEMENT_WEIGHTS, **(weights or {})}
    values = {"click": click, "like": like, "share": share, "follow": follow}
    terms = [F.lit(w[name]) * F.coalesce(value, F.lit(0.0)) for name, value in values.items()]
    return reduce(lambda a, b: a + b, terms)


def click_through_like(click: Column, like_given_click: Column) -> Column:
    """Probability of a like over all impressions."""
    return click * like_given_click


def pareto_score(primary: Column, secondary: Column, lambda_factor: float = PARETO_LAMBDA) -> Column:
    """Primary and secondary goal in one score."""
    first, second = F.coalesce(primary, F.lit(0.0)), F.coalesce(secondary, F.lit(0.0))
    return F.lit(1.0 - lambda_factor) * first + F.lit(lambda_factor) * second


def score_chain(df: DataFrame, scorers: Sequence) -> DataFrame:
    """Run scorers in order. Each gives a column for ``score`` or a whole DataFrame."""
    if "score" not in df.columns:
        df = df.withColumn("score", F.lit(0.0))
    for scorer in scorers:
        result = scorer(df)
        df = df.withColumn("score", result) if isinstance(result, Column) else result
    return df
