"""Arithmetic on ``array<float>`` vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 1e-12
SCORE_LIMIT = 100.0


def dot(u: Column, v: Column) -> Column:
    """Inner product in double precision."""
    products = F.zip_with(u, v, lambda a, b: a.cast("double") * b.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def l2_norm(u: Column) -> Column:
    """Euclidean length."""
    return F.sqrt(dot(u, u))


def l2_normalize(u: Column) -> Column:
    """Vector divided by its length; a zero vector stays zero."""
    norm = l2_norm(u) + F.lit(EPSILON)
    return F.transform(u, lambda x: x.cast("double") / norm)


def clamp_score(score: Column) -> Column:
    """Score held inside +-100."""
    return F.greatest(F.lit(-SCORE_LIMIT), F.least(F.lit(SCORE_LIMIT), score))


def two_tower_score(user: Column, item: Column, temperature: float = 1.0) -> Column:
    """Cosine of the two towers, clamped, divided by the temperature."""
    cosine = dot(user, item) / ((l2_norm(user) + F.lit(EPSILON)) * (l2_norm(item) + F.lit(EPSILON)))
    return clamp_score(cosine) / F.lit(temperature)


def click_plus_dot(click_logit: Column, score: Column) -> Column:
    """Ranking score: click logit plus the two-tower score, clamped."""
    return clamp_score(click_logit + score)
