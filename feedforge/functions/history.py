"""Features of one history array. Arrays are bounded by the history length."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _valid(history: Column) -> Column:
    return F.filter(history, lambda x: x > 0)


def position_decay(length: Column, decay: float = 0.9) -> Column:
    """``decay ** i`` for the positions of a history, newest first."""
    steps = F.sequence(F.lit(0), length.cast("int") - 1)
    weights = F.transform(steps, lambda i: F.pow(F.lit(decay), i.cast("double")))
    return F.when(length > 0, weights).otherwise(F.array().cast("array<double>"))


def valid_length(history: Column) -> Column:
    """Number of real items."""
    return F.size(_valid(history))


def uniqueness(history: Column) -> Column:
    """Share of distinct items among the real ones, 0 when there are none."""
    valid = _valid(history)
    ratio = F.try_divide(F.size(F.array_distinct(valid)).cast("double"), F.size(valid).cast("double"))
    return F.coalesce(ratio, F.lit(0.0))


def id_span(history: Column) -> Column:
    """Largest minus smallest real id, 0 when there are none."""
    valid = _valid(history)
    return F.coalesce((F.array_max(valid) - F.array_min(valid)).cast("bigint"), F.lit(0).cast("bigint"))


def in_history(item_id: Column, history: Column) -> Column:
    """True when a candidate is a real item of the history."""
    return F.coalesce(F.array_contains(_valid(history), item_id), F.lit(False))


def pad_history(history: Column, length: int) -> Column:
    """Exactly ``length`` items: cut on the right, padded with 0."""
    zeros = F.array_repeat(F.lit(0).cast("bigint"), length)
    return F.slice(F.concat(F.coalesce(history.cast("array<bigint>"), F.array().cast("array<bigint>")), zeros), 1, length)


def placeholder_actions(padded: Column, num_actions: int = 4) -> Column:
    """Action matrix of a history without recorded actions: click on real slots.

    A zero inside the history masks that slot only.
    """
    one, zero = F.lit(1.0).cast("float"), F.lit(0.0).cast("float")

    def row(x: Column) -> Column:
        return F.array(F.when(x != 0, one).otherwise(zero), *[zero] * (num_actions - 1))

    return F.transform(padded, row)
