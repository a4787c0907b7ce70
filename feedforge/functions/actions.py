"""The four user actions and their vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The actions, in vector order.
ACTIONS = ("click", "like", "share", "follow")

# The wide action space and where the four actions sit in it.
WIDE_ACTIONS = (
    "favorite_score",
    "reply_score",
    "repost_score",
    "photo_expand_score",
    "click_score",
    "profile_click_score",
    "vqv_score",
    "share_score",
    "share_via_dm_score",
    "share_via_copy_link_score",
    "dwell_score",
    "quote_score",
    "quoted_click_score",
    "follow_author_score",
    "not_interested_score",
    "block_author_score",
    "mute_author_score",
    "report_score",
    "dwell_time",
)
WIDE_SLOT = {"click": 4, "like": 0, "share": 7, "follow": 13}


def has_positive(prefix: str = "") -> Column:
    """True when any of the four flags is 1."""
    flags = [F.coalesce(F.col(prefix + a), F.lit(0)) == 1 for a in ACTIONS]
    return flags[0] | flags[1] | flags[2] | flags[3]


def action_vector(prefix: str = "") -> Column:
    """``[click, like, share, follow]`` as floats."""
    return F.array(*[F.col(prefix + a).cast("float") for a in ACTIONS])


def wide_action_vector(vector: Column) -> Column:
    """The four-slot vector spread over the wide action space."""
    slots = [F.lit(0.0).cast("float")] * len(WIDE_ACTIONS)
    for position, action in enumerate(ACTIONS):
        slots[WIDE_SLOT[action]] = F.get(vector, F.lit(position))
    return F.array(*slots)


def sigmoid(logit: Column) -> Column:
    """Probability of a logit."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-logit))


def smooth_label(label: Column, epsilon: float) -> Column:
    """Label pulled towards one half."""
    return label * F.lit(1.0 - epsilon) + F.lit(0.5 * epsilon)


def bce_with_logits(logit: Column, label: Column) -> Column:
    """Binary cross entropy of one cell in its overflow-free form."""
    zero = F.lit(0.0)
    return F.greatest(logit, zero) - logit * label + F.log1p(F.exp(-F.abs(logit)))
