"""Selection and reranking inside a request."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedforge.operators.scoring import PARETO_LAMBDA, pareto_score
from feedforge.operators.segments import HOT_ROWS, asc, desc, is_bounded, row_number, running, top_n

AUTHOR_DECAY = 0.7
BY_SCORE = (desc("score"), asc("pos"))


def top_k(df: DataFrame, k: int = 50) -> DataFrame:
    """The best ``k`` candidates of every request, ranked."""
    return top_n(df, ["request_id"], BY_SCORE, k)


def by_score(df: DataFrame, hot_rows: int = HOT_ROWS, bounded: bool = False) -> DataFrame:
    """All candidates ranked by score, ties by position."""
    return row_number(df, ["request_id"], BY_SCORE, "rank", hot_rows, bounded=bounded)


def first_ranks(df: DataFrame, n: int = 50) -> DataFrame:
    """Ranked rows cut to the result size."""
    return df.where(F.col("rank") <= n)


def author_diversity(
    df: DataFrame, decay: float = AUTHOR_DECAY, hot_rows: int = HOT_ROWS, bounded: bool = False
) -> DataFrame:
    """Score lowered by ``decay`` for every earlier item of the same author.

    Without an author the item stands for itself.
    """
    author = F.coalesce(F.col("author_id"), F.col("item_id"))
    keys = ["request_id", "_author"]
    counted = row_number(df.withColumn("_author", author), keys, [asc("pos")], "_nth", hot_rows, bounded=bounded)
    factor = F.pow(F.lit(decay), (F.col("_nth") - 1).cast("double"))
    return counted.withColumn("score", F.col("score") * factor).drop("_author", "_nth")


def author_diversity_rerank(df: DataFrame, decay: float = AUTHOR_DECAY, hot_rows: int = HOT_ROWS) -> DataFrame:
    """:func:`author_diversity`, then a new rank by the lowered score."""
    bounded = is_bounded(df, ["request_id"], hot_rows)
    return by_score(author_diversity(df, decay, hot_rows, bounded), hot_rows, bounded)


def pareto_rerank(
    df: DataFrame,
    primary: str,
    secondary: str,
    lambda_factor: float = PARETO_LAMBDA,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Rank by the combination of two goals."""
    scored = df.withColumn("score", pareto_score(F.col(primary), F.col(secondary), lambda_factor))
    return by_score(scored, hot_rows)


def category_interleave(df: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Round robin over categories, best first item first.

    A row's round is its place in its category. Inside a round the categories
    are ordered by the score of their first item, ties by first position.
    """
    bounded = is_bounded(df, ["request_id"], hot_rows)
    rounds = running(
        df,
        ["request_id", "category"],
        [asc("pos")],
        {
            "_round": ("count", None),
            "_head_score": ("first", F.coalesce("score", F.lit(0.0))),
            "_head_pos": ("first", F.col("pos")),
        },
        hot_rows,
        bounded=bounded,
    )
    order = [asc("_round"), desc("_head_score"), asc("_head_pos")]
    ranked = row_number(rounds, ["request_id"], order, "rank", hot_rows, bounded=bounded)
    return ranked.drop("_round", "_head_score", "_head_pos")
