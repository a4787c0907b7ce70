"""Ranking metrics over long rows (sample_id, cand_pos, label, score).

A candidate's rank is by score, ties by position. Labels are 0 or 1.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from feedforge.functions.actions import bce_with_logits, sigmoid, smooth_label
from feedforge.operators.segments import HOT_ROWS, asc, desc, row_number, running, top_n

K_VALUES = (5, 10, 20)


def score_counts(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """Positives and negatives at every distinct score."""
    return df.groupBy(F.col(score).alias("score")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg")
    )


def average_ranks(df: DataFrame, score: str = "score", hot_rows: int = HOT_ROWS) -> DataFrame:
    """Average 1-based rank of every distinct score, with the number of its rows."""
    counts = df.groupBy(F.col(score).alias("score")).agg(F.count(F.lit(1)).alias("n"))
    ordered = running(counts, [], [asc("score")], {"_until": ("sum", F.col("n"))}, hot_rows)
    rank = (F.col("_until") - F.col("n")).cast("double") + (F.col("n") + 1) / F.lit(2.0)
    return ordered.select("score", "n", rank.alias("avg_rank"))


def auc(df: DataFrame, label: str = "label", score: str = "score", name: str = "auc") -> DataFrame:
    """Area under the ROC curve; one half when a class is missing.

    Rows are first counted per distinct score. The scores are range
    partitioned, each range adds up its own pairs, and one row per range is
    combined at the end, so no step orders all scores in one task.
    """
    counts = score_counts(df, label, score).repartitionByRange("score").withColumn("_range", F.spark_partition_id())
    by = Window.partitionBy("_range").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    below = F.coalesce(F.sum("neg").over(by), F.lit(0)).cast("double") + F.col("neg") / F.lit(2.0)
    ranges = (
        counts.withColumn("_pairs", F.col("pos").cast("double") * below)
        .groupBy("_range")
        .agg(F.sum("_pairs").alias("_pairs"), F.sum("pos").alias("_pos"), F.sum("neg").alias("_neg"))
    )
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("_neg").over(earlier), F.lit(0)).cast("double")
    across = ranges.withColumn("_pairs", F.col("_pairs") + F.col("_pos").cast("double") * before)
    pos, neg = F.sum("_pos").cast("double"), F.sum("_neg").cast("double")
    area = F.try_divide(F.sum("_pairs"), pos * neg)
    return across.agg(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(area, F.lit(0.5)))).alias(name))


def _ranked(df: DataFrame, hot_rows: int) -> DataFrame:
    return row_number(df, ["sample_id"], [desc("score"), asc("cand_pos")], "rank", hot_rows)


def _sample_sums(df: DataFrame, ks: Sequence[int], hot_rows: int) -> DataFrame:
    """Per sample: candidates, positives, best positive rank, hits and gain in each top K."""
    positive = F.col("label") > 0
    rank = F.col("rank")
    gain = F.col("label").cast("double") / F.log2((rank + 1).cast("double"))
    per_k = []
    for k in ks:
        per_k.append(F.count_if(positive & (rank <= k)).alias(f"hits_{k}"))
        per_k.append(F.coalesce(F.sum(F.when(rank <= k, gain)), F.lit(0.0)).alias(f"dcg_{k}"))
    return _ranked(df, hot_rows).groupBy("sample_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(positive).alias("n_pos"),
        F.min(F.when(positive, rank)).alias("best"),
        *per_k,
    )


def _ideal(n_pos: Column, n: Column, k: int) -> Column:
    """Best possible gain of 0/1 labels: all positives first."""
    shown = F.least(n_pos, n, F.lit(k).cast("bigint")).cast("int")
    steps = F.when(shown > 0, F.sequence(F.lit(1), shown)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, F.lit(0.0), lambda acc, i: acc + F.lit(1.0) / F.log2((i + 1).cast("double")))


def sample_metrics(df: DataFrame, ks: Sequence[int] = K_VALUES, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Every per-sample metric, one row per sample."""
    sums = _sample_sums(df, ks, hot_rows)
    columns = [F.coalesce(F.lit(1.0) / F.col("best"), F.lit(0.0)).alias("mrr")]
    for k in ks:
        hits = F.col(f"hits_{k}").cast("double")
        ideal = _ideal(F.col("n_pos"), F.col("n"), k)
        columns += [
            F.coalesce(F.try_divide(F.col(f"dcg_{k}"), ideal), F.lit(0.0)).alias(f"ndcg@{k}"),
            F.when(hits > 0, 1.0).otherwise(0.0).alias(f"hit_rate@{k}"),
            F.coalesce(F.try_divide(hits, F.col("n_pos")), F.lit(0.0)).alias(f"recall@{k}"),
            (hits / F.least(F.col("n"), F.lit(k).cast("bigint"))).alias(f"precision@{k}"),
        ]
    return sums.select("sample_id", "n", "n_pos", *columns)


def mean_metrics(df: DataFrame, ks: Sequence[int] = K_VALUES, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Means over all samples, one row."""
    per_sample = sample_metrics(df, ks, hot_rows)
    names = [c for c in per_sample.columns if c not in ("sample_id", "n", "n_pos")]
    return per_sample.agg(*[F.avg(F.col(f"`{c}`")).alias(c) for c in names])


def ndcg_at_k(df: DataFrame, k: int = 10, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Mean NDCG@K with linear gain."""
    return mean_metrics(df, [k], hot_rows).select(F.col(f"`ndcg@{k}`").alias("ndcg"))


def _top_hits(df: DataFrame, k: int) -> DataFrame:
    """Per sample: candidates, positives and hits in the top K, without a full ranking."""
    best = top_n(df, ["sample_id"], [desc("score"), asc("cand_pos")], k)
    hits = best.groupBy("sample_id").agg(F.count_if(F.col("label") > 0).alias("hits"))
    sizes = df.groupBy("sample_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") > 0).alias("n_pos")
    )
    return sizes.join(hits, "sample_id")


def hit_rate_at_k(df: DataFrame, k: int = 10) -> DataFrame:
    """Share of samples with a positive in the top K."""
    return _top_hits(df, k).agg(F.avg(F.when(F.col("hits") > 0, 1.0).otherwise(0.0)).alias("hit_rate"))


def recall_at_k(df: DataFrame, k: int = 10) -> DataFrame:
    """Mean share of a sample's positives found in the top K."""
    recall = F.coalesce(F.try_divide(F.col("hits").cast("double"), F.col("n_pos")), F.lit(0.0))
    return _top_hits(df, k).agg(F.avg(recall).alias("recall"))


def precision_at_k(df: DataFrame, k: int = 10) -> DataFrame:
    """Mean share of positives in the top K."""
    shown = F.least(F.col("n"), F.lit(k).cast("bigint"))
    return _top_hits(df, k).agg(F.avg(F.col("hits").cast("double") / shown).alias("precision"))


def mrr(df: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Mean reciprocal rank of the best positive, 0 without one."""
    return mean_metrics(df, [], hot_rows)


def all_metrics(df: DataFrame, ks: Sequence[int] = K_VALUES, hot_rows: int = HOT_ROWS) -> DataFrame:
    """AUC, MRR and every metric at every K in one row."""
    area = auc(df).scalar()
    return mean_metrics(df, ks, hot_rows).select(area.alias("auc"), "*")


def report(metrics: DataFrame) -> DataFrame:
    """One-row metrics as (metric, value) rows."""
    names = metrics.columns
    pairs = [F.struct(F.lit(c).alias("metric"), F.col(f"`{c}`").cast("double").alias("value")) for c in names]
    return metrics.select(F.explode(F.array(*pairs)).alias("_m")).select("_m.*")


def samples_with_positive(df: DataFrame) -> DataFrame:
    """Samples that have at least one positive."""
    return df.groupBy("sample_id").agg(F.max("label").alias("best")).where(F.col("best") > 0).select("sample_id")


def bce_loss(
    df: DataFrame,
    pairs: Sequence[tuple[str, str]],
    smoothing: float = 0.0,
    batch: str | None = None,
) -> DataFrame:
    """Mean binary cross entropy over all (logit, label) cells.

    With ``batch`` the means of the batches are averaged instead.
    """
    cells = []
    for logit, label in pairs:
        target = F.col(label).cast("double")
        cells.append(bce_with_logits(F.col(logit), smooth_label(target, smoothing) if smoothing else target))
    row = sum(cells[1:], cells[0]) / F.lit(float(len(cells)))
    if batch is None:
        return df.agg(F.avg(row).alias("loss"))
    return df.groupBy(batch).agg(F.avg(row).alias("_mean")).agg(F.avg("_mean").alias("loss"))


def evaluation_bundle(
    df: DataFrame,
    actions: Sequence[str] = ("click", "like", "share", "follow"),
    batch: str | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """The evaluation report of scored candidates, one row.

    Input: sample_id, cand_pos, score, ``<action>`` labels, ``<action>_logit``.
    Hit@1 and MRR take the first positive by position and only count samples
    that have one; NDCG counts all samples.
    """
    loss = bce_loss(df, [(f"{a}_logit", a) for a in actions], batch=batch).scalar()
    by_score = auc(df, "click", "score").scalar()
    probability = df.select(
        "click", "like", sigmoid(F.col("click_logit")).alias("p_click"), sigmoid(F.col("like_logit")).alias("p_like")
    )
    by_sigmoid = auc(probability, "click", "p_click").scalar()
    like = auc(probability, "like", "p_like").scalar()

    ranked = _ranked(df.withColumn("label", F.col("click")), hot_rows)
    positive = F.col("label") > 0
    sums = ranked.groupBy("sample_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(positive).alias("n_pos"),
        F.min_by("rank", F.when(positive, F.col("cand_pos"))).alias("first"),
        *[
            F.coalesce(
                F.sum(
                    F.when(
                        F.col("rank") <= k,
                        F.col("label").cast("double") / F.log2((F.col("rank") + 1).cast("double")),
                    )
                ),
                F.lit(0.0),
            ).alias(f"dcg_{k}")
            for k in (10, 20)
        ],
    )
    has = F.col("n_pos") > 0
    ndcg = [
        F.avg(
            F.coalesce(F.try_divide(F.col(f"dcg_{k}"), _ideal(F.col("n_pos"), F.col("n"), k)), F.lit(0.0))
        ).alias(f"ndcg@{k}")
        for k in (10, 20)
    ]
    means = sums.agg(
        F.coalesce(F.avg(F.when(has, (F.col("first") == 1).cast("double"))), F.lit(0.0)).alias("hit@1"),
        F.coalesce(F.avg(F.when(has, F.lit(1.0) / F.col("first"))), F.lit(0.0)).alias("mrr"),
        *ndcg,
    )
    return means.select(
        loss.alias("loss"),
        by_sigmoid.alias("auc"),
        by_score.alias("auc_score"),
        by_sigmoid.alias("auc_sigmoid"),
        like.alias("like_auc"),
        "*",
    )
