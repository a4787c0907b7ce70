"""Windows over a metric log (name, step, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedforge.operators.segments import HOT_ROWS, asc, row_number, running, top_n

# Metrics where more is better; loss is better when less.
LARGER_IS_BETTER = ("auc", "ndcg", "hit_rate", "mrr")
SMALLER_IS_BETTER = ("loss",)


def _kind(column: str = "name"):
    return F.substring_index(F.col(column), "/", -1)


def better_of(high: Column, low: Column) -> Column:
    """The better of a metric's extremes; null for metrics without a better direction."""
    return F.when(_kind().isin(*LARGER_IS_BETTER), high).when(_kind().isin(*SMALLER_IS_BETTER), low)


def metric_history(log: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Steps of every metric in order, numbered by ``seq``."""
    return row_number(log, ["name"], [asc("step")], "seq", hot_rows)


def running_best(log: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Best value so far; null for metrics without a better direction."""
    outputs = {"_high": ("max", F.col("value")), "_low": ("min", F.col("value"))}
    ran = running(log, ["name"], [asc("step")], outputs, hot_rows)
    return ran.withColumn("best", better_of(F.col("_high"), F.col("_low"))).drop("_high", "_low")


def best_values(log: DataFrame) -> DataFrame:
    """Best value of every metric that has a better direction."""
    rated = log.where(_kind().isin(*LARGER_IS_BETTER, *SMALLER_IS_BETTER))
    value = F.when(F.first(_kind()).isin(*SMALLER_IS_BETTER), F.min("value")).otherwise(F.max("value"))
    return rated.groupBy("name").agg(value.alias("best"))


def patience_stop(log: DataFrame, patience: int, hot_rows: int = HOT_ROWS) -> DataFrame:
    """First step of every metric after ``patience`` evaluations without a new best.

    Larger values are better. Metrics that never stop are absent.
    """
    best = running(log, ["name"], [asc("step")], {"seq": ("count", None), "_high": ("max", F.col("value"))}, hot_rows)
    # The running best first reached its value at the row that set it.
    reached = best.groupBy("name", "_high").agg(F.min("seq").alias("_since"))
    waiting = best.join(reached, ["name", "_high"]).where(F.col("seq") - F.col("_since") >= patience)
    return top_n(waiting, ["name"], [asc("step")], 1, "_n").select("name", "step")
