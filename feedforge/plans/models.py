"""Retrieval and ranking models on MLlib, and two-stage inference."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.recommendation import ALS, ALSModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedforge.functions.actions import ACTIONS
from feedforge.functions.history import id_span, uniqueness, valid_length
from feedforge.functions.vectors import dot
from feedforge.operators.index import shuffled_index
from feedforge.operators.profiles import DAY, activity_level, activity_score
from feedforge.operators.ranking import top_k
from feedforge.operators.retrieval import top_k_items
from feedforge.operators.scoring import engagement_score
from feedforge.operators.segments import HOT_ROWS, asc, is_bounded, running
from feedforge.operators.stats import with_category
from feedforge.session import written

HISTORY_FEATURES = ("history_length", "history_uniqueness", "history_span")
FEATURES = ("item_count", "activity_score", "activity_level", "category_preference", *HISTORY_FEATURES, "tower_score")


@dataclass
class RetrievalModel:
    """Factors by dense numbers, and the dictionaries that lead from ids to them."""

    als: ALSModel
    users: DataFrame
    items: DataFrame

    def user_vectors(self) -> DataFrame:
        """User factors as (user_id, vector)."""
        return self.users.join(self.als.userFactors, "id").select("user_id", F.col("features").alias("vector"))

    def item_vectors(self) -> DataFrame:
        """Item factors as (item_id, vector)."""
        return self.items.join(self.als.itemFactors, "id").select("item_id", F.col("features").alias("vector"))


def dense_ids(df: DataFrame, column: str) -> DataFrame:
    """Distinct values of ``column`` with an ``id`` from 0 on, written once so that every reader sees the same numbers.

    Numbers follow a hash order, without a global sort. MLlib takes 32-bit ids: more than 2^31 distinct values are an error.
    """
    numbered = shuffled_index(df.select(column).where(F.col(column).isNotNull()).distinct(), column, name="id")
    return written(numbered.select(column, F.col("id").cast("int").alias("id")), "dense-ids")


def fit_retrieval(log: DataFrame, rank: int = 16, iterations: int = 5, seed: int = 42, alpha: float = 10.0) -> RetrievalModel:
    """Factor model of the clicks of a training log.

    Clicks are summed per (user, item) first. Ids may be any 64-bit number; the model sees their dense numbers.
    """
    clicks = log.where(F.col("click") == 1).groupBy("user_id", "item_id").agg(F.count(F.lit(1)).cast("float").alias("n"))
    clicks = written(clicks, "clicks")
    users, items = dense_ids(clicks, "user_id"), dense_ids(clicks, "item_id")
    rows = clicks.join(users.withColumnRenamed("id", "user"), "user_id").join(items.withColumnRenamed("id", "item"), "item_id")
    als = ALS(
        userCol="user",
        itemCol="item",
        ratingCol="n",
        implicitPrefs=True,
        rank=rank,
        maxIter=iterations,
        alpha=alpha,
        seed=seed,
        checkpointInterval=-1,
    )
    return RetrievalModel(als.fit(rows.select("user", "item", "n")), users, items)


def _with_events(rows: DataFrame, log: DataFrame, keys: Sequence[str], values: Mapping[str, tuple[str, Column]]) -> DataFrame:
    """Asking rows and log rows as one table; log rows carry ``values``, and ``_event`` tells the two apart."""
    carried = [value.alias(f"_of_{name}") for name, (_, value) in values.items()]
    events = log.select(*keys, "ts_s", *carried, F.lit(1).alias("_event"), F.col("row_id").alias("_a"), F.lit(0).alias("_b"))
    asking = rows.withColumns({"_event": F.lit(0), "_a": F.col("sample_id"), "_b": F.col("cand_pos")})
    return asking.unionByName(events, allowMissingColumns=True)


def _so_far(both: DataFrame, keys: Sequence[str], values: Mapping[str, tuple[str, Column]], hot_rows: int, bounded: bool) -> DataFrame:
    """Add aggregates over the log rows of the same ``keys`` strictly before each row's ``ts_s``.

    Log rows and asking rows stand in one running window, asking ones first within a second. The window cuts hot keys.
    """
    order = [asc("ts_s"), asc("_event"), asc("_a"), asc("_b")]
    outputs = {name: (kind, F.col(f"_of_{name}")) for name, (kind, _) in values.items()}
    return running(both, keys, order, outputs, hot_rows, bounded)


def _asking(both: DataFrame, values: Mapping[str, tuple[str, Column]]) -> DataFrame:
    return both.where("_event = 0").drop(*[f"_of_{name}" for name in values], "_event", "_a", "_b")


def _bounded(rows: DataFrame, log: DataFrame, key: str, hot_rows: int) -> bool:
    """Whether no value of ``key`` has too many log and asking rows together for one task."""
    return is_bounded(rows.select(key).unionByName(log.select(key)), [key], hot_rows)


def _points() -> Column:
    return (F.col("click") + F.lit(2) * F.col("like")).cast("bigint")


def _user_values() -> dict[str, tuple[str, Column]]:
    return {
        "_n": ("sum", F.lit(1).cast("bigint")),
        "_points": ("sum", _points()),
        "_first": ("min", F.col("ts_s")),
        "_last": ("max", F.col("ts_s")),
        **{f"_n_{a}": ("sum", F.col(a).cast("bigint")) for a in ACTIONS},
    }


def with_prior_features(rows: DataFrame, log: DataFrame, dimension: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Add item_count, activity_score, activity_level and category_preference as known just before each row.

    ``rows`` have sample_id, cand_pos, user_id, item_id and ts_s, unique in the first two. Only log rows of an earlier
    second count, so no row's own labels reach its features, nor those of any row of the same second. ``dimension`` gives
    the category of an item, a property that does not depend on labels; an unknown item has category 0. The windows of a
    user and of a user's categories share one shuffle, unless a user has more than ``hot_rows`` rows.
    """
    item = {"item_count": ("sum", F.lit(1).cast("bigint"))}
    both = _with_events(with_category(rows, dimension), log, ["item_id"], item)
    placed = _asking(_so_far(both, ["item_id"], item, hot_rows, _bounded(rows, log, "item_id", hot_rows)), item)

    user, own = _user_values(), {"_own": ("sum", _points())}
    keys = ["user_id", "category"]
    bounded = _bounded(rows, log, "user_id", hot_rows)
    if not bounded:
        placed = written(placed, "item-features")
    by_category = with_category(log.select("row_id", "user_id", "item_id", "ts_s", *ACTIONS), dimension)
    known = _so_far(_with_events(placed, by_category, keys, {**user, **own}), ["user_id"], user, hot_rows, bounded)
    if not bounded:
        known = written(known, "user-features")
    return _finished(_asking(_so_far(known, keys, own, hot_rows, bounded), {**user, **own}))


def with_features_at(rows: DataFrame, log: DataFrame, dimension: DataFrame, now: int) -> DataFrame:
    """:func:`with_prior_features` of rows that all ask in second ``now``.

    What is known then is one total per item, user and category of a user, so the log is aggregated and joined, and no
    window holds it beside the rows.
    """
    earlier = log.where(F.coalesce(F.col("ts_s") < F.lit(now), F.lit(True)))
    by_category = with_category(earlier.select("user_id", "item_id", *ACTIONS), dimension)
    placed = with_category(rows, dimension)
    totals = (
        (["item_id"], earlier, {"item_count": ("sum", F.lit(1).cast("bigint"))}),
        (["user_id", "category"], by_category, {"_own": ("sum", _points())}),
        (["user_id"], earlier, _user_values()),
    )
    kinds = {"sum": F.sum, "min": F.min, "max": F.max}
    for keys, source, values in totals:
        total = source.groupBy(*[F.col(k).alias(f"_by_{k}") for k in keys]).agg(*[kinds[kind](v).alias(n) for n, (kind, v) in values.items()])
        same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_by_{k}")) for k in keys])
        placed = placed.join(total, same, "left").drop(*[f"_by_{k}" for k in keys])
    return _finished(placed)


def _finished(placed: DataFrame) -> DataFrame:
    """The features from what is known of item, user and category."""
    count = F.coalesce("_n", F.lit(0))
    kinds = sum(F.coalesce((F.col(f"_n_{a}") > 0).cast("int"), F.lit(0)) for a in ACTIONS)
    days = F.coalesce((F.col("_last") - F.col("_first")).cast("double") / F.lit(DAY), F.lit(0.0))
    share = F.when(F.col("_points") > 0, F.coalesce("_own", F.lit(0)).cast("double") / F.col("_points").cast("double"))
    scored = placed.withColumn("activity_score", activity_score(count, kinds, days))
    return scored.withColumns(
        {
            "item_count": F.coalesce("item_count", F.lit(0)).cast("double"),
            "activity_level": activity_level(count, F.col("activity_score")).cast("double"),
            "category_preference": F.coalesce(share, F.lit(0.0)),
        }
    ).drop(*_user_values(), "_own")


def with_history_features(rows: DataFrame) -> DataFrame:
    """``hist_items`` replaced by its features, so that no array travels with every candidate."""
    history = F.coalesce("hist_items", F.array().cast("array<bigint>"))
    features = (valid_length(history).cast("double"), uniqueness(history), id_span(history).cast("double"))
    return rows.withColumns(dict(zip(HISTORY_FEATURES, features))).drop("hist_items")


@dataclass
class FeatureSource:
    """What ranking features are made from: a log with labels, vectors and item categories.

    Vectors must come from a log that ends before the rows that a ranking model is fitted on, else their labels reach the
    tower score through the factors.
    """

    log: DataFrame
    users: DataFrame
    items: DataFrame
    dimension: DataFrame

    def attach(self, rows: DataFrame, hot_rows: int = HOT_ROWS, now: int | None = None) -> DataFrame:
        """Add the features to rows with sample_id, cand_pos, user_id, item_id, ts_s and the features of histories.

        Rows that all have one ``ts_s`` should name it in ``now``.
        """
        if now is None:
            known = with_prior_features(rows, self.log, self.dimension, hot_rows)
        else:
            known = with_features_at(rows, self.log, self.dimension, now)
        joined = known.join(self.users.withColumnRenamed("vector", "_user_vector"), "user_id", "left")
        joined = joined.join(self.items.withColumnRenamed("vector", "_item_vector"), "item_id", "left")
        score = F.coalesce(dot(F.col("_user_vector"), F.col("_item_vector")), F.lit(0.0))
        return joined.withColumn("tower_score", score).drop("_user_vector", "_item_vector")


def fit_ranking(
    rows: DataFrame, actions: Sequence[str] = ACTIONS, iterations: int = 20
) -> dict[str, LogisticRegressionModel]:
    """One logistic model per action over rows with the features and 0/1 labels."""
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows)
    models = {}
    for action in actions:
        learner = LogisticRegression(
            featuresCol="features", labelCol="_label", probabilityCol="_p", maxIter=iterations, regParam=0.01
        )
        models[action] = learner.fit(vectors.withColumn("_label", F.col(action).cast("double")))
    return models


def predict(rows: DataFrame, models: Mapping[str, LogisticRegressionModel]) -> DataFrame:
    """Add ``<action>_prob`` for every model."""
    scored = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows)
    for action, model in models.items():
        plain = model.copy({model.rawPredictionCol: "", model.predictionCol: ""})
        scored = plain.transform(scored).withColumn(f"{action}_prob", vector_to_array("_p")[1]).drop("_p")
    return scored.drop("features")


def two_stage(
    users: DataFrame,
    items: DataFrame,
    features: FeatureSource,
    models: Mapping[str, LogisticRegressionModel],
    histories: DataFrame,
    now: int,
    retrieve: int = 100,
    show: int = 10,
) -> DataFrame:
    """Top candidates by vectors, ranked by predicted engagement with what was known before second ``now``."""
    found = top_k_items(users, items, retrieve).select(
        F.col("user_id").alias("sample_id"), "user_id", "item_id", F.col("rank").alias("cand_pos"), F.lit(now).cast("bigint").alias("ts_s")
    )
    own = users.select("user_id").join(histories.select("user_id", "hist_items"), "user_id", "left")
    rows = found.join(with_history_features(own), "user_id")
    scored = predict(features.attach(written(rows, "two-stage"), now=now), models)
    score = engagement_score(*[F.col(f"{a}_prob") for a in ACTIONS])
    placed = scored.withColumns({"score": score, "request_id": F.col("sample_id"), "pos": F.col("cand_pos")})
    return top_k(placed, show).select("user_id", "item_id", "rank", "score", *[f"{a}_prob" for a in ACTIONS])
