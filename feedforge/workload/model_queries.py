"""Models fitted on the given tables; their values have no SQL twin, but their features and shapes have."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedforge.functions.actions import ACTIONS
from feedforge.operators.histories import latest_rows
from feedforge.operators.sampling import pool_negatives
from feedforge.operators.split import part, temporal_split
from feedforge.operators.stats import item_dimension, user_items
from feedforge.plans import datasets, models
from feedforge.session import written
from feedforge.workload.registry import query
from feedforge.workload.views import INTERACTIONS, SPLIT, interactions


# Share of the training rows, by time, that the factors are fitted on; ranking models see only later rows.
EARLY = 0.5


def _log(spark, sf_dir):
    return written(temporal_split(datasets.with_stored_history(interactions(spark, sf_dir))), "model-log")


def _fit(spark, sf_dir):
    """The split log, vectors of its early training rows, feature source and the later training rows."""
    log = _log(spark, sf_dir)
    train = temporal_split(part(log, "train"), EARLY, 1 - EARLY)
    early, late = part(train, "train"), part(train, "val")
    model = models.fit_retrieval(early)
    users, items = model.user_vectors(), model.item_vectors()
    features = models.FeatureSource(log, users, items, item_dimension(part(log, "train")))
    return log, users, items, features, late


def _labelled(log, rows, seed=42):
    """Rows and one negative each, as candidates with labels, their second and the features of their history."""
    pool = datasets.training_items(log)
    samples = rows.select(F.col("row_id").alias("sample_id"), "user_id")
    negatives = pool_negatives(samples, user_items(log), pool, 1, seed)
    flat = datasets.candidate_rows(rows, negatives, seed)
    known = models.with_history_features(rows.select(F.col("row_id").alias("sample_id"), "ts_s", "hist_items"))
    return flat.join(known, "sample_id")


def _vectors(spark, sf_dir):
    model = models.fit_retrieval(part(temporal_split(interactions(spark, sf_dir)), "train"))
    users = model.user_vectors().select(F.lit("user").alias("kind"), F.col("user_id").alias("id"), "vector")
    items = model.item_vectors().select(F.lit("item").alias("kind"), F.col("item_id").alias("id"), "vector")
    return users.unionByName(items)


def _ranked(spark, sf_dir):
    """Candidates of the later training rows and of the validation rows get their features in one pass over the log."""
    log, _, _, features, late = _fit(spark, sf_dir)
    fitting = _labelled(log, late).withColumn("fitting", F.lit(True))
    asked = _labelled(log, part(log, "val")).withColumn("fitting", F.lit(False))
    rows = written(features.attach(written(fitting.unionByName(asked), "candidates")), "ranking-rows")
    scored = models.predict(rows.where("NOT fitting"), models.fit_ranking(rows.where("fitting")))
    return scored.select("sample_id", "cand_pos", "item_id", *ACTIONS, *[f"{a}_prob" for a in ACTIONS])


def _recommended(spark, sf_dir):
    log, users, items, features, late = _fit(spark, sf_dir)
    train = part(log, "train")
    rows = features.attach(written(_labelled(log, late), "candidates"))
    fitted = models.fit_ranking(written(rows, "ranking-rows"))
    now = train.agg(F.max("ts_s")).first()[0] + 1
    return models.two_stage(users, items, features, fitted, latest_rows(train), now, retrieve=50, show=10)


def _probable():
    """Whether all probabilities of a row are probabilities."""
    inside = [F.coalesce(F.col(f"{a}_prob").between(0, 1), F.lit(False)) for a in ACTIONS]
    return inside[0] & inside[1] & inside[2] & inside[3]


@query()
def retrieval_model(spark, sf_dir):
    """User and item factors of the training clicks."""
    return _vectors(spark, sf_dir)


@query(f"""
WITH {SPLIT}, clicks AS (SELECT * FROM split_log WHERE split = 'train' AND click = 1)
SELECT DISTINCT 'user' AS kind, user_id AS id, 16 AS dimensions FROM clicks
UNION ALL SELECT DISTINCT 'item', item_id, 16 FROM clicks""")
def retrieval_model_ids(spark, sf_dir):
    """Who and what has a factor of which length; a factor with a value that is not finite counts as none."""
    finite = F.forall("vector", lambda x: ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return _vectors(spark, sf_dir).where(finite).select("kind", "id", F.size("vector").alias("dimensions"))


@query()
def ranking_model(spark, sf_dir):
    """Action probabilities of the validation candidates."""
    return _ranked(spark, sf_dir)


@query(f"""
WITH {SPLIT} SELECT row_id AS sample_id, item_id, click, "like", share, follow, 1::BIGINT AS others, 2::BIGINT AS probable
FROM split_log WHERE split = 'val'""")
def ranking_model_samples(spark, sf_dir):
    """Per validation sample: its own item and labels, the negatives beside it, and how many candidates have probabilities."""
    scored = _ranked(spark, sf_dir).withColumn("probable", _probable())
    positives = interactions(spark, sf_dir).select(F.col("row_id").alias("sample_id"), F.col("item_id").alias("_item"))
    own = F.col("item_id") == F.col("_item")
    first = [F.max(F.when(own, F.col(c))).alias(c) for c in ("item_id", *ACTIONS)]
    return scored.join(positives, "sample_id").groupBy("sample_id").agg(
        *first, F.count_if(~own).alias("others"), F.count_if("probable").alias("probable")
    )


_BEFORE = "ORDER BY ts_s RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"


@query(f"""
WITH {INTERACTIONS}, n AS (
  SELECT row_id, count(*) OVER (PARTITION BY item_id {_BEFORE})::DOUBLE AS item_count,
         count(*) OVER u AS n, sum(click + 2 * "like") OVER u AS points,
         coalesce(max(ts_s) OVER u - min(ts_s) OVER u, 0) / 86400.0::DOUBLE AS days,
         (coalesce(max(click) OVER u, 0) + coalesce(max("like") OVER u, 0) + coalesce(max(share) OVER u, 0)
          + coalesce(max(follow) OVER u, 0))::DOUBLE AS kinds,
         sum(click + 2 * "like") OVER (PARTITION BY user_id, video_category {_BEFORE}) AS own
  FROM interactions WINDOW u AS (PARTITION BY user_id {_BEFORE})), s AS (
  SELECT *, least(n / 100.0::DOUBLE, 1.0::DOUBLE) * 0.4::DOUBLE + kinds / 4.0::DOUBLE * 0.3::DOUBLE
         + least((CASE WHEN days > 0 THEN n / days ELSE n END) / 10.0::DOUBLE, 1.0::DOUBLE) * 0.3::DOUBLE AS activity FROM n)
SELECT row_id AS sample_id, item_count, round(activity, 6) AS activity_score,
       (CASE WHEN n < 5 THEN 0 WHEN activity < 0.2 THEN 1 WHEN activity < 0.5 THEN 2 WHEN activity < 0.8 THEN 3 ELSE 4 END)::DOUBLE
       AS activity_level,
       round(CASE WHEN points > 0 THEN coalesce(own, 0)::DOUBLE / points::DOUBLE ELSE 0 END, 6) AS category_preference FROM s""")
def ranking_features(spark, sf_dir):
    """Features of every interaction from what was known before its second."""
    log = interactions(spark, sf_dir)
    rows = log.select(F.col("row_id").alias("sample_id"), F.lit(0).alias("cand_pos"), "user_id", "item_id", "ts_s")
    known = models.with_prior_features(rows, log, item_dimension(log))
    rounded = [F.round(c, 6).alias(c) for c in ("activity_score", "category_preference")]
    return known.select("sample_id", "item_count", "activity_level", *rounded)


@query()
def two_stage_recommendations(spark, sf_dir):
    """Vector retrieval, then ranking by predicted engagement."""
    return _recommended(spark, sf_dir)


@query(f"""
WITH {SPLIT}, early AS (
  SELECT * FROM (SELECT *, row_number() OVER (ORDER BY ts_s, row_id) - 1 AS nth, count(*) OVER () AS all_rows FROM split_log
                 WHERE split = 'train') WHERE nth < CAST(floor(all_rows * 0.5::DOUBLE) AS BIGINT) AND click = 1),
items AS (SELECT least(count(DISTINCT item_id), 10) AS listed FROM early)
SELECT DISTINCT user_id, listed AS shown, listed AS ranks, listed AS known_items, listed AS probable FROM early, items""")
def two_stage_lists(spark, sf_dir):
    """Per user: length of the list, distinct ranks within it, distinct items of the training log, rows with probabilities."""
    shown = _recommended(spark, sf_dir).withColumn("probable", _probable())
    trained = part(temporal_split(interactions(spark, sf_dir)), "train").select("item_id").distinct()
    rows = shown.join(trained.withColumn("known", F.lit(True)), "item_id", "left")
    return rows.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("shown"),
        F.count_distinct(F.when(F.col("rank").between(1, 10), F.col("rank"))).alias("ranks"),
        F.count_distinct(F.when(F.col("known"), F.col("item_id"))).alias("known_items"),
        F.count_if("probable").alias("probable"),
    )
