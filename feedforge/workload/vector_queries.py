"""Vector arithmetic, pooling and retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedforge.functions import vectors as V
from feedforge.operators.histories import latest_rows
from feedforge.operators.retrieval import pooled_vectors, top_k_items
from feedforge.plans.datasets import with_stored_history
from feedforge.workload.registry import query
from feedforge.workload.views import PRIOR, interactions, vectors

DOUBLES = "list_transform(embedding, lambda x: x::DOUBLE)"


@query(f"""
SELECT item_id, CAST(unnest(range(len(v))) AS INTEGER) AS dim, round(unnest(list_transform(v, lambda x: x / (sqrt(s) + 1e-12::DOUBLE))), 6) + 0.0 AS value
FROM (SELECT vec_id AS item_id, {DOUBLES} AS v, list_sum(list_transform({DOUBLES}, lambda x: x * x)) AS s FROM embeddings)""")
def normalized_vectors(spark, sf_dir):
    rows = vectors(spark, sf_dir).select("item_id", F.posexplode(V.l2_normalize(F.col("vector"))).alias("dim", "value"))
    return rows.withColumn("value", F.round("value", 6) + F.lit(0.0))


COSINE = "list_dot_product(a.v, b.v) / ((sqrt(list_dot_product(a.v, a.v)) + 1e-12) * (sqrt(list_dot_product(b.v, b.v)) + 1e-12))"


@query(f"""
WITH e AS (SELECT vec_id, label, {DOUBLES} AS v FROM embeddings), heads AS (
  SELECT label, v FROM e QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id) = 1)
SELECT a.vec_id AS item_id, round(greatest(-100, least(100, {COSINE})) / 0.07::DOUBLE, 6) + 0.0 AS score
FROM e a JOIN heads b USING (label)""")
def two_tower_scores(spark, sf_dir):
    """Every vector against the first vector of its label."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    heads = rows.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("head"))
    score = V.two_tower_score(F.col("embedding"), F.col("head"), 0.07)
    joined = rows.join(heads, "label")
    return joined.select(F.col("vec_id").alias("item_id"), (F.round(score, 6) + F.lit(0.0)).alias("score"))


def _pooled_sql(weight: str, total: str) -> str:
    return f"""
WITH {PRIOR}, steps AS (
  SELECT row_id, unnest(range(len(hist_items))) AS place, unnest(hist_items) AS item_id FROM prior WHERE hist_items IS NOT NULL
), found AS (
  SELECT row_id, place, {weight} AS w, {DOUBLES} AS v FROM steps JOIN embeddings ON vec_id = item_id
), totals AS (SELECT row_id, {total} AS total FROM found GROUP BY row_id),
dims AS (SELECT row_id, w, unnest(range(64)) AS dim, unnest(v) AS x FROM found)
SELECT row_id, CAST(dim AS INTEGER) AS dim, round(sum(w * x) / any_value(total), 6) + 0.0 AS value
FROM dims JOIN totals USING (row_id) GROUP BY row_id, dim"""


def _pooled(spark, sf_dir, decay):
    log = with_stored_history(interactions(spark, sf_dir)).select("row_id", "hist_items")
    pooled = pooled_vectors(log, vectors(spark, sf_dir), "row_id", decay=decay)
    rows = pooled.select("row_id", F.posexplode("vector").alias("dim", "value"))
    return rows.withColumn("value", F.round("value", 6) + F.lit(0.0))


@query(_pooled_sql("1.0::DOUBLE", "greatest(sum(w), 1.0)"))
def mean_pooled_histories(spark, sf_dir):
    return _pooled(spark, sf_dir, None)


@query(_pooled_sql("power(0.9::DOUBLE, place)", "sum(w)"))
def decayed_pooled_histories(spark, sf_dir):
    return _pooled(spark, sf_dir, 0.9)


@query(f"""
WITH e AS (SELECT vec_id, {DOUBLES} AS v FROM embeddings), s AS (
  SELECT a.vec_id AS user_id, b.vec_id AS item_id, round(list_dot_product(a.v, b.v), 9) AS score FROM e a CROSS JOIN e b
) SELECT user_id, item_id, score + 0.0 AS score, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank FROM s) WHERE rank <= 20""")
def corpus_top_k(spark, sf_dir):
    """Best 20 vectors for every vector, over all of them."""
    items = vectors(spark, sf_dir)
    users = items.withColumnRenamed("item_id", "user_id")
    return top_k_items(users, items, 20).withColumn("score", F.col("score") + F.lit(0.0))


@query(f"""
WITH {PRIOR}, e AS (SELECT vec_id, {DOUBLES} AS v FROM embeddings), last AS (
  SELECT i.user_id, hist_items FROM interactions i JOIN prior USING (row_id)
  QUALIFY row_number() OVER (PARTITION BY i.user_id ORDER BY i.ts_s DESC, i.row_id DESC) = 1
), steps AS (SELECT user_id, unnest(range(len(hist_items))) AS place, unnest(hist_items) AS item_id FROM last),
found AS (SELECT user_id, power(0.9::DOUBLE, place) AS w, v FROM steps JOIN e ON vec_id = item_id),
dims AS (SELECT user_id, w, unnest(range(64)) AS dim, unnest(v) AS x FROM found),
means AS (SELECT user_id, dim, sum(w * x) / sum(w) AS x FROM dims GROUP BY user_id, dim),
users AS (SELECT user_id, list(x ORDER BY dim) AS v FROM means GROUP BY user_id),
s AS (SELECT user_id, vec_id AS item_id, round(list_dot_product(users.v, e.v), 9) AS score FROM users CROSS JOIN e)
SELECT user_id, item_id, score + 0.0 AS score FROM s
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) <= 10""")
def vector_candidates(spark, sf_dir):
    """Candidates for each user from the decayed mean of its latest history."""
    log = with_stored_history(interactions(spark, sf_dir))
    users = pooled_vectors(latest_rows(log), vectors(spark, sf_dir), "user_id", decay=0.9)
    found = top_k_items(users, vectors(spark, sf_dir), 10)
    return found.select("user_id", "item_id", (F.col("score") + F.lit(0.0)).alias("score"))
