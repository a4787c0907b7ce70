"""Filters, scores, ranking and the candidate pipeline."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from feedforge.functions.vectors import click_plus_dot
from feedforge.operators import filters, ranking, scoring, stats
from feedforge.plans.candidates import CandidatePipeline, Stage, lookup
from feedforge.session import new_scratch_path
from feedforge.workload.registry import query
from feedforge.workload.views import (
    CANDIDATES,
    LISTS,
    blocked_authors,
    candidates,
    seen_items,
    table,
)

# 1996-06-01 and two years.
NOW = 833_587_200
MAX_AGE = 63_072_000
MUTED = ("data", "the system", "Report")


def _flags(df):
    return df.select("request_id", "pos", "item_id", "removed_by")


def _flag_sql(case: str, extra: str = "") -> str:
    return f"WITH {CANDIDATES}{extra} SELECT request_id, pos, item_id, {case} AS removed_by FROM candidates c"


DUPLICATE = "row_number() OVER (PARTITION BY request_id, item_id ORDER BY pos) > 1"
TOO_OLD = f"NOT (ts_s BETWEEN {NOW - MAX_AGE} AND {NOW})"
BLOCKED = "EXISTS (SELECT 1 FROM blocked b WHERE b.user_id = c.user_id AND b.author_id = c.author_id)"
SEEN = "EXISTS (SELECT 1 FROM seen s WHERE s.user_id = c.user_id AND s.item_id = c.item_id)"


@query(f"WITH {CANDIDATES} SELECT * FROM candidates")
def candidate_view(spark, sf_dir):
    return candidates(spark, sf_dir)


@query(_flag_sql(f"CASE WHEN {DUPLICATE} THEN 'dedup' END"))
def dedup_filter(spark, sf_dir):
    return _flags(filters.dedup(candidates(spark, sf_dir)))


@query(f"WITH {CANDIDATES} SELECT request_id, item_id, min(pos) AS pos FROM candidates GROUP BY ALL")
def dedup_kept_rows(spark, sf_dir):
    return filters.dedup_kept(candidates(spark, sf_dir)).select("request_id", "item_id", "pos")


@query(_flag_sql(f"CASE WHEN {TOO_OLD} THEN 'age' END"))
def age_filter(spark, sf_dir):
    return _flags(filters.age(candidates(spark, sf_dir), NOW, MAX_AGE))


@query(_flag_sql(f"CASE WHEN {BLOCKED} THEN 'blocked_author' END", f", {LISTS}"))
def blocked_author_filter(spark, sf_dir):
    return _flags(filters.blocked_author(candidates(spark, sf_dir), blocked_authors(spark, sf_dir)))


@query(_flag_sql("CASE WHEN author_id = user_id THEN 'self_item' END"))
def self_item_filter(spark, sf_dir):
    return _flags(filters.self_item(candidates(spark, sf_dir)))


@query(_flag_sql(f"CASE WHEN {SEEN} THEN 'seen' END", f", {LISTS}"))
def seen_items_filter(spark, sf_dir):
    return _flags(filters.seen(candidates(spark, sf_dir), seen_items(spark, sf_dir)))


@query("""
SELECT source AS request_id, doc_id AS item_id, CASE WHEN contains(lower(text), 'data')
  OR contains(lower(text), 'the system') OR contains(lower(text), 'report') THEN 'muted_keyword' END AS removed_by
FROM documents""")
def muted_keyword_filter(spark, sf_dir):
    """Whole texts of every document against a list of keywords."""
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("request_id"), F.col("doc_id").alias("item_id"), "text")
    return filters.muted_keyword(docs, MUTED).select("request_id", "item_id", "removed_by")


@query("""
WITH words AS (SELECT DISTINCT lang AS user_id, lower(source) AS word FROM documents)
SELECT doc_id AS item_id, CASE WHEN EXISTS (SELECT 1 FROM words w WHERE w.user_id = d.lang AND contains(lower(d.text), w.word))
  THEN 'muted_keyword' END AS removed_by FROM documents d""")
def muted_keyword_by_user_filter(spark, sf_dir):
    """Each language is a user that mutes the names of its sources."""
    docs = table(spark, sf_dir, "documents").select(
        F.col("lang").alias("request_id"),
        F.col("lang").alias("user_id"),
        F.col("doc_id").alias("item_id"),
        F.col("doc_id").alias("pos"),
        "text",
    )
    words = table(spark, sf_dir, "documents").select(F.col("lang").alias("user_id"), F.col("source").alias("keyword"))
    return filters.muted_keyword_by_user(docs, words).select("item_id", "removed_by")


BATCH_CASE = (
    f"CASE WHEN {DUPLICATE} THEN 'dedup' WHEN {TOO_OLD} THEN 'age' WHEN {BLOCKED} THEN 'blocked_author'"
    f" WHEN author_id = user_id THEN 'self_item' WHEN {SEEN} THEN 'seen' END"
)


def _batch(spark, sf_dir):
    return filters.batch_filter(
        candidates(spark, sf_dir), blocked_authors(spark, sf_dir), seen_items(spark, sf_dir), NOW, MAX_AGE
    )


@query(_flag_sql(BATCH_CASE, f", {LISTS}"))
def batch_filter(spark, sf_dir):
    return _flags(_batch(spark, sf_dir))


@query(
    f"WITH {CANDIDATES}, {LISTS} SELECT coalesce(removed_by, 'kept') AS removed_by, count(*) AS n FROM"
    f" (SELECT {BATCH_CASE} AS removed_by FROM candidates c) GROUP BY ALL"
)
def removal_counts(spark, sf_dir):
    return filters.removal_counts(_batch(spark, sf_dir))


CAP = "row_number() OVER (PARTITION BY request_id, category ORDER BY pos) > 3"


@query(_flag_sql(f"CASE WHEN {CAP} THEN 'category_cap' END"))
def category_cap_filter(spark, sf_dir):
    return _flags(filters.category_cap(candidates(spark, sf_dir)))


@query(f"WITH {CANDIDATES} SELECT request_id, category, least(count(*), 3) AS n FROM candidates GROUP BY request_id, category")
def category_kept_counts(spark, sf_dir):
    return filters.category_counts(filters.category_cap(candidates(spark, sf_dir)))


CHAIN = f"""
WITH {CANDIDATES}, {LISTS}, one AS (
  SELECT *, CASE WHEN author_id = user_id THEN 'self_item' WHEN {SEEN} THEN 'seen' END AS r FROM candidates c
), two AS (
  SELECT *, CASE WHEN r IS NOT NULL THEN r WHEN row_number() OVER (PARTITION BY request_id, item_id, r IS NULL ORDER BY pos) > 1
    THEN 'dedup' END AS r2 FROM one
), three AS (
  SELECT *, CASE WHEN r2 IS NOT NULL THEN r2 WHEN row_number() OVER (PARTITION BY request_id, category, r2 IS NULL ORDER BY pos) > 3
    THEN 'category_cap' END AS removed_by FROM two
)"""


@query(f"{CHAIN} SELECT request_id, pos, item_id, removed_by FROM three")
def filter_chain(spark, sf_dir):
    seen = seen_items(spark, sf_dir)
    steps = [filters.self_item, lambda df: filters.seen(df, seen), filters.dedup, filters.category_cap]
    return _flags(filters.chain(candidates(spark, sf_dir), steps))


WEIGHTED = "1.0 * click_prob + 2.0 * like_prob + 4.0 * share_prob + 3.0 * follow_prob"


def _weighted():
    names = [F.lit(n) for n in ("click", "like", "share", "follow")]
    values = [F.col(f"{n}_prob") for n in ("click", "like", "share", "follow")]
    predictions = F.create_map(*[x for pair in zip(names, values) for x in pair])
    return scoring.weighted_score(predictions)


def _scored(spark, sf_dir):
    return candidates(spark, sf_dir).withColumn("score", F.round(_weighted(), 9))


SCORED = f"{CANDIDATES}, s AS (SELECT *, round({WEIGHTED}, 9) AS score FROM candidates)"


@query(f"WITH {SCORED} SELECT request_id, pos, score FROM s")
def weighted_scores(spark, sf_dir):
    return _scored(spark, sf_dir).select("request_id", "pos", "score")


@query(
    f"WITH {CANDIDATES} SELECT request_id, pos,"
    " round(click_prob - 10.0 * (like_prob / 2) - 5.0 * share_prob, 6) AS score FROM candidates"
)
def weighted_scores_of_negative_actions(spark, sf_dir):
    """Blocks and mutes lower a score by the default weights."""
    values = {"click": F.col("click_prob"), "block": F.col("like_prob") / 2, "mute": F.col("share_prob")}
    predictions = F.create_map(*[x for name, value in values.items() for x in (F.lit(name), value)])
    score = F.round(scoring.weighted_score(predictions), 6)
    return candidates(spark, sf_dir).select("request_id", "pos", score.alias("score"))


ENGAGEMENT = "0.4::DOUBLE * click_prob + 0.3::DOUBLE * like_prob + 0.2::DOUBLE * share_prob + 0.1::DOUBLE * follow_prob"


@query(
    f"WITH {CANDIDATES} SELECT request_id, pos, round({ENGAGEMENT}, 9) AS engagement,"
    f" round({ENGAGEMENT.replace('0.1::DOUBLE', '0.5::DOUBLE')}, 9) AS follow_heavy,"
    " round(click_prob * like_prob, 9) AS like_all FROM candidates"
)
def engagement_scores(spark, sf_dir):
    values = [F.col(f"{n}_prob") for n in ("click", "like", "share", "follow")]
    return candidates(spark, sf_dir).select(
        "request_id",
        "pos",
        F.round(scoring.engagement_score(*values), 9).alias("engagement"),
        F.round(scoring.engagement_score(*values, weights={"follow": 0.5}), 9).alias("follow_heavy"),
        F.round(scoring.click_through_like(values[0], values[1]), 9).alias("like_all"),
    )


@query(f"""
WITH {CANDIDATES} SELECT request_id, item_id, pos, row_number() OVER (PARTITION BY request_id ORDER BY
  0.7::DOUBLE * click_prob + 0.3::DOUBLE * like_prob DESC, pos) AS rank FROM candidates""")
def pareto_rerank(spark, sf_dir):
    found = ranking.pareto_rerank(candidates(spark, sf_dir), "click_prob", "like_prob")
    return found.select("request_id", "item_id", "pos", "rank")


@query(f"""
WITH {SCORED} SELECT request_id, pos, round(score * power(0.7::DOUBLE, row_number() OVER (PARTITION BY request_id, author_id ORDER BY pos) - 1), 6) AS score FROM s""")
def author_diversity_scores(spark, sf_dir):
    found = ranking.author_diversity(_scored(spark, sf_dir))
    return found.select("request_id", "pos", F.round("score", 6).alias("score"))


@query(f"""
WITH {SCORED}, d AS (SELECT request_id, pos, item_id,
  score * power(0.7::DOUBLE, row_number() OVER (PARTITION BY request_id, author_id ORDER BY pos) - 1) AS score FROM s)
SELECT request_id, pos, item_id, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, pos) AS rank FROM d""")
def author_diversity_rerank(spark, sf_dir):
    return ranking.author_diversity_rerank(_scored(spark, sf_dir)).select("request_id", "pos", "item_id", "rank")


@query(f"""
WITH {SCORED}, r AS (SELECT request_id, pos, item_id, score,
  row_number() OVER w AS round, first_value(score) OVER w AS head, first_value(pos) OVER w AS head_pos
  FROM s WINDOW w AS (PARTITION BY request_id, category ORDER BY pos))
SELECT request_id, pos, item_id, row_number() OVER (PARTITION BY request_id ORDER BY round, head DESC, head_pos) AS rank FROM r""")
def category_interleave(spark, sf_dir):
    return ranking.category_interleave(_scored(spark, sf_dir)).select("request_id", "pos", "item_id", "rank")


RANKED = f"{SCORED}, ranked AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, pos) AS rank FROM s)"


@query(f"WITH {RANKED} SELECT request_id, item_id, score, CAST(rank AS INTEGER) AS rank FROM ranked WHERE rank <= 10")
def top_k_candidates(spark, sf_dir):
    return ranking.top_k(_scored(spark, sf_dir), 10).select("request_id", "item_id", "score", "rank")


@query(f"WITH {RANKED} SELECT request_id, item_id, pos, rank FROM ranked")
def default_order(spark, sf_dir):
    return ranking.by_score(_scored(spark, sf_dir)).select("request_id", "item_id", "pos", "rank")


@query(f"WITH {RANKED} SELECT request_id, item_id, pos, rank FROM ranked WHERE rank <= 50")
def result_size_cut(spark, sf_dir):
    ordered = ranking.by_score(_scored(spark, sf_dir))
    return ranking.first_ranks(ordered, 50).select("request_id", "item_id", "pos", "rank")


@query(f"""
WITH {RANKED} SELECT request_id AS user_id, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY rank) AS best
FROM ranked WHERE rank <= 3 GROUP BY request_id""")
def best_three_per_user(spark, sf_dir):
    best = ranking.top_k(_scored(spark, sf_dir), 3)
    items = F.sort_array(F.collect_list(F.struct("rank", "item_id")))
    listed = F.array_join(F.transform(items, lambda s: s["item_id"].cast("string")), ",")
    return best.groupBy(F.col("request_id").alias("user_id")).agg(listed.alias("best"))


@query(f"""
WITH {SCORED} SELECT request_id, pos, round(score / 3 * power(0.7::DOUBLE,
  row_number() OVER (PARTITION BY request_id, author_id ORDER BY pos) - 1), 6) AS score FROM s""")
def scorer_chain(spark, sf_dir):
    steps = [lambda df: _weighted(), lambda df: F.round("score", 9) / 3, ranking.author_diversity]
    found = scoring.score_chain(candidates(spark, sf_dir), steps)
    return found.select("request_id", "pos", F.round("score", 6).alias("score"))


@query(f"""
WITH {CANDIDATES} SELECT request_id, pos, round(greatest(-100, least(100, click_prob * 300 - 50 + like_prob)), 9) AS score FROM candidates""")
def click_plus_dot_score(spark, sf_dir):
    score = click_plus_dot(F.col("click_prob") * 300 - 50, F.col("like_prob"))
    return candidates(spark, sf_dir).select("request_id", "pos", F.round(score, 9).alias("score"))


@query(f"""
WITH {CANDIDATES}, c AS (SELECT request_id, category, count(*) AS c FROM candidates GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY c, category) AS i,
  sum(c) OVER (PARTITION BY request_id) AS n, count(*) OVER (PARTITION BY request_id) AS k FROM c)
SELECT request_id, count(*) AS num_categories, round(sum(-(c / n::DOUBLE) * ln(c / n::DOUBLE)), 6) + 0.0 AS entropy,
  round(sum((2 * i - k - 1) * c) / (max(k) * max(k) * (max(n) / max(k)::DOUBLE)), 6) AS gini FROM r GROUP BY request_id""")
def category_diversity(spark, sf_dir):
    found = stats.category_diversity(candidates(spark, sf_dir))
    return found.select(
        "request_id",
        "num_categories",
        (F.round("entropy", 6) + F.lit(0.0)).alias("entropy"),
        F.round("gini", 6).alias("gini"),
    )


PIPELINE = f"""
WITH {CANDIDATES}, {LISTS},
requests AS (SELECT c_custkey AS request_id, c_custkey AS user_id, c_mktsegment = 'BUILDING' AS diversify,
  c_acctbal > 0 AS cap FROM customer),
fetched AS (
  SELECT request_id, user_id, item_id, author_id, category, ts_s, click_prob, like_prob, share_prob, follow_prob, 'lines' AS source, pos
  FROM candidates
  UNION ALL
  SELECT request_id, user_id, item_id, author_id, category, ts_s, click_prob, like_prob, share_prob, follow_prob, 'discounted' AS source,
    1099511627776 + pos FROM candidates WHERE click_prob > 0.5
), hydrated AS (
  SELECT f.*, p_retailprice AS price, r.diversify, r.cap FROM fetched f JOIN requests r USING (request_id)
  LEFT JOIN part ON p_partkey + 1 = f.item_id
), one AS (
  SELECT *, row_number() OVER (PARTITION BY request_id, item_id ORDER BY pos) > 1 AS dup FROM hydrated
), two AS (
  SELECT *, CASE WHEN dup THEN 'dedup' WHEN EXISTS (SELECT 1 FROM seen s WHERE s.user_id = one.user_id AND s.item_id = one.item_id)
    THEN 'seen' END AS r FROM one
), three AS (
  SELECT *, CASE WHEN r IS NOT NULL THEN r WHEN cap AND row_number() OVER (PARTITION BY request_id, category, r IS NULL ORDER BY pos) > 3
    THEN 'category_cap' END AS removed_by FROM two
), scored AS (
  SELECT *, {WEIGHTED} AS base, row_number() OVER (PARTITION BY request_id, author_id ORDER BY pos) - 1 AS nth FROM three WHERE removed_by IS NULL
), decayed AS (
  SELECT *, round(CASE WHEN diversify THEN base * power(0.7::DOUBLE, nth) ELSE base END, 6) AS score FROM scored
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, pos) AS rank FROM decayed
)"""


def _pipeline(spark, sf_dir, side_effects=()):
    pool = candidates(spark, sf_dir)
    requests = _requests(spark, sf_dir)
    seen = seen_items(spark, sf_dir)
    parts = table(spark, sf_dir, "part").select((F.col("p_partkey") + 1).alias("item_id"), F.col("p_retailprice").alias("price"))

    def from_pool(condition, asked):
        return pool.where(condition).join(asked.select("request_id"), "request_id", "left_semi")

    def not_seen(df, bounded):
        return filters.seen_by_request(df, requests, seen) if bounded else filters.seen(df, seen)

    return CandidatePipeline(
        sources=[
            Stage("lines", partial(from_pool, F.lit(True))),
            Stage("discounted", partial(from_pool, F.col("click_prob") > 0.5)),
        ],
        hydrators=[Stage("price", lookup(parts, "item_id", ["price"]))],
        filters=[
            Stage("dedup", filters.dedup, per_request=True),
            Stage("seen", not_seen, per_request=True),
            Stage("category_cap", filters.category_cap, enable="cap", per_request=True),
        ],
        scorers=[
            Stage("weighted", lambda df: _weighted()),
            Stage("diversity", ranking.author_diversity, enable="diversify", per_request=True),
            Stage("rounded", lambda df: F.round("score", 6)),
        ],
        side_effects=side_effects,
        result_size=20,
    )


def _requests(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("request_id"),
        F.col("c_custkey").alias("user_id"),
        (F.col("c_mktsegment") == "BUILDING").alias("diversify"),
        (F.col("c_acctbal") > 0).alias("cap"),
    )


@query(f"{PIPELINE} SELECT request_id, item_id, source, price, score, CAST(rank AS INTEGER) AS rank FROM ranked WHERE rank <= 20")
def recommendation_run(spark, sf_dir):
    result = _pipeline(spark, sf_dir).execute(_requests(spark, sf_dir))
    return result.selected.select("request_id", "item_id", "source", "price", "score", "rank")


@query(f"{PIPELINE} SELECT removed_by, source, count(*) AS n FROM three WHERE removed_by IS NOT NULL GROUP BY ALL")
def recommendation_removed(spark, sf_dir):
    result = _pipeline(spark, sf_dir).execute(_requests(spark, sf_dir))
    return result.removed.groupBy("removed_by", "source").agg(F.count(F.lit(1)).alias("n"))


@query(f"{PIPELINE} SELECT source, count(*) AS n FROM fetched GROUP BY ALL")
def recommendation_sources(spark, sf_dir):
    result = _pipeline(spark, sf_dir).execute(_requests(spark, sf_dir))
    return result.retrieved.groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query(f"{PIPELINE} SELECT count(*) AS n, CAST(sum(item_id) AS BIGINT) AS items FROM ranked WHERE rank <= 20")
def recommendation_side_effect(spark, sf_dir):
    """Selected rows written by a side effect and read back; a failing one changes nothing."""
    path = new_scratch_path(spark, "selected")

    def fail(requests, selected):
        raise RuntimeError("unreachable log")

    effects = [Stage("fails", fail), Stage("log", lambda requests, selected: selected.write.parquet(path))]
    _pipeline(spark, sf_dir, effects).execute(_requests(spark, sf_dir))
    return spark.read.parquet(path).agg(F.count(F.lit(1)).alias("n"), F.sum("item_id").alias("items"))


