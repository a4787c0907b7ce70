"""Loading, splitting and statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedforge.functions.coerce import finalize_int, safe_float, safe_int
from feedforge.operators import split, stats
from feedforge.operators.segments import asc, desc, row_number, top_n
from feedforge.plans.datasets import training_items
from feedforge.session import new_scratch_path, written
from feedforge.sources import logs, tables
from feedforge.workload.registry import joined_text, query
from feedforge.workload.views import INTERACTIONS, SPLIT, interactions, table

LOG_COLUMNS = "row_id, user_id, item_id, ts_s, click, \"like\", share, follow"


@query(f"WITH {INTERACTIONS} SELECT * FROM interactions")
def interaction_log(spark, sf_dir):
    return interactions(spark, sf_dir)


POPULAR_UNSEEN = f"""
WITH {SPLIT}, popular AS (
  SELECT item_id, count(*) AS n FROM split_log WHERE split = 'train' GROUP BY item_id
), popular_rank AS (
  SELECT item_id, n, row_number() OVER (ORDER BY n DESC, item_id) AS place FROM popular
), users AS (SELECT DISTINCT user_id FROM interactions),
seen AS (SELECT DISTINCT user_id, item_id FROM split_log WHERE split = 'train')
SELECT user_id, item_id, score, CAST(rank AS INTEGER) AS rank FROM (
  SELECT u.user_id, p.item_id, CAST(p.n AS DOUBLE) AS score,
         row_number() OVER (PARTITION BY u.user_id ORDER BY p.place) AS rank
  FROM users u CROSS JOIN popular_rank p
  WHERE NOT EXISTS (SELECT 1 FROM seen s WHERE s.user_id = u.user_id AND s.item_id = p.item_id)
) WHERE rank <= 10"""


def popular_unseen(train, users, k=10, first=100):
    """The ``k`` most popular items of ``train`` that each user has not met, whatever the user has met.

    The ``first`` most popular items serve all users; they travel as one array. Only users who met so many of these that
    fewer than ``k`` remain look further: their best lie among as many places as they met items, and ``k`` more.
    """
    seen = train.select("user_id", "item_id").distinct()
    best = stats.popular_items(train, first)
    listed = best.agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("order"), "item_id", "n"))).alias("items"))
    met = seen.join(best.select("item_id"), "item_id", "left_semi").groupBy("user_id")
    met = users.join(met.agg(F.collect_set("item_id").alias("met")), "user_id", "left").withColumn("items", listed.scalar())
    left = F.filter("items", lambda i: F.col("met").isNull() | ~F.array_contains("met", i["item_id"]))
    served = written(met.select("user_id", left.alias("left")), "served")
    enough = F.size("left") >= k
    near = served.filter(enough).select("user_id", F.posexplode(F.slice("left", 1, k)).alias("at", "i")).select(
        "user_id", "i.item_id", F.col("i.n").cast("double").alias("score"), (F.col("at") + 1).alias("rank")
    )
    short = served.filter(~enough).select("user_id")
    if short.isEmpty():
        return near
    depth = short.join(seen, "user_id", "left").groupBy("user_id").agg((F.count("item_id") + k).alias("depth"))
    placed = row_number(stats.item_popularity(train), [], [desc("n"), asc("item_id")], "place")
    offered = depth.select("user_id", F.explode(F.sequence(F.lit(1), F.col("depth").cast("int"))).alias("place"))
    unmet = offered.join(placed, "place").join(seen, ["user_id", "item_id"], "left_anti")
    far = top_n(
        unmet.select("user_id", "item_id", F.col("n").cast("double").alias("score"), "place"), ["user_id"], [asc("place")], k
    )
    return near.unionByName(far.select("user_id", "item_id", "score", "rank"))


@query(POPULAR_UNSEEN)
def popular_unseen_items(spark, sf_dir):
    """Most popular training items each user has not met, best ten per user."""
    log = split.temporal_split(interactions(spark, sf_dir))
    train = split.part(log, "train")
    return popular_unseen(train, log.select("user_id").distinct())


def _messy_csv(spark, sf_dir):
    """The log as CSV files with short names, missing fields and bad numbers."""
    path = new_scratch_path(spark, "log-csv")
    log = interactions(spark, sf_dir)
    every = lambda n, at: F.pmod("row_id", F.lit(n)) == at
    text = lambda c: F.col(c).cast("string")
    rows = log.select(
        F.when(every(17, 3), "guest").otherwise(text("user_id")).alias("uid"),
        text("item_id").alias("iid"),
        text("ts_s").alias("timestamp"),
        F.when(every(5, 1), "\\N").otherwise(text("click")).alias("click"),
        F.when(every(7, 2), "").otherwise(text("like")).alias("like"),
        F.when(every(11, 4), "n/a").otherwise(text("share")).alias("share"),
        F.concat(text("video_category"), F.lit(".0")).alias("video_category"),
        F.lit("unused").alias("comment"),
    )
    rows.write.option("header", True).option("emptyValue", "").csv(path)
    return path


MESSY = f"""
WITH {INTERACTIONS} SELECT user_id, item_id, ts_s,
  CASE WHEN row_id % 5 = 1 THEN 0 ELSE click END AS click,
  CASE WHEN row_id % 7 = 2 THEN 0 ELSE "like" END AS "like",
  CASE WHEN row_id % 11 = 4 THEN 0 ELSE share END AS share,
  0 AS follow, 0.0::DOUBLE AS reading_duration, video_category, 0 AS gender
FROM interactions WHERE row_id % 17 <> 3"""
MESSY_COLUMNS = (
    "user_id", "item_id", "ts_s", "click", "like", "share", "follow", "reading_duration", "video_category", "gender",
)


@query(MESSY)
def csv_log_scan(spark, sf_dir):
    return logs.read_interactions(spark, _messy_csv(spark, sf_dir), "csv").select(*MESSY_COLUMNS)


@query(f"""
WITH {INTERACTIONS} SELECT user_id, item_id, ts_s,
  CASE WHEN row_id % 3 > 0 THEN reading_duration WHEN row_id % 2 = 0 THEN CAST(row_id % 50 AS DOUBLE) ELSE 0.0::DOUBLE END AS reading_duration,
  array_to_string([CASE WHEN (row_id + i) % 4 = 0 THEN 0 ELSE item_id + i END FOR i IN range(1, 11)], ',') AS history
FROM interactions""")
def recorded_history_scan(spark, sf_dir):
    """A log with ten history columns and gaps in them; a missing duration is taken from the watching times, else 0."""
    path = new_scratch_path(spark, "log-csv")
    log = interactions(spark, sf_dir)
    kept = {f"hist_{i}": F.when((F.col("row_id") + i) % 4 != 0, F.col("item_id") + i) for i in range(1, 11)}
    rows = log.select(
        F.col("user_id").alias("uid"), F.col("item_id").alias("iid"), F.col("ts_s").alias("timestamp"),
        F.when(F.col("row_id") % 3 > 0, F.col("reading_duration")).alias("reading_duration"),
        F.when(F.col("row_id") % 2 == 0, F.col("row_id") % 50).alias("watching_times"),
        *[value.alias(name) for name, value in kept.items()],
    )
    rows.write.option("header", True).csv(path)
    found = logs.read_interactions(spark, path, "csv")
    return found.select("user_id", "item_id", "ts_s", "reading_duration", joined_text(F.col("hist_items")).alias("history"))


@query(
    f"WITH {INTERACTIONS} SELECT count(*) AS n, CAST(sum(CASE WHEN row_id % 17 = 3 THEN 0 ELSE user_id END) AS BIGINT) AS users,"
    " CAST(sum(item_id) AS BIGINT) AS items, CAST(sum(CASE WHEN row_id % 5 = 1 THEN 0 ELSE click END) AS BIGINT) AS clicks"
    " FROM interactions"
)
def csv_to_parquet(spark, sf_dir):
    target = new_scratch_path(spark, "log-parquet")
    logs.csv_to_parquet(spark, _messy_csv(spark, sf_dir), target, "zstd")
    return spark.read.parquet(target).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("uid").alias("users"),
        F.sum("iid").alias("items"),
        F.sum("click").alias("clicks"),
    )


@query("SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS row_id FROM events")
def file_row_numbers(spark, sf_dir):
    """Row order numbers, the time of logs without timestamps."""
    return logs.number_rows(table(spark, sf_dir, "events")).select("event_id", "row_id")


@query(
    "SELECT row_number() OVER (ORDER BY event_id) - 1 AS row_id, row_number() OVER (ORDER BY event_id) - 1 AS ts_s,"
    " user_id, 0::BIGINT AS item_id, 0 AS click, 0.0::DOUBLE AS reading_duration, 0 AS age FROM events"
)
def scenario_load(spark, sf_dir):
    """A Parquet source found by name; what it lacks is filled with defaults."""
    log = logs.load_scenario(spark, sf_dir, "events")
    return log.select("row_id", "ts_s", "user_id", "item_id", "click", "reading_duration", "age")


@query("""
SELECT event_id, coalesce(TRY_CAST(event_type AS BIGINT), 0) AS bad_int,
       coalesce(TRY_CAST(CAST(event_id AS VARCHAR) AS BIGINT), 0) AS good_int,
       coalesce(TRY_CAST(event_type AS DOUBLE), 0.0) AS bad_float,
       CAST(trunc(value) AS BIGINT) AS cut,
       coalesce(value, 0.0) AS good_float
FROM events""")
def defaulting_casts(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return events.select(
        "event_id",
        safe_int(F.col("event_type")).alias("bad_int"),
        safe_int(F.col("event_id").cast("string")).alias("good_int"),
        safe_float(F.col("event_type")).alias("bad_float"),
        finalize_int(F.col("value").cast("string")).alias("cut"),
        safe_float(F.col("value")).alias("good_float"),
    )


@query(f"""
WITH {INTERACTIONS}, chosen AS (
  SELECT user_id FROM interactions GROUP BY user_id ORDER BY min(row_id) LIMIT 20
) SELECT {LOG_COLUMNS} FROM interactions WHERE user_id IN (SELECT user_id FROM chosen)""")
def first_users_in_file(spark, sf_dir):
    return split.first_users(interactions(spark, sf_dir), 20).select(
        "row_id", "user_id", "item_id", "ts_s", "click", "like", "share", "follow"
    )


@query(f"""
WITH {INTERACTIONS}, chosen AS (
  SELECT user_id FROM interactions GROUP BY user_id ORDER BY min(ts_s), user_id LIMIT 20
) SELECT {LOG_COLUMNS} FROM interactions WHERE user_id IN (SELECT user_id FROM chosen)""")
def first_users_in_time(spark, sf_dir):
    return split.earliest_users(interactions(spark, sf_dir), 20).select(
        "row_id", "user_id", "item_id", "ts_s", "click", "like", "share", "follow"
    )


@query(f"WITH {INTERACTIONS} SELECT row_id, user_id, item_id FROM interactions ORDER BY row_id LIMIT 1000")
def head_limited_scan(spark, sf_dir):
    """The first 1000 rows: the limit is the feature."""
    return split.first_rows(interactions(spark, sf_dir), 1000).select("row_id", "user_id", "item_id")


@query("SELECT count(*) AS n FROM events WHERE TRY_CAST(props AS BIGINT) IS NOT NULL OR event_type <> 'error'")
def numeric_user_rows(spark, sf_dir):
    """Rows whose user id text is a number; errors are given a text id."""
    events = table(spark, sf_dir, "events")
    user = F.when(F.col("event_type") == "error", F.col("props")).otherwise(F.col("user_id").cast("string"))
    return logs.valid_users(events.withColumn("user_id", user)).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {INTERACTIONS} SELECT row_id, user_id FROM interactions WHERE row_id IN (SELECT row_id FROM interactions WHERE \"like\" = 1)")
def rows_by_list(spark, sf_dir):
    log = interactions(spark, sf_dir)
    chosen = log.where(F.col("like") == 1).select("row_id")
    return split.rows_by_id(log, chosen).select("row_id", "user_id")


@query(f"WITH {INTERACTIONS} SELECT row_id, user_id FROM interactions WHERE row_id >= 100 AND row_id < 5000")
def rows_by_range(spark, sf_dir):
    return split.row_range(interactions(spark, sf_dir), 100, 5000).select("row_id", "user_id")


@query(f"WITH {SPLIT} SELECT row_id, user_id, item_id, ts_s, split FROM split_log")
def temporal_split(spark, sf_dir):
    return split.temporal_split(interactions(spark, sf_dir)).select("row_id", "user_id", "item_id", "ts_s", "split")


@query(f"WITH {SPLIT} SELECT split, count(*) AS n, CAST(sum(row_id) AS BIGINT) AS ids FROM split_log GROUP BY split")
def split_table(spark, sf_dir):
    """The split written by part and read back."""
    path = new_scratch_path(spark, "split")
    tables.write_split(split.temporal_split(interactions(spark, sf_dir)), path)
    stored = tables.read_split(spark, path)
    return stored.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum("row_id").alias("ids"))


@query(f"WITH {SPLIT} SELECT DISTINCT item_id FROM split_log WHERE split = 'train'")
def training_item_pool(spark, sf_dir):
    return training_items(split.temporal_split(interactions(spark, sf_dir)))


@query(f"""
WITH {INTERACTIONS} SELECT count(*) AS total_interactions, count(DISTINCT user_id) AS total_users,
  count(DISTINCT item_id) AS total_items, CAST(sum(click) AS BIGINT) AS total_clicks,
  CAST(sum("like") AS BIGINT) AS total_likes, CAST(sum(share) AS BIGINT) AS total_shares,
  CAST(sum(follow) AS BIGINT) AS total_follows,
  round(avg(click), 9) AS click_rate, round(avg("like"), 9) AS like_rate, round(avg(share), 9) AS share_rate,
  round(avg(follow), 9) AS follow_rate FROM interactions""")
def dataset_statistics(spark, sf_dir):
    found = stats.dataset_statistics(interactions(spark, sf_dir))
    rates = {c: F.round(c, 9) for c in found.columns if c.endswith("_rate")}
    return found.withColumns(rates)


@query(f"""
WITH {INTERACTIONS} SELECT count(*) AS total_interactions, count(DISTINCT user_id) AS total_users,
  count(DISTINCT item_id) AS total_items, round(avg(click), 9) AS ctr FROM interactions""")
def headline_numbers(spark, sf_dir):
    return stats.headline(interactions(spark, sf_dir)).withColumn("ctr", F.round("ctr", 9))


@query(f"""
WITH {INTERACTIONS} SELECT 'click' AS action, CAST(sum(click) AS BIGINT) AS n FROM interactions
UNION ALL SELECT 'like', CAST(sum("like") AS BIGINT) FROM interactions
UNION ALL SELECT 'share', CAST(sum(share) AS BIGINT) FROM interactions
UNION ALL SELECT 'follow', CAST(sum(follow) AS BIGINT) FROM interactions""")
def action_totals(spark, sf_dir):
    return stats.action_totals(interactions(spark, sf_dir))


@query(f"WITH {INTERACTIONS} SELECT item_id, count(*) AS n FROM interactions GROUP BY item_id")
def item_popularity(spark, sf_dir):
    return stats.item_popularity(interactions(spark, sf_dir))


@query(f"WITH {INTERACTIONS} SELECT item_id, count(*) AS n FROM interactions GROUP BY item_id ORDER BY n DESC, item_id LIMIT 20")
def popular_items(spark, sf_dir):
    return stats.popular_items(interactions(spark, sf_dir), 20)


@query(f"WITH {INTERACTIONS} SELECT DISTINCT user_id, item_id FROM interactions")
def user_item_pairs(spark, sf_dir):
    return stats.user_items(interactions(spark, sf_dir))


@query(f"WITH {INTERACTIONS} SELECT DISTINCT item_id FROM interactions")
def distinct_items(spark, sf_dir):
    return stats.distinct_ids(interactions(spark, sf_dir), "item_id")


@query(f"WITH {INTERACTIONS} SELECT DISTINCT user_id FROM interactions")
def distinct_users(spark, sf_dir):
    return stats.distinct_ids(interactions(spark, sf_dir), "user_id")


@query(f"WITH {INTERACTIONS} SELECT max(user_id) AS max_user_id, max(item_id) AS max_item_id FROM interactions")
def max_ids(spark, sf_dir):
    return stats.max_ids(interactions(spark, sf_dir))


@query(f"""
WITH {INTERACTIONS} SELECT item_id, video_category AS category FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY ts_s DESC, row_id DESC) AS rn FROM interactions
) WHERE rn = 1""")
def item_dimension(spark, sf_dir):
    return stats.item_dimension(interactions(spark, sf_dir))


@query(f"""
WITH {SPLIT}, dim AS (SELECT item_id, category FROM (
  SELECT item_id, video_category AS category,
         row_number() OVER (PARTITION BY item_id ORDER BY ts_s DESC, row_id DESC) AS rn
  FROM split_log WHERE split = 'train') WHERE rn = 1)
SELECT row_id, i.item_id, coalesce(category, 0) AS category FROM interactions i LEFT JOIN dim USING (item_id)""")
def item_category_lookup(spark, sf_dir):
    log = interactions(spark, sf_dir)
    train = split.part(split.temporal_split(log), "train")
    return stats.with_category(log, stats.item_dimension(train)).select("row_id", "item_id", "category")


@query("""
SELECT round(stddev_pop(value), 6) AS score_std, min(value) AS score_min, max(value) AS score_max FROM events""")
def score_spread(spark, sf_dir):
    return stats.score_spread(table(spark, sf_dir, "events"), "value").withColumn("score_std", F.round("score_std", 6))


@query("""
SELECT 'ratio' AS column_name, count(*) FILTER (l_tax = 0) AS non_finite FROM lineitem
UNION ALL SELECT 'price', 0 FROM (SELECT 1)""")
def non_finite_report(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    inf = F.lit(float("inf"))
    ratio = F.when(F.col("l_tax") == 0, F.when(F.col("l_discount") == 0, F.lit(float("nan"))).otherwise(inf)).otherwise(
        F.try_divide("l_discount", "l_tax")
    )
    return stats.non_finite_report(
        lines.select(ratio.alias("ratio"), F.col("l_extendedprice").alias("price")), ["ratio", "price"]
    )


@query("""
SELECT event_id, round((value - (SELECT min(value) FROM events)) /
  ((SELECT max(value) FROM events) - (SELECT min(value) FROM events)), 9) AS scaled FROM events""")
def min_max_scaled(spark, sf_dir):
    scaled = stats.min_max_normalize(table(spark, sf_dir, "events"), "value", "scaled")
    return scaled.select("event_id", F.round("scaled", 9).alias("scaled"))


@query("""
SELECT event_id, round(CASE WHEN abs(hi - lo) < 1e-12 THEN 0.5 ELSE (value - lo) / (hi - lo) END, 9) AS scaled FROM (
  SELECT event_id, value, min(value) OVER (PARTITION BY user_id) AS lo, max(value) OVER (PARTITION BY user_id) AS hi
  FROM events)""")
def min_max_scaled_by_user(spark, sf_dir):
    scaled = stats.min_max_normalize(table(spark, sf_dir, "events"), "value", "scaled", ["user_id"])
    return scaled.select("event_id", F.round("scaled", 9).alias("scaled"))


