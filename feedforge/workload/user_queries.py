"""Profiles, histories and history features."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedforge.functions import actions, hashing, history
from feedforge.functions.coerce import finite, finite_array
from feedforge.operators import histories, profiles
from feedforge.operators.split import part, rows_of_first_positions, temporal_split
from feedforge.plans.datasets import with_history_block, with_stored_history
from feedforge.workload.registry import joined_text, query
from feedforge.workload.views import INTERACTIONS, PRIOR, PRIOR_ONLY, SPLIT, interactions, table


@query(f"""
WITH {INTERACTIONS}, points AS (
  SELECT user_id, video_category AS category, CAST(sum(click + 2 * "like") AS DOUBLE) AS points
  FROM interactions GROUP BY ALL
), totals AS (SELECT user_id, sum(points) AS total FROM points GROUP BY user_id),
users AS (SELECT user_id, total, unnest(range(100)) AS category FROM totals)
SELECT u.user_id, CAST(u.category AS INTEGER) AS category,
       round(CASE WHEN u.total > 0 THEN coalesce(p.points, 0) / u.total ELSE 0 END, 9) AS preference
FROM users u LEFT JOIN points p ON p.user_id = u.user_id AND p.category = u.category""")
def category_preference(spark, sf_dir):
    vectors = profiles.category_preference(interactions(spark, sf_dir))
    rows = vectors.select("user_id", F.posexplode("preference").alias("category", "preference"))
    return rows.withColumn("preference", F.round("preference", 9))


@query(f"""
WITH {INTERACTIONS}, agg AS (
  SELECT user_id, count(*) AS n, CAST(sum(click) AS BIGINT) AS n_click, CAST(sum("like") AS BIGINT) AS n_like,
         CAST(sum(share) AS BIGINT) AS n_share, CAST(sum(follow) AS BIGINT) AS n_follow,
         (max(ts_s) - min(ts_s)) / 86400.0::DOUBLE AS days
  FROM interactions GROUP BY user_id
), scored AS (
  SELECT *, least(n / 100.0::DOUBLE, 1.0) * 0.4::DOUBLE
    + ((n_click > 0)::INT + (n_like > 0)::INT + (n_share > 0)::INT + (n_follow > 0)::INT) / 4.0::DOUBLE * 0.3::DOUBLE
    + least((CASE WHEN days > 0 THEN n / days ELSE n END) / 10.0::DOUBLE, 1.0) * 0.3::DOUBLE AS s FROM agg
)
SELECT user_id, n, n_click, n_like, n_share, n_follow, round(s, 9) AS activity_score,
       CASE WHEN n < 5 THEN 0 WHEN s < 0.2 THEN 1 WHEN s < 0.5 THEN 2 WHEN s < 0.8 THEN 3 ELSE 4 END AS activity_level
FROM scored""")
def user_activity(spark, sf_dir):
    found = profiles.user_activity(interactions(spark, sf_dir)).drop("days")
    return found.withColumn("activity_score", F.round("activity_score", 9))


@query(f"WITH {INTERACTIONS} SELECT row_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts_s, row_id) AS seq FROM interactions")
def timelines(spark, sf_dir):
    return histories.timelines(interactions(spark, sf_dir)).select("row_id", "user_id", "seq")


@query(f"""
WITH {INTERACTIONS} SELECT row_id, user_id, item_id, recency FROM (
  SELECT row_id, user_id, item_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts_s DESC, row_id DESC) AS INTEGER) AS recency
  FROM interactions) WHERE recency <= 20""")
def recent_items(spark, sf_dir):
    return histories.recent_items(interactions(spark, sf_dir), 20).select("row_id", "user_id", "item_id", "recency")


@query(f"""
WITH {INTERACTIONS} SELECT user_id, array_to_string(list(item_id ORDER BY ts_s, row_id), ',') AS items,
  array_to_string(list(click ORDER BY ts_s, row_id), ',') AS clicks FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts_s DESC, row_id DESC) AS rn FROM interactions)
WHERE rn <= 128 GROUP BY user_id""")
def user_histories(spark, sf_dir):
    found = histories.user_histories(interactions(spark, sf_dir))
    return found.select(
        "user_id",
        joined_text(F.transform("history", lambda s: s["item_id"])).alias("items"),
        joined_text(F.transform("history", lambda s: s["click"])).alias("clicks"),
    )


@query(f"""
WITH {INTERACTIONS}, hist AS (
  SELECT user_id, row_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY ts_s, row_id) AS seq FROM interactions
) SELECT c_custkey AS user_id, row_id, item_id, seq, (seq - 1) // 100 AS page
FROM customer LEFT JOIN hist ON hist.user_id = c_custkey""")
def histories_for_users(spark, sf_dir):
    """Whole histories of every customer in long form; most have none."""
    users = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"))
    steps = histories.whole_histories(interactions(spark, sf_dir), page_size=100)
    found = histories.histories_for(users, steps)
    return found.select("user_id", "row_id", "item_id", F.col("seq").cast("bigint").alias("seq"), "page")


@query(f"""
WITH {PRIOR} SELECT user_id, row_id, item_id, ts_s, array_to_string(hist_items, ',') AS hist_items FROM (
  SELECT i.*, coalesce(p.hist_items, []) AS hist_items,
         row_number() OVER (PARTITION BY i.user_id ORDER BY i.ts_s DESC, i.row_id DESC) AS rn
  FROM interactions i JOIN prior p USING (row_id)) WHERE rn = 1""")
def latest_row_per_user(spark, sf_dir):
    rows = histories.latest_rows(with_stored_history(interactions(spark, sf_dir)))
    return rows.select("user_id", "row_id", "item_id", "ts_s", joined_text(F.col("hist_items")).alias("hist_items"))


@query(f"""
WITH {SPLIT}, {PRIOR_ONLY} SELECT user_id, row_id, array_to_string(hist_items, ',') AS hist_items FROM (
  SELECT i.*, coalesce(p.hist_items, []) AS hist_items,
         row_number() OVER (PARTITION BY i.user_id ORDER BY i.row_id) AS rn
  FROM split_log i JOIN prior p USING (row_id) WHERE split = 'test') WHERE rn = 1 AND len(hist_items) > 0""")
def first_row_with_history(spark, sf_dir):
    """First test row of every user, where it has a history."""
    log = temporal_split(with_stored_history(interactions(spark, sf_dir)))
    rows = rows_of_first_positions(part(log, "test"))
    return rows.select("user_id", "row_id", joined_text(F.col("hist_items")).alias("hist_items"))


@query(f"""
WITH {INTERACTIONS}, h AS (
  SELECT i.row_id, i.user_id, p.item_id, p.click, p."like", p.ts_s AS h_ts, p.row_id AS h_row,
         row_number() OVER (PARTITION BY i.row_id ORDER BY p.ts_s DESC, p.row_id DESC) AS rn
  FROM interactions i LEFT JOIN interactions p ON p.user_id = i.user_id AND p.ts_s < i.ts_s
)
SELECT row_id, user_id,
  coalesce(array_to_string(list(item_id ORDER BY h_ts DESC, h_row DESC) FILTER (item_id IS NOT NULL), ','), '') AS items,
  coalesce(array_to_string(list(click ORDER BY h_ts DESC, h_row DESC) FILTER (item_id IS NOT NULL), ','), '') AS clicks,
  coalesce(array_to_string(list("like" ORDER BY h_ts DESC, h_row DESC) FILTER (item_id IS NOT NULL), ','), '') AS likes
FROM h WHERE rn <= 20 GROUP BY row_id, user_id""")
def history_before_row(spark, sf_dir):
    """Latest 20 interactions strictly before each interaction."""
    found = histories.with_prior_history(interactions(spark, sf_dir), 20)
    return found.select(
        "row_id",
        "user_id",
        joined_text(F.transform("history", lambda s: s["item_id"])).alias("items"),
        joined_text(F.transform("history", lambda s: s["click"])).alias("clicks"),
        joined_text(F.transform("history", lambda s: s["like"])).alias("likes"),
    )


@query(f"""
WITH {PRIOR}, slots AS (
  SELECT row_id, unnest(range(10)) AS slot, coalesce(hist_items, []) AS h FROM prior
), items AS (SELECT row_id, slot, coalesce(h[slot + 1], 0) AS item FROM slots)
SELECT row_id, CAST(slot AS INTEGER) AS slot,
  CASE WHEN item = 0 THEN 0 ELSE ((item * 2654435761) % 100000) + 1 END AS item_hash,
  CASE WHEN item = 0 THEN 0 ELSE ((item * 31 * 2 * 2654435761) % 100000) + 1 END AS author_hash,
  item % 16 AS surface, CASE WHEN item = 0 THEN 0 ELSE 1 END AS click
FROM items""")
def history_block(spark, sf_dir):
    """Padded history arrays of rows with a stored history, one row per slot."""
    log = with_stored_history(interactions(spark, sf_dir))
    found = with_history_block(log, 10, stored_only=True)
    zipped = F.arrays_zip("history_item_hashes", "history_author_hashes", "history_surface", "history_actions")
    rows = found.select("row_id", F.posexplode(zipped).alias("slot", "h"))
    return rows.select(
        "row_id",
        "slot",
        F.col("h.history_item_hashes")[0].alias("item_hash"),
        F.col("h.history_author_hashes")[1].alias("author_hash"),
        F.col("h.history_surface").alias("surface"),
        F.col("h.history_actions")[0].cast("int").alias("click"),
    )


@query(f"""
WITH {INTERACTIONS}, h AS (
  SELECT i.row_id, p.item_id, p.click, p."like", row_number() OVER (PARTITION BY i.row_id ORDER BY p.ts_s DESC, p.row_id DESC) AS rn
  FROM interactions i JOIN interactions p ON p.user_id = i.user_id AND p.ts_s < i.ts_s
), slots AS (SELECT row_id, unnest(range(10)) AS slot FROM interactions)
SELECT s.row_id, CAST(slot AS INTEGER) AS slot,
  coalesce(((item_id * 2 * 2654435761) % 100000) + 1, 0) AS item_hash, coalesce(item_id % 16, 0) AS surface,
  coalesce(click, 0) AS click, coalesce("like", 0) AS "like"
FROM slots s LEFT JOIN h ON h.row_id = s.row_id AND rn = slot + 1""")
def recorded_history_block(spark, sf_dir):
    """Padded history arrays from the log itself, with recorded actions."""
    found = with_history_block(interactions(spark, sf_dir), 10)
    zipped = F.arrays_zip("history_item_hashes", "history_surface", "history_actions")
    rows = found.select("row_id", F.posexplode(zipped).alias("slot", "h"))
    return rows.select(
        "row_id",
        "slot",
        F.col("h.history_item_hashes")[1].alias("item_hash"),
        F.col("h.history_surface").alias("surface"),
        F.col("h.history_actions")[0].cast("int").alias("click"),
        F.col("h.history_actions")[1].cast("int").alias("like"),
    )


@query(f"""
WITH {INTERACTIONS} SELECT user_id, item_id, click, "like", share, follow FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, item_id ORDER BY ts_s DESC, row_id DESC) AS rn FROM interactions
) WHERE rn = 1""")
def latest_actions(spark, sf_dir):
    found = histories.latest_actions(interactions(spark, sf_dir))
    return found.select(
        "user_id", "item_id", *[F.col("actions")[i].cast("int").alias(a) for i, a in enumerate(actions.ACTIONS)]
    )


@query(f"""
WITH {INTERACTIONS}, last AS (SELECT user_id, item_id, click, "like" FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, item_id ORDER BY ts_s DESC, row_id DESC) AS rn FROM interactions
) WHERE rn = 1), pairs AS (SELECT DISTINCT o_custkey AS user_id, l_partkey + 1 AS item_id
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT user_id, item_id, coalesce(click, 0) AS click, coalesce("like", 0) AS "like" FROM pairs LEFT JOIN last USING (user_id, item_id)""")
def actions_lookup(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    pairs = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("user_id"), (F.col("l_partkey") + 1).alias("item_id")
    )
    found = histories.with_actions(pairs.distinct(), interactions(spark, sf_dir))
    return found.select(
        "user_id", "item_id", F.col("actions")[0].cast("int").alias("click"), F.col("actions")[1].cast("int").alias("like")
    )


@query(f"""
WITH {INTERACTIONS} SELECT row_id, (click = 1 OR "like" = 1 OR share = 1 OR follow = 1) AS positive,
  concat_ws(',', click, "like", share, follow) AS vector,
  concat_ws(',', "like", 0, 0, 0, click, 0, 0, share, 0, 0, 0, 0, 0, follow, 0, 0, 0, 0, 0) AS wide
FROM interactions""")
def action_vectors(spark, sf_dir):
    ints = lambda c: joined_text(F.transform(c, lambda x: x.cast("int")))
    vector = actions.action_vector()
    return interactions(spark, sf_dir).select(
        "row_id",
        actions.has_positive().alias("positive"),
        ints(vector).alias("vector"),
        ints(actions.wide_action_vector(vector)).alias("wide"),
    )


@query(f"""
WITH {INTERACTIONS} SELECT row_id,
  concat_ws(',', ((user_id * 2654435761) % 100000) + 1, ((user_id * 2 * 2654435761) % 100000) + 1) AS user_hashes,
  concat_ws(',', ((item_id * 2654435761) % 100000) + 1, ((item_id * 2 * 2654435761) % 100000) + 1) AS item_hashes,
  concat_ws(',', ((item_id * 31 * 2654435761) % 100000) + 1, ((item_id * 62 * 2654435761) % 100000) + 1) AS author_hashes,
  item_id % 16 AS surface FROM interactions""")
def hashed_ids(spark, sf_dir):
    return interactions(spark, sf_dir).select(
        "row_id",
        joined_text(hashing.multi_hash(F.col("user_id"))).alias("user_hashes"),
        joined_text(hashing.multi_hash(F.col("item_id"))).alias("item_hashes"),
        joined_text(hashing.author_hash(F.col("item_id"))).alias("author_hashes"),
        hashing.product_surface(F.col("item_id")).alias("surface"),
    )


@query("""
SELECT count(*) AS n, 0::BIGINT AS outside, 0::BIGINT AS unstable FROM documents""")
def bucket_indices(spark, sf_dir):
    """Hashing trick over whole texts: every index is in range and equal texts agree."""
    docs = table(spark, sf_dir, "documents")
    hashed = hashing.with_bucket_indices(docs, {"text": 1000, "lang": 16, "source": 64})
    outside = ~(
        F.col("text_bucket").between(0, 999) & F.col("lang_bucket").between(0, 15) & F.col("source_bucket").between(0, 63)
    )
    counted = hashed.agg(F.count(F.lit(1)).alias("n"), F.count_if(outside).alias("outside"))
    spread = hashed.groupBy("lang").agg((F.max("lang_bucket") - F.min("lang_bucket")).alias("d")).agg(F.sum("d").alias("d"))
    return counted.withColumn("unstable", spread.scalar().cast("bigint"))


@query(f"""
WITH {PRIOR} SELECT count(*) AS n, 0::BIGINT AS outside, CAST(sum(10 - len(coalesce(hist_items, []))) AS BIGINT) AS padding FROM prior""")
def encoded_histories(spark, sf_dir):
    """Encoded padded histories: items fall in 1..50000, padding stays 0."""
    log = with_stored_history(interactions(spark, sf_dir))
    encoded = log.select(hashing.encode_history(history.pad_history(F.col("hist_items"), 10)).alias("h"))
    outside = F.size(F.filter("h", lambda x: (x < 0) | (x > 50000)))
    zeros = F.size(F.filter("h", lambda x: x == 0))
    return encoded.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(outside).cast("bigint").alias("outside"),
        F.sum(zeros).cast("bigint").alias("padding"),
    )


@query(f"""
WITH {PRIOR}, s AS (SELECT row_id, coalesce(hist_items, []) AS h FROM prior)
SELECT row_id, CAST(len(h) AS INTEGER) AS valid_length,
  round(CASE WHEN len(h) = 0 THEN 0 ELSE len(list_distinct(h)) / len(h)::DOUBLE END, 9) AS uniqueness,
  CASE WHEN len(h) = 0 THEN 0 ELSE list_max(h) - list_min(h) END AS id_span,
  round(coalesce(list_sum(list_transform(range(len(h)), lambda i: power(0.9::DOUBLE, i))), 0), 9) AS weight
FROM s""")
def history_statistics(spark, sf_dir):
    log = with_stored_history(interactions(spark, sf_dir))
    weights = history.position_decay(F.size("hist_items"))
    return log.select(
        "row_id",
        history.valid_length(F.col("hist_items")).alias("valid_length"),
        F.round(history.uniqueness(F.col("hist_items")), 9).alias("uniqueness"),
        history.id_span(F.col("hist_items")).alias("id_span"),
        F.round(F.aggregate(weights, F.lit(0.0), lambda a, x: a + x), 9).alias("weight"),
    )


@query(f"""
WITH {PRIOR} SELECT i.row_id, coalesce(list_contains(p.hist_items, i.item_id), false) AS overlap
FROM interactions i JOIN prior p USING (row_id)""")
def history_overlap(spark, sf_dir):
    log = with_stored_history(interactions(spark, sf_dir))
    return log.select("row_id", history.in_history(F.col("item_id"), F.col("hist_items")).alias("overlap"))


@query(f"""
WITH {PRIOR}, s AS (SELECT row_id, list_concat(coalesce(hist_items, []), [0 FOR x IN range(12)])[1:12] AS h FROM prior)
SELECT row_id, array_to_string(h, ',') AS items, array_to_string([CASE WHEN x = 0 THEN 0 ELSE 1 END FOR x IN h], ',') AS clicks FROM s""")
def padded_histories(spark, sf_dir):
    log = with_stored_history(interactions(spark, sf_dir))
    padded = history.pad_history(F.col("hist_items"), 12)
    clicks = F.transform(history.placeholder_actions(padded), lambda a: a[0].cast("int"))
    return log.select("row_id", joined_text(padded).alias("items"), joined_text(clicks).alias("clicks"))


@query("""
SELECT event_id, round(1 / (1 + exp(-((value - 50) / 25))), 9) AS probability,
  round(CAST(event_type = 'click' AS INTEGER) * 0.9::DOUBLE + 0.05::DOUBLE, 9) AS smoothed FROM events""")
def probabilities(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    label = (F.col("event_type") == "click").cast("int")
    return events.select(
        "event_id",
        F.round(actions.sigmoid((F.col("value") - 50) / 25), 9).alias("probability"),
        F.round(actions.smooth_label(label, 0.1), 9).alias("smoothed"),
    )


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
  round(CASE WHEN l_tax = 0 THEN 0 ELSE l_discount / l_tax END, 9) AS ratio,
  round(greatest(-10, least(10, l_quantity)), 9) AS clamped FROM lineitem""")
def finite_values(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    inf = F.lit(float("inf"))
    ratio = F.when(F.col("l_tax") == 0, F.when(F.col("l_discount") == 0, F.lit(float("nan"))).otherwise(inf)).otherwise(
        F.try_divide("l_discount", "l_tax")
    )
    clamped = finite_array(F.array("l_quantity"), -10.0, 10.0)[0]
    return lines.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice",
        F.round(finite(ratio), 9).alias("ratio"),
        F.round(clamped, 9).alias("clamped"),
    )
