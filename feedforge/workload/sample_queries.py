"""Negative sampling, training tables and evaluation tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedforge.functions.draws import mix, point
from feedforge.operators import sampling
from feedforge.operators.split import part, subsample, temporal_split
from feedforge.operators.stats import item_dimension, item_popularity, popular_items, user_items
from feedforge.plans import datasets
from feedforge.session import new_scratch_path
from feedforge.sources import tables
from feedforge.workload.registry import joined_text, query
from feedforge.workload.views import INTERACTIONS, PRIOR_ONLY, SPLIT, interactions, sql_mix, sql_point, table

N = 4
SEED = 42
START, STRIDE, REFILL = sampling.START, sampling.STRIDE, sampling.REFILL

POSITIVES = "positives AS (SELECT DISTINCT user_id, item_id FROM interactions)"


def _samples(log):
    return log.select(F.col("row_id").alias("sample_id"), "user_id")


def _long(negatives):
    return sampling.exploded(negatives).withColumn("neg_pos", F.col("neg_pos").cast("int"))


UNIFORM = f"""
draws AS (
  SELECT sample_id, user_id, step, {sql_mix('sample_id', SEED, 'step')} % 101 AS item_id
  FROM (SELECT *, unnest(range({10 * N})) AS step FROM samples)
), accepted AS (
  SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY step) - 1 AS neg_pos FROM draws d
  WHERE NOT EXISTS (SELECT 1 FROM positives p WHERE p.user_id = d.user_id AND p.item_id = d.item_id)
) SELECT sample_id, user_id, CAST(neg_pos AS INTEGER) AS neg_pos, item_id FROM accepted WHERE neg_pos < {N}"""


@query(f"WITH {INTERACTIONS}, {POSITIVES}, samples AS (SELECT row_id AS sample_id, user_id FROM interactions), {UNIFORM}")
def uniform_negatives(spark, sf_dir):
    log = interactions(spark, sf_dir)
    return _long(sampling.uniform_negatives(_samples(log), user_items(log), 101, N, SEED))


@query(f"WITH {INTERACTIONS}, {POSITIVES}, samples AS (SELECT DISTINCT user_id AS sample_id, user_id FROM interactions), {UNIFORM}")
def uniform_negatives_by_user(spark, sf_dir):
    return _long(sampling.user_negatives(user_items(interactions(spark, sf_dir)), 101, N, SEED))


POPULARITY = f"""
WITH {INTERACTIONS}, {POSITIVES}, weights AS (
  SELECT item_id, CAST(round(power(count(*)::DOUBLE, 0.75::DOUBLE) * 1000000) AS BIGINT) AS w FROM interactions GROUP BY item_id
), ranges AS (
  SELECT item_id, CAST(sum(w) OVER o - w AS BIGINT) AS lo, CAST(sum(w) OVER o AS BIGINT) AS hi FROM weights
  WINDOW o AS (ORDER BY {sql_mix('item_id', 0)}, item_id)
), draws AS (
  SELECT row_id AS sample_id, user_id, step, {sql_point('row_id', SEED, 'step', '(SELECT sum(w) FROM weights)')} AS point
  FROM (SELECT *, unnest(range({10 * N})) AS step FROM interactions)
), hits AS (SELECT d.*, r.item_id FROM draws d JOIN ranges r ON d.point >= r.lo AND d.point < r.hi
), accepted AS (
  SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY step) - 1 AS neg_pos FROM hits h
  WHERE NOT EXISTS (SELECT 1 FROM positives p WHERE p.user_id = h.user_id AND p.item_id = h.item_id)
) SELECT sample_id, user_id, CAST(neg_pos AS INTEGER) AS neg_pos, item_id FROM accepted WHERE neg_pos < {N}"""


@query(POPULARITY)
def popularity_negatives(spark, sf_dir):
    log = interactions(spark, sf_dir)
    frequency = item_popularity(log).withColumnRenamed("n", "frequency")
    return _long(sampling.popularity_negatives(_samples(log), user_items(log), frequency, N, seed=SEED))


POOL = f"""pool AS (
  SELECT item_id, row_number() OVER (ORDER BY {sql_mix('item_id', SEED)}, item_id) - 1 AS idx
  FROM (SELECT DISTINCT item_id FROM split_log WHERE split = 'train')
)"""


def walk_sql(samples: str, seed: int, n: int = N) -> str:
    """SQL of the pool walk for samples (sample_id, user_id), as ``negs``."""
    return f"""size AS (SELECT count(*) AS m FROM pool), prime AS (
  SELECT m, list_filter(range(m, m + 300), lambda x: len(list_filter(range(2, 400), lambda d: d < x AND x % d = 0)) = 0)[1] AS p FROM size
), steps AS (
  SELECT sample_id, user_id, step, p, m, ({sql_mix('sample_id', seed, START)} % p
    + step * (1 + {sql_mix('sample_id', seed, STRIDE)} % (p - 1))) % p AS idx
  FROM (SELECT s.*, p, m, unnest(range(least(p, {68 * n}))) AS step FROM {samples} s, prime)
), accepted AS (
  SELECT sample_id, user_id, item_id, row_number() OVER (PARTITION BY sample_id ORDER BY step) - 1 AS neg_pos
  FROM steps JOIN pool USING (idx)
  WHERE NOT EXISTS (SELECT 1 FROM positives p WHERE p.user_id = steps.user_id AND p.item_id = pool.item_id)
), negs AS (SELECT sample_id, user_id, CAST(neg_pos AS INTEGER) AS neg_pos, item_id FROM accepted WHERE neg_pos < {n})"""


@query(f"WITH {SPLIT}, {POSITIVES}, {POOL}, samples AS (SELECT row_id AS sample_id, user_id FROM interactions), {walk_sql('samples', SEED)} SELECT * FROM negs")
def pool_negatives(spark, sf_dir):
    """Different training items per interaction, none of them the user's own."""
    log = interactions(spark, sf_dir)
    pool = datasets.training_items(temporal_split(log))
    return _long(sampling.pool_negatives(_samples(log), user_items(log), pool, N, SEED))


SLOTS = f"""
WITH {SPLIT}, {POSITIVES}, {POOL}, draws AS (
  SELECT row_id AS sample_id, user_id, slot, try, {sql_mix('row_id', SEED, f'try * {N} + slot')} % (SELECT count(*) FROM pool) AS idx
  FROM (SELECT *, unnest(range(101)) AS try FROM (SELECT *, unnest(range({N})) AS slot FROM interactions))
), flagged AS (
  SELECT d.*, pool.item_id, NOT EXISTS (SELECT 1 FROM positives p WHERE p.user_id = d.user_id AND p.item_id = pool.item_id) AS ok
  FROM draws d JOIN pool USING (idx)
) SELECT sample_id, user_id, CAST(slot AS INTEGER) AS neg_pos,
  coalesce(arg_min(item_id, try) FILTER (ok), arg_min(item_id, try)) AS item_id
FROM flagged GROUP BY sample_id, user_id, slot"""


@query(SLOTS)
def slot_negatives(spark, sf_dir):
    log = interactions(spark, sf_dir)
    pool = datasets.training_items(temporal_split(log))
    return _long(sampling.slot_negatives(_samples(log), user_items(log), pool, N, SEED))


@query(f"""
WITH {INTERACTIONS} SELECT row_id, user_id FROM interactions
QUALIFY row_number() OVER (ORDER BY {sql_mix('row_id', SEED)}, row_id) <= (SELECT count(*) * 3 // 5 FROM interactions)""")
def evaluation_subsample(spark, sf_dir):
    log = interactions(spark, sf_dir)
    return subsample(log, log.count() * 3 // 5, SEED).select("row_id", "user_id")


@query(f"""
WITH {INTERACTIONS}, pool AS (SELECT item_id, row_number() OVER (ORDER BY {sql_mix('item_id', SEED)}, item_id) - 1 AS idx
  FROM (SELECT DISTINCT item_id FROM interactions))
SELECT row_id AS sample_id, pool.item_id FROM interactions
JOIN pool ON idx = {sql_mix('row_id', SEED, 1)} % (SELECT count(*) FROM pool)""")
def random_item_per_row(spark, sf_dir):
    log = interactions(spark, sf_dir)
    pool = log.select("item_id").distinct()
    return sampling.pool_draws(_samples(log), pool, SEED).select("sample_id", "item_id")


@query(f"WITH {INTERACTIONS} SELECT DISTINCT item_id FROM interactions WHERE item_id NOT IN (SELECT item_id FROM interactions WHERE user_id = (SELECT min(user_id) FROM interactions))")
def items_new_to_user(spark, sf_dir):
    log = interactions(spark, sf_dir)
    user = log.agg(F.min("user_id")).first()[0]
    return sampling.pool_minus_positives(log.select("item_id"), user_items(log), user)


@query(f"""
WITH {INTERACTIONS}, popular AS (SELECT item_id FROM interactions GROUP BY item_id ORDER BY count(*) DESC, item_id LIMIT 50),
random AS (SELECT {sql_mix('i', SEED)} % 99999 + 1 AS item_id FROM range(50) t(i)),
u AS (SELECT item_id, min(origin) AS origin FROM (SELECT item_id, 0 AS origin FROM popular UNION ALL SELECT item_id, 1 FROM random) GROUP BY item_id)
SELECT item_id, origin FROM u ORDER BY origin, item_id LIMIT 100""")
def popular_and_random_items(spark, sf_dir):
    log = interactions(spark, sf_dir)
    return sampling.popular_and_random(log, popular_items(log, 50), 100_000, 50, 100, SEED)


@query(f"WITH {INTERACTIONS} SELECT row_id, {sql_mix('row_id', SEED + 3)} AS order_key FROM interactions")
def epoch_order(spark, sf_dir):
    return tables.epoch_order(interactions(spark, sf_dir), 3, SEED).select("row_id", "order_key")


@query(f"""
WITH {INTERACTIONS}, p AS (SELECT row_id, row_number() OVER (ORDER BY {sql_mix('row_id', SEED + 1)}, row_id) - 1 AS place FROM interactions)
SELECT row_id, CAST(place // 512 AS BIGINT) AS batch_id, CAST(place % 512 AS BIGINT) AS batch_pos FROM p
WHERE place // 512 < (SELECT count(*) // 512 FROM p)""")
def training_batches(spark, sf_dir):
    found = tables.with_batches(interactions(spark, sf_dir), 512, epoch=1, seed=SEED, drop_last=True)
    return found.select("row_id", "batch_id", "batch_pos")


@query(f"""
WITH {INTERACTIONS} SELECT row_id, CAST((row_number() OVER (ORDER BY row_id) - 1) // 512 AS BIGINT) AS batch_id FROM interactions""")
def ordered_batches(spark, sf_dir):
    """Batches in row order, written in files with a manifest and read back."""
    path = new_scratch_path(spark, "batches")
    tables.write_batches(tables.with_batches(interactions(spark, sf_dir), 512, shuffle=False), path)
    return tables.read_batches(spark, path).select("row_id", "batch_id")


@query(f"""
WITH {INTERACTIONS}, b AS (SELECT row_id, (row_number() OVER (ORDER BY row_id) - 1) // 64 AS batch_id,
  (row_number() OVER (ORDER BY row_id) - 1) % 64 AS batch_pos FROM interactions)
SELECT row_id, CAST(batch_id AS BIGINT) AS batch_id, CAST(batch_pos AS BIGINT) AS batch_pos,
  CAST((batch_id % 16) * 64 AS BIGINT) AS first_row FROM b WHERE batch_id BETWEEN 5 AND 14""")
def batch_range(spark, sf_dir):
    """Ten batches read by the manifest, with their first rows in their files; the range is the feature."""
    path = new_scratch_path(spark, "batches")
    tables.write_batches(tables.with_batches(interactions(spark, sf_dir), 64, shuffle=False), path, 16)
    rows = tables.read_batches(spark, path, 5, 14).select("row_id", "batch_id", "batch_pos")
    return rows.join(tables.batch_places(spark, path, 5, 14).select("batch_id", "first_row"), "batch_id")


def candidates_sql(negs: str, rows: str, shuffle_seed: int) -> str:
    """Long candidate lists in shuffled order, as ``cands``."""
    return f"""parts AS (
  SELECT row_id AS sample_id, user_id, 0 AS origin, item_id, click, "like", share, follow FROM {rows}
  UNION ALL
  SELECT sample_id, user_id, neg_pos + 1, item_id, 0, 0, 0, 0 FROM {negs}
), cands AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY sample_id ORDER BY {sql_mix('sample_id', shuffle_seed, 'origin')}, origin) - 1 AS INTEGER) AS cand_pos
  FROM parts
)"""


TRAIN = f"""
WITH {SPLIT}, {POSITIVES}, {POOL}, train AS (SELECT * FROM split_log WHERE split = 'train'),
samples AS (SELECT row_id AS sample_id, user_id FROM train), {walk_sql('samples', SEED)},
{candidates_sql('negs', 'train', SEED + 7777)}"""


@query(f'{TRAIN} SELECT sample_id, user_id, cand_pos, CAST(origin AS INTEGER) AS origin, item_id, click, "like", share, follow FROM cands')
def shuffled_candidates(spark, sf_dir):
    """Candidate lists of the training part, labels moving with their items."""
    log = temporal_split(interactions(spark, sf_dir))
    train, pool = part(log, "train"), datasets.training_items(log)
    negatives = sampling.pool_negatives(_samples(train), user_items(log), pool, N, SEED)
    return datasets.candidate_rows(train, negatives, SEED)


@query(f"""{TRAIN} SELECT sample_id, cand_pos, ((user_id * 2654435761) % 100000) + 1 AS user_hash,
  ((item_id * 2 * 2654435761) % 100000) + 1 AS item_hash, ((item_id * 31 * 2654435761) % 100000) + 1 AS author_hash,
  item_id % 16 AS surface, click, "like" FROM cands""")
def training_rows(spark, sf_dir):
    log = temporal_split(interactions(spark, sf_dir))
    train, pool = part(log, "train"), datasets.training_items(log)
    rows = datasets.training_rows(train, user_items(log), pool, N, history_length=20, seed=SEED)
    zipped = F.arrays_zip("candidate_item_hashes", "candidate_author_hashes", "candidate_surface", "labels")
    flat = rows.select("sample_id", "user_hashes", F.posexplode(zipped).alias("cand_pos", "c"))
    return flat.select(
        "sample_id",
        "cand_pos",
        F.col("user_hashes")[0].alias("user_hash"),
        F.col("c.candidate_item_hashes")[1].alias("item_hash"),
        F.col("c.candidate_author_hashes")[0].alias("author_hash"),
        F.col("c.candidate_surface").alias("surface"),
        F.col("c.labels")[0].cast("int").alias("click"),
        F.col("c.labels")[1].cast("int").alias("like"),
    )


EPOCH_SEED = SEED + 2 * datasets.EPOCH_STRIDE


@query(f"""
WITH {SPLIT}, {POSITIVES}, {POOL.replace(sql_mix('item_id', SEED), sql_mix('item_id', EPOCH_SEED))},
train AS (SELECT * FROM split_log WHERE split = 'train'),
samples AS (SELECT row_id AS sample_id, user_id FROM train), {walk_sql('samples', EPOCH_SEED)},
{candidates_sql('negs', 'train', EPOCH_SEED + 7777)}
SELECT sample_id, string_agg(CAST(((item_id * 2654435761) % 100000) + 1 AS VARCHAR), ',' ORDER BY cand_pos) AS items FROM cands GROUP BY sample_id""")
def epoch_training_rows(spark, sf_dir):
    """The rows of epoch 2: new negatives and a new order."""
    log = temporal_split(interactions(spark, sf_dir))
    train, pool = part(log, "train"), datasets.training_items(log)
    rows = datasets.training_rows(train, user_items(log), pool, N, history_length=5, seed=SEED, epoch=2)
    return rows.select("sample_id", joined_text(F.transform("candidate_item_hashes", lambda h: h[0])).alias("items"))


RAW = f"""
WITH {SPLIT}, {PRIOR_ONLY}, {POSITIVES}, {POOL}, train AS (SELECT * FROM split_log WHERE split = 'train'),
samples AS (SELECT row_id AS sample_id, user_id FROM train), {walk_sql('samples', SEED)},
{candidates_sql('negs', 'train', SEED + 7777)}, dim AS (
  SELECT item_id, video_category AS category FROM train
  QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY ts_s DESC, row_id DESC) = 1
), lists AS (
  SELECT sample_id, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY cand_pos) AS items,
    string_agg(CAST(coalesce(category, 0) AS VARCHAR), ',' ORDER BY cand_pos) AS categories,
    string_agg(CAST(click AS VARCHAR), ',' ORDER BY cand_pos) AS clicks
  FROM cands LEFT JOIN dim USING (item_id) GROUP BY sample_id
)
SELECT sample_id, t.user_id, gender, age, items, categories, clicks,
  array_to_string(list_concat(coalesce(hist_items, []), [0 FOR x IN range(10)])[1:10], ',') AS history
FROM lists JOIN train t ON t.row_id = sample_id JOIN prior USING (row_id)"""


@query(RAW)
def raw_training_rows(spark, sf_dir):
    log = temporal_split(datasets.with_stored_history(interactions(spark, sf_dir)))
    train, pool = part(log, "train"), datasets.training_items(log)
    rows = datasets.raw_training_rows(train, user_items(log), pool, item_dimension(train), N, seed=SEED)
    return rows.select(
        "sample_id", "user_id", "gender", "age",
        joined_text(F.col("candidate_item_ids")).alias("items"),
        joined_text(F.col("candidate_categories")).alias("categories"),
        joined_text(F.transform("labels", lambda x: x[0].cast("int"))).alias("clicks"),
        joined_text(F.col("history_item_ids")).alias("history"),
    )


EVALUATION = f"""
{SLOTS.replace('FROM (SELECT *, unnest(range(101))', 'FROM (SELECT *, unnest(range(101))').replace(f'unnest(range({N})) AS slot FROM interactions', f"unnest(range({N})) AS slot FROM split_log WHERE split = 'val'").replace(') SELECT sample_id, user_id, CAST(slot', '), negs AS (SELECT sample_id, user_id, CAST(slot')}),
val AS (SELECT * FROM split_log WHERE split = 'val'), {PRIOR_ONLY}, {candidates_sql('negs', 'val', SEED + 7777)}
SELECT sample_id, ((any_value(cands.user_id) * 2654435761) % 100000) + 1 AS user_ids,
  string_agg(CAST(((item_id * 2654435761) % 100000) + 1 AS VARCHAR), ',' ORDER BY cand_pos) AS items,
  string_agg(CAST(click AS VARCHAR), ',' ORDER BY cand_pos) AS clicks,
  any_value(array_to_string([CASE WHEN x = 0 THEN 0 ELSE ((x * 2654435761) % 100000) + 1 END FOR x IN
    list_concat(coalesce(hist_items, []), [0 FOR x IN range(12)])[1:12]], ',')) AS history
FROM cands JOIN prior ON prior.row_id = sample_id GROUP BY sample_id"""


@query(EVALUATION)
def evaluation_set(spark, sf_dir):
    """The evaluation table of the validation part, stored under its key and read back."""
    log = temporal_split(datasets.with_stored_history(interactions(spark, sf_dir)))
    val, pool = part(log, "val"), datasets.training_items(log)
    folder = new_scratch_path(spark, "evaluation")
    key = tables.evaluation_key(f"{sf_dir}/events.parquet", "events", "val", N, SEED, history_length=12)
    build = lambda: datasets.evaluation_rows(val, user_items(log), pool, N, 12, seed=SEED)
    tables.evaluation_table(spark, folder, key, build)
    rows = tables.evaluation_table(spark, folder, key, build)
    return rows.select(
        "sample_id", "user_ids",
        joined_text(F.col("candidate_item_ids")).alias("items"),
        joined_text(F.transform("labels", lambda x: x[0].cast("int"))).alias("clicks"),
        joined_text(F.col("history_item_ids")).alias("history"),
    )


DEMO = f"""
WITH {SPLIT}, {PRIOR_ONLY}, {POSITIVES}, pool AS (
  SELECT item_id, row_number() OVER (ORDER BY {sql_mix('item_id', SEED)}, item_id) - 1 AS idx FROM (SELECT DISTINCT item_id FROM interactions)
), first AS (
  SELECT * FROM (SELECT i.*, hist_items FROM split_log i JOIN prior USING (row_id) WHERE split = 'test'
    QUALIFY row_number() OVER (PARTITION BY i.user_id ORDER BY i.row_id) = 1) WHERE hist_items IS NOT NULL
), draws AS (
  SELECT row_id AS sample_id, user_id, step, {sql_mix('row_id', SEED, 'step')} % (SELECT count(*) FROM pool) AS idx
  FROM (SELECT *, unnest(range(54)) AS step FROM first)
), flagged AS (
  SELECT d.*, pool.item_id, NOT EXISTS (SELECT 1 FROM positives p WHERE p.user_id = d.user_id AND p.item_id = pool.item_id) AS ok
  FROM draws d JOIN pool USING (idx)
), chosen AS (SELECT * FROM flagged WHERE step >= 45 OR ok
  QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY step) <= 9)
SELECT sample_id, f.user_id, array_to_string(list_concat(f.hist_items, [0 FOR x IN range(10)])[1:10], ',') AS history,
  f.item_id || ',' || negs AS items
FROM first f JOIN (SELECT sample_id, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY step) AS negs FROM chosen GROUP BY sample_id)
  ON f.row_id = sample_id"""


@query(DEMO)
def demo_rows(spark, sf_dir):
    """First test row of every user with nine negatives."""
    log = temporal_split(datasets.with_stored_history(interactions(spark, sf_dir)))
    rows = datasets.demo_rows(part(log, "test"), user_items(log), log.select("item_id"), 9, 10, SEED)
    return rows.select(
        "sample_id",
        "user_id",
        joined_text(F.col("history_item_ids")).alias("history"),
        joined_text(F.col("candidate_item_ids")).alias("items"),
    )


WIDE_ID = "event_id * 2147483647"
ROOM = 4_000_000_000_000_000_003


@query(f"SELECT event_id, {sql_mix(WIDE_ID, 7)} AS mixed, {sql_point(WIDE_ID, 7, 3, str(ROOM))} AS point FROM events")
def wide_draws(spark, sf_dir):
    """Draws of ids that are 2**31 - 1 apart, from a range of 62 bits."""
    events = table(spark, sf_dir, "events")
    own = F.col("event_id") * F.lit(2147483647).cast("bigint")
    return events.select("event_id", mix(own, 7).alias("mixed"), point(own, 7, 3, ROOM).alias("point"))


@query(f"SELECT event_id, {sql_mix('event_id', 7, 3)} AS mixed FROM events")
def integer_mixing(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", mix(F.col("event_id"), 7, 3).alias("mixed"))
