"""Recency store, streams and file ingestion."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedforge.functions.coerce import finalize_int
from feedforge.operators import metrics, progress
from feedforge.session import new_scratch_path
from feedforge.streaming import feeds, recency
from feedforge.workload.metric_queries import ALL, KS, RANKED, _round_sql, _rounded
from feedforge.workload.registry import query
from feedforge.workload.views import INTERACTIONS, METRIC_LOG, interactions, metric_log, scored, table

# 2024-01-30, near the end of the events.
NOW = 1_706_572_800
TEN_DAYS = 864_000

STATE = f"""
{INTERACTIONS}, deleted AS (SELECT DISTINCT l_partkey + 1 AS item_id FROM lineitem WHERE l_returnflag = 'R' AND l_quantity = 50),
posts AS (SELECT *, row_id % 3 AS item_type FROM interactions WHERE item_id NOT IN (SELECT item_id FROM deleted)), arrived AS (
  SELECT user_id, item_id, ts_s, item_type, row_id AS arrival FROM posts
  QUALIFY row_number() OVER (PARTITION BY user_id, item_id ORDER BY ts_s, row_id) = 1
), state AS (
  SELECT * FROM arrived QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts_s DESC, arrival DESC) <= 500
)"""
STATE_COLUMNS = "user_id, item_id, ts_s, CAST(item_type AS TINYINT) AS item_type, arrival"


def _posts(spark, sf_dir):
    log = interactions(spark, sf_dir)
    return log.select("row_id", "user_id", "item_id", "ts_s", F.pmod("row_id", F.lit(3)).cast("tinyint").alias("item_type"))


def _deleted(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R' AND l_quantity = 50")
    return lines.select((F.col("l_partkey") + 1).alias("item_id")).distinct()


def _state(spark, sf_dir):
    return recency.snapshot(_posts(spark, sf_dir), _deleted(spark, sf_dir))


@query(f"WITH {STATE} SELECT {STATE_COLUMNS} FROM state")
def recency_snapshot(spark, sf_dir):
    return _state(spark, sf_dir)


@query(f"WITH {STATE} SELECT {STATE_COLUMNS} FROM state")
def recency_replay(spark, sf_dir):
    """The same state, read through in order."""
    return recency.replay(_posts(spark, sf_dir), _deleted(spark, sf_dir))


@query(f"""
WITH {STATE}, gone AS (SELECT DISTINCT item_id FROM interactions WHERE "like" = 1 AND reading_duration > 100)
SELECT user_id, item_id, arrival, CAST(recency AS INTEGER) AS recency FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts_s DESC, arrival DESC) AS recency FROM state
  WHERE item_id NOT IN (SELECT item_id FROM gone)) WHERE recency <= 20""")
def recency_read(spark, sf_dir):
    """Newest items per user; items deleted after loading are hidden."""
    log = interactions(spark, sf_dir)
    gone = log.where((F.col("like") == 1) & (F.col("reading_duration") > 100)).select("item_id")
    found = recency.read_histories(_state(spark, sf_dir), log.select("user_id"), gone)
    return found.select("user_id", "item_id", "arrival", "recency")


@query(f"WITH {STATE} SELECT {STATE_COLUMNS} FROM state WHERE ts_s >= {NOW - TEN_DAYS}")
def recency_trim(spark, sf_dir):
    return recency.trim(_state(spark, sf_dir), NOW, TEN_DAYS)


@query(f"WITH {STATE} SELECT count(*) AS trimmed FROM state WHERE ts_s < {NOW - TEN_DAYS}")
def recency_trimmed_count(spark, sf_dir):
    return recency.trimmed_count(_state(spark, sf_dir), NOW, TEN_DAYS)


@query(f"WITH {STATE} SELECT count(DISTINCT user_id) AS users, count(*) AS items, (SELECT count(*) FROM deleted) AS deleted FROM state")
def recency_statistics(spark, sf_dir):
    return recency.store_statistics(_state(spark, sf_dir), _deleted(spark, sf_dir))


def _post_stream(spark, sf_dir):
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("bigint")
    return events.select(
        F.col("event_id").alias("row_id"),
        "user_id",
        (k + 1).alias("item_id"),
        F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', ts)").alias("ts_s"),
        F.pmod("event_id", F.lit(3)).cast("tinyint").alias("item_type"),
        F.col("ts").cast("timestamp").alias("ts"),
    )


@query(f"WITH {STATE} SELECT {STATE_COLUMNS} FROM state")
def recency_stream(spark, sf_dir):
    """The event file as a stream through keyed state; one year of retention keeps everything."""
    state, checkpoint = new_scratch_path(spark, "recency"), new_scratch_path(spark, "recency-checkpoint")
    stream = recency.recency_stream(_post_stream(spark, sf_dir), _deleted(spark, sf_dir), retention=31_536_000)
    cores = spark.sparkContext.defaultParallelism
    recency.start_snapshot_sink(stream, state, checkpoint, state_partitions=cores).awaitTermination()
    return recency.latest_snapshot(spark, state)


@query(f"""
WITH {STATE} SELECT {STATE_COLUMNS} FROM state
WHERE ts_s * 1000 >= (SELECT epoch_ms(max(ts)) - {TEN_DAYS} * 1000 FROM events)""")
def recency_stream_retention(spark, sf_dir):
    """The same stream with ten days of retention: timers remove the older items."""
    state, checkpoint = new_scratch_path(spark, "recency"), new_scratch_path(spark, "recency-checkpoint")
    stream = recency.recency_stream(_post_stream(spark, sf_dir), _deleted(spark, sf_dir), retention=TEN_DAYS)
    cores = spark.sparkContext.defaultParallelism
    recency.start_snapshot_sink(stream, state, checkpoint, state_partitions=cores, compact_every=1).awaitTermination()
    return recency.latest_snapshot(spark, state)


@query("SELECT 0::BIGINT AS items")
def recency_clear(spark, sf_dir):
    """A stored state emptied."""
    path = new_scratch_path(spark, "recency")
    posts = _state(spark, sf_dir)
    rows = posts.withColumns({"place": F.col("arrival"), "gone": F.lit(False)})
    rows.write.parquet(f"{path}/base=0")
    recency.clear(spark, path)
    return recency.latest_snapshot(spark, path).agg(F.count(F.lit(1)).alias("items"))


@query(f"WITH {INTERACTIONS} SELECT row_id, user_id, item_id, click FROM interactions")
def chunked_ingestion(spark, sf_dir):
    """The log as CSV files, taken in file by file into Parquet."""
    source, target = new_scratch_path(spark, "chunks"), new_scratch_path(spark, "ingested")
    columns = ["row_id", "user_id", "item_id", "click"]
    interactions(spark, sf_dir).select(*columns).write.option("header", True).csv(source)
    typed = lambda df: df.select(*[finalize_int(F.col(c), "int" if c == "click" else "bigint").alias(c) for c in columns])
    feeds.ingest_csv(spark, source, columns, target, new_scratch_path(spark, "ingest-checkpoint"), typed).awaitTermination()
    return spark.read.parquet(target)


SCORE_COLUMNS = ("sample_id", "cand_pos", "label", "score")


@query(f"WITH {RANKED} SELECT {_round_sql(ALL)} FROM per_sample")
def incremental_metrics(spark, sf_dir):
    """Scored rows collected from a stream, then measured together."""
    source, target = new_scratch_path(spark, "scored"), new_scratch_path(spark, "collected")
    rows = scored(spark, sf_dir).select(*SCORE_COLUMNS)
    rows.write.parquet(source)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 4).parquet(source)
    feeds.collect_scores(stream, target, new_scratch_path(spark, "collect-checkpoint")).awaitTermination()
    return _rounded(feeds.collected_metrics(spark, target, KS)).drop("auc")


@query(f"""
WITH {RANKED}, m AS (SELECT {_round_sql(ALL)} FROM per_sample)
SELECT 'live/mrr' AS name, 0::BIGINT AS step, mrr AS value FROM m""")
def incremental_metric_log(spark, sf_dir):
    """Metric rows of a stream added to a metric log."""
    source, target = new_scratch_path(spark, "metric-rows"), new_scratch_path(spark, "metric-log")
    report = metrics.report(_rounded(metrics.mrr(scored(spark, sf_dir))))
    report.write.parquet(source)
    stream = spark.readStream.schema(report.schema).parquet(source)
    feeds.log_metrics(stream, target, new_scratch_path(spark, "log-checkpoint"), "live").awaitTermination()
    return feeds.read_metric_log(spark, target).select("name", "step", "value")


def _streamed_log(spark, sf_dir):
    """A metric log taken in as a stream, a file a batch."""
    source, target = new_scratch_path(spark, "metric-rows"), new_scratch_path(spark, "metric-log")
    rows = metric_log(spark, sf_dir).withColumnRenamed("name", "metric")
    rows.repartition(4).write.parquet(source)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(source)
    feeds.log_metrics(stream, target, new_scratch_path(spark, "log-checkpoint"), "live", 3).awaitTermination()
    return target


@query(f"""
WITH {METRIC_LOG}, log AS (SELECT 'live/' || name AS name, step, value FROM metric_log)
SELECT name, step, round(value, 6) AS value,
  round(CASE WHEN name LIKE '%/loss' THEN min(value) OVER w ELSE max(value) OVER w END, 6) AS best
FROM log WINDOW w AS (PARTITION BY name ORDER BY step ROWS UNBOUNDED PRECEDING)""")
def streamed_metric_history(spark, sf_dir):
    """Many metrics and steps streamed into a compacted log; best values in the order of steps."""
    log = feeds.read_metric_log(spark, _streamed_log(spark, sf_dir)).drop("best")
    return progress.running_best(log).withColumns({c: F.round(c, 6) for c in ("value", "best")})


@query(f"""
WITH {METRIC_LOG} SELECT 'live/' || name AS name,
  round(CASE WHEN name LIKE '%/loss' THEN min(value) ELSE max(value) END, 6) AS best FROM metric_log GROUP BY name""")
def streamed_best_metrics(spark, sf_dir):
    """Best value of every streamed metric, merged batch by batch."""
    return feeds.best_metrics(spark, _streamed_log(spark, sf_dir)).withColumn("best", F.round("best", 6))


