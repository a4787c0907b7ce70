"""File ingestion and incremental metrics on streams."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedforge.operators import progress
from feedforge.operators.metrics import K_VALUES, all_metrics
from feedforge.operators.segments import asc, running
from feedforge.sources.tables import append_metrics
from feedforge.streaming.recency import COMPACT_EVERY, _folders, _remove

LOG_SCHEMA = "name string, step long, value double, best double"
BEST_SCHEMA = "name string, high double, low double"


def ingest_csv(
    spark: SparkSession,
    folder: str,
    columns: Sequence[str],
    target: str,
    checkpoint: str,
    transform: Callable[[DataFrame], DataFrame] | None = None,
    max_files: int = 1000,
):
    """Turn the CSV files of a folder into a Parquet table, each file once."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    stream = (
        spark.readStream.schema(schema)
        .option("header", True)
        .option("nullValue", "\\N")
        .option("maxFilesPerTrigger", max_files)
        .csv(folder)
    )
    return (
        (transform(stream) if transform else stream)
        .writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .option("path", target)
        .trigger(availableNow=True)
        .start()
    )


def collect_scores(scored: DataFrame, path: str, checkpoint: str):
    """Add the scored candidates of every micro-batch to a table."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return (
        scored.writeStream.option("checkpointLocation", checkpoint)
        .foreachBatch(write)
        .trigger(availableNow=True)
        .start()
    )


def collected_metrics(spark: SparkSession, path: str, ks: Sequence[int] = K_VALUES) -> DataFrame:
    """All metrics over everything collected so far."""
    return all_metrics(spark.read.parquet(path).drop("batch_id"), ks)


def log_metrics(metrics: DataFrame, path: str, checkpoint: str, prefix: str = "", compact_every: int = COMPACT_EVERY):
    """Append a stream of (metric, value) rows, with their ``step`` if they have one, to a metric log with best values so far.

    Without a ``step`` column the step is the batch's number. ``best`` is the best value among all rows that this stream
    brought in earlier batches, and of this batch up to the row's step; null for metrics without a better direction.
    Values that are NaN or null are logged and are never best.

    Rows lie below the stream's id, which its checkpoint keeps, and the batch's number. A batch that runs again reads the best
    values of the batches before it and replaces its own folders, so it changes nothing. Best values are extremes per
    metric, merged batch by batch; the log is never read for them. Every ``compact_every`` batches the folders become one;
    what a reader of the log may still read is removed one compaction later.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        own = f"{path.rstrip('/')}/query={_query_id(batch.sparkSession, checkpoint)}"
        step = F.col("step") if "step" in batch.columns else F.lit(batch_id)
        name = F.concat(F.lit(f"{prefix}/" if prefix else ""), F.col("metric"))
        rows = batch.select(name.alias("name"), step.cast("long").alias("step"), F.col("value").cast("double").alias("value"))
        rows = rows.withColumn("_known", F.when(~F.isnan("value"), F.col("value")))
        before = _best_until(batch.sparkSession, own, batch_id)
        extremes = {"_high": ("max", F.col("_known")), "_low": ("min", F.col("_known"))}
        ran = running(rows, ["name"], [asc("step"), asc("value")], extremes).join(before, "name", "left")
        best = progress.better_of(F.greatest("_high", "high"), F.least("_low", "low"))
        ran.select("name", "step", "value", best.alias("best")).write.mode("overwrite").parquet(f"{own}/batch={batch_id}")
        new = rows.groupBy("name").agg(F.max("_known").alias("high"), F.min("_known").alias("low"))
        _merged(before.unionByName(new)).write.mode("overwrite").parquet(f"{own}/bests={batch_id}")
        _remove(batch.sparkSession, [f for n, f in _folders(batch.sparkSession, own, "bests").items() if n < batch_id - 1])
        if (batch_id + 1) % compact_every == 0:
            _compact(batch.sparkSession, own, batch_id)

    return (
        metrics.writeStream.option("checkpointLocation", checkpoint)
        .foreachBatch(write)
        .trigger(availableNow=True)
        .start()
    )


def _query_id(spark: SparkSession, checkpoint: str) -> str:
    """The id of a stream, which stays the same over its restarts."""
    return spark.read.schema("id string").json(f"{checkpoint.rstrip('/')}/metadata").first()["id"]


def _merged(bests: DataFrame) -> DataFrame:
    return bests.groupBy("name").agg(F.max("high").alias("high"), F.min("low").alias("low"))


def _best_until(spark: SparkSession, own: str, batch_id: float = float("inf")) -> DataFrame:
    """Extremes per metric over the batches before ``batch_id`` of one stream."""
    found = {n: f for n, f in _folders(spark, own, "bests").items() if n < batch_id}
    if not found:
        return spark.createDataFrame([], BEST_SCHEMA)
    return spark.read.schema(BEST_SCHEMA).parquet(found[max(found)])


def _log_folders(spark: SparkSession, own: str) -> list[str]:
    """The newest base of one stream's log and the batches after it."""
    bases = _folders(spark, own, "base")
    last = max(bases, default=-1)
    return [*([bases[last]] if bases else []), *(f for n, f in _folders(spark, own, "batch").items() if n > last)]


def _compact(spark: SparkSession, own: str, batch_id: int) -> None:
    """Make one base of the last one before ``batch_id`` and the batches since; remove what the base before it replaced."""
    bases = {n: f for n, f in _folders(spark, own, "base").items() if n < batch_id}
    last = max(bases, default=-1)
    batches = _folders(spark, own, "batch")
    parts = [*([bases[last]] if bases else []), *(f for n, f in batches.items() if last < n <= batch_id)]
    spark.read.schema(LOG_SCHEMA).parquet(*parts).write.mode("overwrite").parquet(f"{own}/base={batch_id}")
    _remove(spark, [*(f for n, f in bases.items() if n < last), *(f for n, f in batches.items() if n <= last)])


def _streams(spark: SparkSession, path: str) -> list[str]:
    """Folders of the streams that wrote to a metric log."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    found = [s.getPath() for s in files.listStatus(root)] if files.exists(root) else []
    return [p.toString() for p in found if p.getName().startswith("query=")]


def read_metric_log(spark: SparkSession, path: str) -> DataFrame:
    """(name, step, value, best) of all streams that wrote to a metric log; empty if none did."""
    folders = [f for own in _streams(spark, path) for f in _log_folders(spark, own)]
    return spark.read.schema(LOG_SCHEMA).parquet(*folders) if folders else spark.createDataFrame([], LOG_SCHEMA)


def best_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Best value so far of every metric with a better direction, over all streams; reads no log rows."""
    bests = spark.createDataFrame([], BEST_SCHEMA)
    for own in _streams(spark, path):
        bests = bests.unionByName(_best_until(spark, own))
    best = progress.better_of(F.col("high"), F.col("low"))
    return _merged(bests).select("name", best.alias("best")).where("best is not null")


__all__ = [
    "append_metrics",
    "best_metrics",
    "collect_scores",
    "collected_metrics",
    "ingest_csv",
    "log_metrics",
    "read_metric_log",
]
