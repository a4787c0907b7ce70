"""Tables the engine writes and reads back."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedforge.functions.draws import mix
from feedforge.operators.index import shuffled_index
from feedforge.operators.segments import asc, row_number

EVALUATION_VERSION = 5
# Batches of one file, and of one file of the manifest.
BATCHES_PER_FILE = 1024
BATCHES_PER_MANIFEST = 1 << 20


def write_split(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Interactions with ``split``, one folder per part."""
    df.write.mode(mode).partitionBy("split").parquet(path)


def read_split(spark: SparkSession, path: str, part: str | None = None) -> DataFrame:
    """A split table, or one part of it by partition pruning."""
    df = spark.read.parquet(path)
    return df if part is None else df.where(F.col("split") == part)


def fingerprint(df: DataFrame) -> dict[str, int]:
    """Row count and order-free content sum of a table."""
    content = F.sum(F.pmod(F.xxhash64(*df.columns), F.lit(1 << 31)))
    row = df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(content, F.lit(0)).alias("content")).first()
    return {"rows": row["rows"], "content": row["content"]}


def source_files(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """(path, length, modified) of the data files at and below ``paths``; no file is opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    files = files.load([paths] if isinstance(paths, str) else list(paths))
    return files.select("path", "length", F.col("modificationTime").alias("modified"))


def manifest_fingerprint(spark: SparkSession, paths: str | Sequence[str]) -> dict[str, int | str]:
    """What tells whether files were added, removed, replaced or changed: number, bytes and an order-free digest.

    It reads names, lengths and times, never rows. The digest is two sums of 64-bit hashes of (path, length, time).
    """
    files = source_files(spark, paths)
    digest = [F.sum(F.xxhash64(F.lit(i), *files.columns).cast("decimal(20,0)")).cast("string") for i in range(2)]
    row = files.agg(
        F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"), F.array(*digest).alias("digest")
    ).first()
    return {"files": row["files"], "bytes": row["bytes"], "digest": ":".join(str(d) for d in row["digest"])}


def evaluation_key(
    source: DataFrame | str | Sequence[str],
    scenario: str,
    split: str,
    num_negatives: int,
    seed: int,
    **parameters: object,
) -> dict[str, object]:
    """What an evaluation table depends on, its input data included.

    Give ``source`` as the paths of the log's files: then an unchanged log is recognised by its files, without a scan. A
    DataFrame has no files to go by, so all of its rows are hashed. ``parameters`` are all others that the rows depend on.
    """
    derived = isinstance(source, DataFrame)
    content = fingerprint(source) if derived else manifest_fingerprint(SparkSession.active(), source)
    return {
        **parameters,
        "version": EVALUATION_VERSION,
        "scenario": scenario,
        "split": split,
        "num_negatives": num_negatives,
        "seed": seed,
        **content,
    }


def evaluation_table(
    spark: SparkSession, folder: str, key: Mapping[str, object], build: Callable[[], DataFrame]
) -> DataFrame:
    """The stored table of a key, built first when it is missing or unfinished.

    Every key has its own folder and every build a folder of rows in it. The metadata names the rows and is written
    after them, so rows of a build that failed, or of one that ran at the same time, are not mixed in.
    """
    text = json.dumps(key, sort_keys=True)
    base = f"{folder.rstrip('/')}/key={hashlib.sha256(text.encode()).hexdigest()[:16]}"
    meta = f"{base}/meta"
    rows = _stored_rows(spark, meta, text)
    if rows is None:
        rows = f"rows-{uuid.uuid4().hex}"
        build().write.parquet(f"{base}/{rows}")
        stored = spark.range(1).select(F.lit(text).alias("key"), F.lit(rows).alias("rows"))
        stored.write.mode("overwrite").parquet(meta)
    return spark.read.parquet(f"{base}/{rows}")


def _stored_rows(spark: SparkSession, path: str, text: str) -> str | None:
    """The folder of rows that the metadata names, or None if they are of another key or there is no metadata."""
    try:
        row = spark.read.parquet(path).first()
    except AnalysisException:
        return None
    return row["rows"] if row is not None and row["key"] == text else None


def with_batches(
    df: DataFrame, batch_size: int, shuffle: bool = True, epoch: int = 0, seed: int = 42, drop_last: bool = False
) -> DataFrame:
    """Add ``batch_id`` and the place in the batch.

    With ``shuffle`` the order is a hash of epoch and row, else the row order.
    ``drop_last`` leaves out a short last batch.
    """
    if shuffle:
        placed = shuffled_index(df, "row_id", seed + epoch, "_place")
    else:
        placed = row_number(df, [], [asc("row_id")], "_place").withColumn("_place", F.col("_place") - 1)
    size = F.lit(batch_size).cast("bigint")
    placed = placed.withColumn("batch_id", F.floor(F.col("_place") / size)).withColumn(
        "batch_pos", F.pmod("_place", size)
    )
    if drop_last:
        rows = df.agg(F.count(F.lit(1)).alias("n")).scalar()
        placed = placed.where(F.col("batch_id") < F.floor(rows / size))
    return placed.drop("_place")


def write_batches(
    df: DataFrame, path: str, batches_per_file: int = BATCHES_PER_FILE, mode: str = "errorifexists"
) -> None:
    """Batched rows in training order, ``batches_per_file`` batches in each file, and a manifest of where batches lie.

    A batch's number gives its task, so no range is sampled, no two files share a batch and a task that runs again makes the
    same file. Choose ``batches_per_file`` so that a file holds some hundred MB. The manifest has a row per batch with its
    file, first row and number of rows; it is sorted, so a lookup reads few of its row groups, and is written last.
    """
    spark = df.sparkSession
    last = df.agg(F.max("batch_id")).first()[0]
    by_file = _by_number(df, last, batches_per_file)
    by_file.sortWithinPartitions("batch_id", "batch_pos").write.mode(mode).parquet(f"{path}/rows")
    stored = spark.read.parquet(f"{path}/rows")
    places = stored.select(
        "batch_id", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("at")
    )
    manifest = places.groupBy("batch_id", "file").agg(F.min("at").alias("first_row"), F.count(F.lit(1)).alias("rows"))
    sorted_rows = _by_number(manifest, last, BATCHES_PER_MANIFEST).sortWithinPartitions("batch_id")
    sorted_rows.write.mode(mode).parquet(f"{path}/manifest")


def _by_number(df: DataFrame, last: int | None, width: int) -> DataFrame:
    """One partition per ``width`` successive batches up to the ``last``."""
    files = 1 if last is None else last // width + 1
    return df.repartitionById(files, F.floor(F.col("batch_id") / F.lit(width)).cast("int"))


def batch_places(spark: SparkSession, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """(batch_id, file, first_row, rows) of written batches, of those from ``first`` to ``last`` if given."""
    return _between(spark.read.parquet(f"{path}/manifest"), first, last)


def read_batches(spark: SparkSession, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """Written batches, of those from ``first`` to ``last`` if given; only files that hold one of these are opened.

    The names of these files pass through the driver: at most one per batch asked for. Rows of a file are in training
    order; order by (batch_id, batch_pos) to read several files in order.
    """
    if first is None and last is None:
        return spark.read.parquet(f"{path}/rows")
    files = batch_places(spark, path, first, last).select("file").distinct().collect()
    found = [f"{path}/rows/{r['file']}" for r in files]
    return _between(spark.read.parquet(*(found or [f"{path}/rows"])), first, last)


def _between(df: DataFrame, first: int | None, last: int | None) -> DataFrame:
    if first is not None:
        df = df.where(F.col("batch_id") >= first)
    return df if last is None else df.where(F.col("batch_id") <= last)


def epoch_order(df: DataFrame, epoch: int, seed: int = 42) -> DataFrame:
    """Add the sort key of an epoch."""
    return df.withColumn("order_key", mix(F.col("row_id"), seed + epoch))


def append_metrics(metrics: DataFrame, path: str, step: int, prefix: str = "") -> None:
    """Append (metric, value) rows to a metric log under ``prefix/metric``."""
    name = F.concat(F.lit(f"{prefix}/" if prefix else ""), F.col("metric"))
    metrics.select(name.alias("name"), F.lit(step).cast("bigint").alias("step"), "value").write.mode(
        "append"
    ).parquet(path)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """The metric log."""
    return spark.read.parquet(path)
