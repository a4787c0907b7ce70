import glob
import os
import shutil
import time

import pytest
from pyspark.sql import functions as F

from feedforge.session import new_scratch_path
from feedforge.sources import logs, tables
from feedforge.streaming import feeds


def _ids(spark, name, rows=1000, files=5):
    path = new_scratch_path(spark, name)
    spark.range(rows).repartitionByRange(files, "id").write.parquet(path)
    return path


def test_manifest_tells_changes_of_files(spark):
    path = _ids(spark, "manifest")
    key = lambda: tables.evaluation_key(path, "plain", "val", 4, 42)
    first = key()
    assert first["files"] == 5 and first == key() and first != tables.evaluation_key(path, "plain", "val", 4, 42, length=1)
    file = sorted(glob.glob(f"{path}/*.parquet"))[0]
    os.utime(file, (time.time() + 60, time.time() + 60))
    touched = key()
    assert touched["bytes"] == first["bytes"] and touched != first
    spark.range(3).coalesce(1).write.mode("append").parquet(path)
    assert key()["files"] == 6
    with pytest.raises(Exception):
        tables.evaluation_key(f"{path}-absent", "plain", "val", 4, 42)


def test_changed_file_rebuilds_and_rows_are_not_scanned(spark):
    path, folder = _ids(spark, "source"), new_scratch_path(spark, "evaluation")
    built = []

    def build():
        built.append(1)
        return spark.read.parquet(path).select(F.col("id").alias("sample_id"))

    def count():
        return tables.evaluation_table(spark, folder, tables.evaluation_key(path, "plain", "val", 4, 42), build).count()

    assert count() == 1000 and count() == 1000 and len(built) == 1
    plan = tables.source_files(spark, path)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<path" in plan and "content" not in plan
    spark.range(1000, 1010).coalesce(1).write.mode("append").parquet(path)
    assert count() == 1010 and len(built) == 2


def test_unfinished_build_is_not_used(spark):
    folder = new_scratch_path(spark, "evaluation")
    key = {"a": 1}

    def fail():
        return spark.range(10).select(F.raise_error(F.lit("stop")).cast("long").alias("id"))

    with pytest.raises(Exception):
        tables.evaluation_table(spark, folder, key, fail)
    assert tables.evaluation_table(spark, folder, key, lambda: spark.range(7)).count() == 7


@pytest.mark.parametrize("shuffle", [False, True])
def test_batches_are_read_from_their_files_only(spark, shuffle):
    log = spark.range(1003).select(F.col("id").alias("row_id"), F.xxhash64("id").alias("noise"))
    path = new_scratch_path(spark, "batches")
    batched = tables.with_batches(log, 10, shuffle=shuffle, epoch=1)
    tables.write_batches(batched, path, 8)
    assert len(glob.glob(f"{path}/rows/*.parquet")) == 13 and not glob.glob(f"{path}/rows/*=*")
    part = tables.read_batches(spark, path, 20, 29)
    assert len(part.inputFiles()) == 2
    want = {(r.row_id, r.batch_id, r.batch_pos) for r in batched.where("batch_id between 20 and 29").collect()}
    assert {(r.row_id, r.batch_id, r.batch_pos) for r in part.collect()} == want and len(want) == 100
    places = {r.batch_id: r for r in tables.batch_places(spark, path).collect()}
    assert set(places) == set(range(101)) and places[100].rows == 3
    assert all(p.first_row == b % 8 * 10 for b, p in places.items())
    in_file = spark.read.parquet(f"{path}/rows").select("batch_id", "batch_pos", "_metadata.file_name", "_metadata.row_index")
    assert all(r.row_index == places[r.batch_id].first_row + r.batch_pos and r.file_name == places[r.batch_id].file for r in in_file.collect())
    assert tables.read_batches(spark, path, 200, 300).count() == 0 and tables.read_batches(spark, path).count() == 1003


def test_no_batches(spark):
    path = new_scratch_path(spark, "batches")
    empty = spark.range(0).select(F.col("id").alias("row_id"))
    tables.write_batches(tables.with_batches(empty, 10), path)
    assert tables.read_batches(spark, path).count() == 0 and tables.read_batches(spark, path, 0, 3).count() == 0


@pytest.mark.parametrize("limit", [0, 1 << 20])
def test_row_numbers_with_and_without_broadcast(spark, limit):
    path = _ids(spark, "numbered")
    numbered = logs.number_rows(spark.read.parquet(path), broadcast_rows=limit)
    assert numbered.where("row_id = id").count() == 1000


def test_changed_file_fails_and_loses_nothing(spark):
    path = _ids(spark, "numbered")
    numbered = logs.number_rows(spark.read.parquet(path))
    file = sorted(glob.glob(f"{path}/*.parquet"))[2]
    other = _ids(spark, "other", 50, 1)
    shutil.copy(glob.glob(f"{other}/*.parquet")[0], file)
    with pytest.raises(Exception):
        numbered.write.format("noop").mode("overwrite").save()


def test_split_plan_of_csv_changes(spark):
    path = new_scratch_path(spark, "csv")
    spark.range(30_000).coalesce(1).write.csv(path)
    name, before = "spark.sql.files.maxPartitionBytes", spark.conf.get("spark.sql.files.maxPartitionBytes")
    read = lambda: spark.read.schema("id long").csv(path)
    try:
        spark.conf.set(name, 20_000)
        assert read().rdd.getNumPartitions() > 3
        numbered = logs.number_rows(read())
        assert numbered.where("row_id = id").count() == 30_000
        again = logs.number_rows(read())
        spark.conf.set(name, 50_000)
        with pytest.raises(Exception, match="changed after"):
            again.select("row_id").write.format("noop").mode("overwrite").save()
    finally:
        spark.conf.set(name, before)


def _run(spark, source, path, checkpoint, every=20, schema="metric string, step long, value double"):
    stream = spark.readStream.schema(schema).json(source)
    feeds.log_metrics(stream, path, checkpoint, "val", every).awaitTermination()


def _add(source, n, lines):
    os.makedirs(source, exist_ok=True)
    with open(f"{source}/{n}.json", "w") as file:
        file.write("\n".join(lines))


def _line(metric, step, value):
    return f'{{"metric": "{metric}", "step": {step}, "value": {value}}}'


def test_streamed_log_has_best_values_and_replays(spark):
    source, path, checkpoint = (new_scratch_path(spark, n) for n in ("lines", "log", "checkpoint"))
    batches = [
        [_line("auc", 1, 0.5), _line("auc", 2, 0.7), _line("loss", 1, 3.0), _line("other", 1, 1.0)],
        [_line("auc", 3, 0.6), _line("loss", 2, 2.0), _line("loss", 3, 2.5), _line("auc", 4, "null")],
        [_line("auc", 5, 0.9), _line("loss", 4, 4.0)],
    ]
    for n, lines in enumerate(batches):
        _add(source, n, lines)
        _run(spark, source, path, checkpoint, 2)
    state = lambda: sorted((r.name, r.step, r.value, r.best) for r in feeds.read_metric_log(spark, path).collect())
    want = [
        ("val/auc", 1, 0.5, 0.5), ("val/auc", 2, 0.7, 0.7), ("val/auc", 3, 0.6, 0.7), ("val/auc", 4, None, 0.7), ("val/auc", 5, 0.9, 0.9),
        ("val/loss", 1, 3.0, 3.0), ("val/loss", 2, 2.0, 2.0), ("val/loss", 3, 2.5, 2.0), ("val/loss", 4, 4.0, 2.0),
        ("val/other", 1, 1.0, None),
    ]
    assert state() == want
    assert {r.name: r.best for r in feeds.best_metrics(spark, path).collect()} == {"val/auc": 0.9, "val/loss": 2.0}
    # The last batch runs again, as after a failure between its write and its commit.
    for file in glob.glob(f"{checkpoint}/commits/*2*"):
        os.remove(file)
    for file in glob.glob(f"{checkpoint}/commits/.*2*"):
        os.remove(file)
    _run(spark, source, path, checkpoint, 2)
    assert state() == want
    assert {r.name: r.best for r in feeds.best_metrics(spark, path).collect()} == {"val/auc": 0.9, "val/loss": 2.0}
    # Another stream into the same log keeps rows of its own.
    other, second = new_scratch_path(spark, "lines"), new_scratch_path(spark, "checkpoint")
    _add(other, 0, [_line("auc", 9, 0.95), _line("loss", 9, "NaN")])
    _run(spark, other, path, second)
    assert len(state()) == len(want) + 2
    assert {r.name: r.best for r in feeds.best_metrics(spark, path).collect()} == {"val/auc": 0.95, "val/loss": 2.0}


def test_compaction_leaves_few_folders(spark):
    source, path, checkpoint = (new_scratch_path(spark, n) for n in ("lines", "log", "checkpoint"))
    for n in range(7):
        _add(source, n, [_line("auc", n, n / 10)])
        _run(spark, source, path, checkpoint, 2)
    assert sorted(r.step for r in feeds.read_metric_log(spark, path).collect()) == list(range(7))
    (own,) = glob.glob(f"{path}/query=*")
    assert sorted(os.path.basename(f) for f in glob.glob(f"{own}/*")) == [
        "base=3", "base=5", "batch=4", "batch=5", "batch=6", "bests=5", "bests=6",
    ]


def test_log_without_steps_and_without_streams(spark):
    source, path, checkpoint = (new_scratch_path(spark, n) for n in ("lines", "log", "checkpoint"))
    assert feeds.read_metric_log(spark, path).count() == 0 and feeds.best_metrics(spark, path).count() == 0
    for n in range(2):
        _add(source, n, ['{"metric": "mrr", "value": 0.25}'])
        _run(spark, source, path, checkpoint, schema="metric string, value double")
    assert sorted((r.step, r.best) for r in feeds.read_metric_log(spark, path).collect()) == [(0, 0.25), (1, 0.25)]
