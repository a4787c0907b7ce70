import pytest
from pyspark.sql import functions as F

from feedforge.session import new_scratch_path
from feedforge.sources import logs


@pytest.fixture()
def folder(spark, tmp_path):
    (tmp_path / "tiny.csv").write_text(
        "uid,iid,click,like,watching_times,hist_1,hist_2,note\n"
        "1,10,1,\\N,7.9,4,0,a\n"
        "x,11,1,0,1,0,0,b\n"
        "2,12,,abc,,9,8,c\n"
        "1,13,0,1,2,,1,d\n"
    )
    return str(tmp_path)


def test_csv_log(spark, folder):
    rows = sorted(logs.load_scenario(spark, folder, "tiny").collect(), key=lambda r: r.row_id)
    assert [(r.user_id, r.item_id, r.ts_s, r.click, r.like) for r in rows] == [(1, 10, 0, 1, 0), (2, 12, 2, 0, 0), (1, 13, 3, 0, 1)]
    assert [r.watching_times for r in rows] == [7, 0, 2] and [r.reading_duration for r in rows] == [7.9, 0.0, 2.0]
    assert [r.hist_items for r in rows] == [[4, 0], [9, 8], [0, 1]] and all(r.age == 0 for r in rows)


def test_parquet_comes_first(spark, folder):
    logs.csv_to_parquet(spark, f"{folder}/tiny.csv", f"{folder}/tiny.parquet", "snappy")
    assert logs.resolve(spark, folder, "tiny") == ("parquet", f"{folder}/tiny.parquet")
    with pytest.raises(Exception):
        logs.csv_to_parquet(spark, f"{folder}/tiny.csv", f"{folder}/tiny.parquet")
    logs.csv_to_parquet(spark, f"{folder}/tiny.csv", f"{folder}/tiny.parquet", "gzip", overwrite=True)
    with pytest.raises(ValueError):
        logs.csv_to_parquet(spark, f"{folder}/tiny.csv", f"{folder}/other.parquet", "lzma")
    with pytest.raises(logs.SourceNotFound):
        logs.resolve(spark, folder, "absent")


def test_first_users(spark, folder):
    assert {r.user_id for r in logs.load_scenario(spark, folder, "tiny", 1).collect()} == {1}


def test_rows_are_numbered_in_file_order(spark):
    path = new_scratch_path(spark, "ordered")
    spark.range(10_000).repartitionByRange(7, "id").sortWithinPartitions("id").write.parquet(path)
    numbered = logs.number_rows(spark.read.parquet(path))
    assert numbered.where(F.col("row_id") != F.col("id")).count() == 0
    assert "Exchange hash" not in numbered.select("id", "row_id")._jdf.queryExecution().executedPlan().toString().split("BroadcastExchange")[0]


def test_rows_are_numbered_across_splits_of_one_file(spark):
    path = new_scratch_path(spark, "one-file")
    rows = spark.range(200_000).select("id", F.xxhash64("id").alias("noise")).coalesce(1)
    rows.write.option("parquet.block.size", 200_000).parquet(path)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 150_000)
    try:
        scan = spark.read.parquet(path)
        assert scan.rdd.getNumPartitions() > 3
        assert logs.number_rows(scan).where(F.col("row_id") != F.col("id")).count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
