"""Token files: offsets over many blocks, and reads by document id that skip stripes and row groups."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from feedforge.llm import token_files


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    """20 000 documents with even ids, the last ones first."""
    path = str(tmp_path_factory.mktemp("ids") / "orc")
    docs = spark.range(20000).select((2 * (19999 - F.col("id"))).alias("doc_id"), F.concat(F.lit("some words of text "), "id").alias("text"))
    token_files.write_token_files(docs, path, public_tokenizers.path("word_bpe_49k.json"), block_bytes=60000)
    return path


def rows_read(df):
    """Rows that the ORC scan of ``df`` handed on, and the result's rows."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        execution = df._jdf.queryExecution()
        found = execution.executedPlan().executeCollectPublic()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    plan = execution.executedPlan()
    while plan.children().nonEmpty():
        plan = plan.children().head()
    return plan.metrics().apply("numOutputRows").value(), len(found)


def test_reads_by_id_skip_row_groups(spark, files):
    rows = spark.read.schema(token_files.SCHEMA).orc(files)
    assert rows_read(rows.select("doc_id")) == (20000, 20000)
    read, found = rows_read(rows.where("doc_id = 20000").select("doc_id"))
    assert found == 1 and read <= token_files.ROW_INDEX_STRIDE
    read, found = rows_read(rows.where("doc_id BETWEEN 300 AND 310").select("doc_id"))
    assert found == 6 and read <= 2 * token_files.ROW_INDEX_STRIDE


def test_bloom_filters_skip_absent_ids(spark, files):
    """Odd ids lie within the statistics of a row group, so only the Bloom filter can exclude them."""
    rows = spark.read.schema(token_files.SCHEMA).orc(files)
    read = [rows_read(rows.where(f"doc_id = {2 * n + 1}").select("doc_id"))[0] for n in range(100, 20000, 1990)]
    assert sum(n > 0 for n in read) <= 1


@pytest.mark.parametrize("most, span", [(1 << 20, 4096), (0, 2)])
def test_starts(spark, files, monkeypatch, most, span):
    monkeypatch.setattr(token_files, "BROADCAST_KEYS", most)
    monkeypatch.setattr(token_files, "SPAN", span)
    at = 0
    rows = token_files.read_token_files(spark, files).select("doc_id", "start", "n_tokens", "block").orderBy("doc_id").collect()
    assert [r.doc_id for r in rows] == list(range(0, 40000, 2)) and len({r.block for r in rows}) > 4
    for row in rows:
        assert row.start == at
        at += row.n_tokens


def test_offsets_move_no_token_arrays(spark, files):
    plan = token_files.read_token_files(spark, files)._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan
