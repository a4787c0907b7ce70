"""Operators that remove rows take the right ones, however their input comes about and whatever its columns are called."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from feedforge.llm import decontamination, exchange, quality, similarity

CLASHES = ("its_row", "quality_of", "kept", "key", "key_of_row", "in_doubt", "its_columns")
SHAPES = {
    "plain": lambda df: df,
    "repartition": lambda df: df.repartition(7),
    "by_key": lambda df: df.repartition(5, "lang"),
    "dropDuplicates": lambda df: df.dropDuplicates(["doc_id"]),
    "groupBy": lambda df: df.groupBy("doc_id").agg(*(F.first(f"`{c}`").alias(c) for c in df.columns if c != "doc_id")).select(*(f"`{c}`" for c in df.columns)),
}


def rows_of(df):
    return Counter(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def tables(spark):
    sf = "/root/testdata/sf0.01"
    return spark.read.parquet(f"{sf}/documents.parquet").withColumns({n: F.lit(f'own {n}') for n in CLASHES}), spark.read.parquet(f"{sf}/benchmark.parquet")


@pytest.fixture(scope="module")
def expected(tables):
    docs, benchmark = tables
    texts = {r.doc_id: r.text for r in docs.collect()}
    bad = {r.doc_id for r in decontamination.contaminated(docs, benchmark).collect()}
    groups = similarity.similar_texts(docs).collect()
    first = {r.doc_id for r in groups if r.n_shingles == 0 or r.doc_id == r.component_id}
    kept = {r.doc_id for r in quality.scores(docs).collect() if r.kept}
    assert 0 < len(bad) < len(texts) and 0 < len(first) < len(texts) and 0 < len(kept) < len(texts)
    return {"bad": set(texts) - bad, "first": first, "kept": kept}


@pytest.mark.parametrize("keys", [1 << 20, 0])
@pytest.mark.parametrize("shape", SHAPES)
def test_the_right_rows_go(tables, expected, shape, keys, monkeypatch):
    monkeypatch.setattr(exchange, "BROADCAST_KEYS", keys)
    docs, benchmark = (t.withColumn("a.b", F.lit(1)) for t in tables)
    every = rows_of(docs)
    shaped = SHAPES[shape](docs)
    for name, left in (
        ("bad", decontamination.clean_documents(shaped, benchmark)),
        ("first", similarity.one_of_each_group(shaped)),
        ("kept", quality.kept_documents(shaped)),
    ):
        assert left.columns == docs.columns
        got = rows_of(left)
        assert set(got) <= set(every), name
        at = docs.columns.index("doc_id")
        assert sorted(r[at] for r in got.elements()) == sorted(expected[name]), name


@pytest.mark.parametrize("keys", [1 << 20, 0])
def test_one_row_of_each_group_by_row(spark, keys, monkeypatch):
    """Ids that repeat, with equal and with other texts, and rows without an id."""
    monkeypatch.setattr(exchange, "BROADCAST_KEYS", keys)
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    near = b.replace("b3 ", "other ")
    rows = [(7, a, 1), (7, a, 2), (7, b, 3), (3, near, 4), (None, c, 5), (None, c, 6), (9, None, 7), (9, None, 8), (9, "", 9), (None, a, 10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int")
    for shaped in (docs, docs.repartition(4)):
        got = sorted(r.n for r in similarity.one_of_each_group(shaped).collect())
        assert len(got) == 6 and got[0] in (1, 2) and got[1] == 4 and got[2] in (5, 6) and got[3:] == [7, 8, 9]


def test_pipeline_stages_keep_columns(spark, tables):
    docs, _ = tables
    few = spark.createDataFrame(docs.orderBy("doc_id").limit(300).collect(), docs.schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, few, "/root/testdata/sf0.01")
        assert left.columns == docs.columns, name
        assert set(rows_of(left)) <= set(rows_of(few)) or name == "PII"
