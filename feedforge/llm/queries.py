"""Registered queries of this subpackage, with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from feedforge.llm import (
    decontamination,
    hyperminhash,
    language_model,
    licenses,
    packing,
    pii,
    quality,
    repeats,
    similarity,
    token_files,
    vector_codes,
    warc,
    whitening,
)
from feedforge.session import new_scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            SQL[function.__name__] = sql
        return function

    return add


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@query(quality.ORACLE_SQL)
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base verdict and adaptive verdict per document."""
    return quality.scores(documents(spark, sf_dir))


@query()
def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids written as ORC and read back."""
    path = new_scratch_path(spark, "token-files")
    token_files.write_token_files(documents(spark, sf_dir), path, public_tokenizers.path("word_bpe_49k.json"))
    return token_files.token_digests(token_files.read_token_files(spark, path))


@query()
def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 2048 ids."""
    return packing.piece_digests(packing.pack_bytes(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json")))


@query()
def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size and component of linked texts per document."""
    return similarity.similar_texts(documents(spark, sf_dir))


@query()
def op5_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram and maximum-entropy scores per document."""
    return language_model.scores(documents(spark, sf_dir))


@query()
def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items found in documents."""
    found = decontamination.contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.drop("row")


@query()
def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data per document: counts and digest of the fixed patterns, and all spans."""
    return pii.personal_data(documents(spark, sf_dir))


@query()
def op10_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words removed as repeats per document, with a digest of the rest."""
    return repeats.removal_digests(documents(spark, sf_dir))


@query(licenses.ORACLE_SQL)
def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known licence texts in documents."""
    return licenses.licensed(documents(spark, sf_dir))


@query(warc.ORACLE_SQL)
def op8_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata and conversion records of pages, written as WARC and read back."""
    return warc.round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"), new_scratch_path(spark, "warc"))


@query()
def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened components of embeddings, with the share of variance of each."""
    return whitening.whitened(embeddings(spark, sf_dir))


@query(vector_codes.ORACLE_SQL)
def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of embeddings, their errors and a digest of the codebooks."""
    return vector_codes.vector_codes(embeddings(spark, sf_dir))


@query()
def op13_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size, component and verdict per document, by sketches of word pairs."""
    return hyperminhash.near_duplicates(documents(spark, sf_dir))
