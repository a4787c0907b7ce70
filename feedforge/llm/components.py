"""Connected components of a table of links, by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedforge.session import written


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``label`` (smallest node it is connected to) for every node of ``links`` (a long, b long).

    Alternating star operations: each node's larger neighbours are linked to its smallest neighbour, then each node's
    smaller neighbours and itself are. Every round writes its links to the shared folder, so lineage stays short. The
    neighbour minimum is aggregated before the join, so a node with many links is not gathered anywhere. No links give
    no rows.
    """
    edges = written(_distinct(links.select("a", "b")), "links")
    before = None
    while True:
        edges = written(_small_star(_large_star(edges)), "links")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("b").alias("node"), F.col("a").alias("label")).union(
        edges.select(F.col("a").alias("node"), F.col("a").alias("label")).distinct()
    )


def _distinct(pairs: DataFrame) -> DataFrame:
    """Links as (smaller, larger), once each, without loops."""
    return pairs.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
    return _distinct(both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b")))


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("b").agg(F.min("a").alias("least"))
    joined = edges.join(least, "b")
    return _distinct(
        joined.select("a", F.col("least").alias("b")).union(joined.select(F.col("b").alias("a"), F.col("least").alias("b")))
    )
