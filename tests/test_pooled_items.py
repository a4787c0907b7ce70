"""Vectors of a large item table reach histories without moving steps or sums, with the plain results."""

import random

import pytest
from pyspark.sql import functions as F

from feedforge.operators import retrieval

DIM = 3


def data(spark):
    rng = random.Random(3)
    histories = [(i % 90 if i % 97 else None, [rng.randrange(-1, 60) for _ in range(rng.randrange(6))]) for i in range(200)]
    histories += [(500, None), (501, [None, 7]), (502, [])]
    vectors = [(i % 55, [rng.random() for _ in range(DIM)]) for i in range(70)] + [(8, None), (9, [1.0])]
    far = spark.range(1000, 60_000).select(F.col("id").alias("item_id"), F.array(*[F.rand(i).cast("float") for i in range(DIM)]).alias("vector"))
    items = spark.createDataFrame(vectors, "item_id long, vector array<float>")
    return histories, items, spark.createDataFrame(histories, "row_id long, hist_items array<long>"), items.union(far)


def plain(histories, items, decay):
    totals = {}
    for key, history in histories:
        for at, item in enumerate(history or []):
            for vector in (v for i, v in items if i == item and item > 0) if item is not None else ():
                total, sums = totals.setdefault(key, [0.0, [None] * DIM])
                w = decay**at
                totals[key][0] = total + w
                for d, x in enumerate((vector or [])[:DIM]):
                    sums[d] = (sums[d] or 0.0) + w * x
    return {k: [s and s / total for s in sums] for k, (total, sums) in totals.items()}


@pytest.mark.parametrize("round_bytes", [1 << 20, 2000, 100])
def test_pooling_by_broadcast_rounds_equals_plain_sums(spark, round_bytes):
    histories, items, df, everything = data(spark)
    out = retrieval.pooled_vectors(df, everything, "row_id", decay=0.9, dim=DIM, round_bytes=round_bytes)
    want = plain(histories, [tuple(r) for r in items.collect()], 0.9)
    got = {r.row_id: r.vector for r in out.collect()}
    assert got.keys() == want.keys()
    assert all(g == pytest.approx(w) for k, v in want.items() for g, w in zip(got[k], v) if w is not None)
    assert all((g is None) == (w is None) for k, v in want.items() for g, w in zip(got[k], v))


def test_only_ids_travel_whatever_the_size_of_the_item_table(spark):
    _, _, df, everything = data(spark)
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")  # as where the table is too large for Spark to broadcast
    try:
        plan = retrieval.pooled_vectors(df, everything, "row_id", decay=0.9, dim=DIM)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(name, before)
    assert "SortMergeJoin" not in plan and plan.count("Exchange hashpartitioning") == 1
