import random

import pytest
from pyspark.sql import functions as F

from feedforge.functions.draws import PRIME, point, scaled
from feedforge.operators import retrieval, sampling


def tables(spark):
    """Users with few, many and no known items, repeated and null keys."""
    rng = random.Random(5)
    users = [1, 2, 3, 4, None]
    samples = [(i if i % 17 else None, rng.choice(users)) for i in range(60)] + [(5, 1), (5, 1), (6, 2), (6, 2)]
    known = [(1, i) for i in range(20)] + [(2, i) for i in range(0, 30, 2)] + [(3, 4), (3, 4), (None, 3), (4, None)]
    pool = [(i,) for i in range(24)]
    return (
        spark.createDataFrame(samples, "sample_id long, user_id long"),
        spark.createDataFrame(known, "user_id long, item_id long"),
        spark.createDataFrame(pool, "item_id long"),
    )


@pytest.mark.parametrize("sampler", ["uniform", "popularity", "pool", "slot", "filled"])
def test_users_of_many_known_items_get_the_same_draws(spark, monkeypatch, sampler):
    """Known items as arrays, item by item, or both."""
    samples, known, pool = tables(spark)
    run = {
        "uniform": lambda: sampling.uniform_negatives(samples, known, 24, 3),
        "popularity": lambda: sampling.popularity_negatives(samples, known, pool.withColumn("frequency", F.col("item_id") + 1), 3),
        "pool": lambda: sampling.pool_negatives(samples, known, pool, 3),
        "slot": lambda: sampling.slot_negatives(samples, known, pool, 3),
        "filled": lambda: sampling.filled_negatives(samples, known, pool, 3),
    }[sampler]
    found = []
    for most in (1_000, 16, 0):
        monkeypatch.setattr(sampling, "SET_ITEMS", most)
        rows = run().collect()
        mine = {}
        for r in known.collect():
            mine.setdefault(r.user_id, set()).add(r.item_id)
        if sampler in ("uniform", "popularity", "pool"):
            assert all(r.user_id is None or not mine.get(r.user_id, set()) & set(r.negatives) for r in rows)
        found.append(sorted((str(r.sample_id), str(r.user_id), r.negatives) for r in rows))
    assert found[0] == found[1] == found[2] and found[0]


def test_points_use_no_decimals(spark):
    """Whole numbers of 64 bits give floor(u x total / PRIME^2) at the ends of their range."""
    ends = [0, 1, 2, PRIME // 2, PRIME - 2, PRIME - 1]
    totals = [1, 2, PRIME - 1, PRIME, PRIME + 1, 1 << 62, (1 << 63) - 1]
    rows = [(a, b, t) for a in ends for b in ends for t in totals]
    df = spark.createDataFrame(rows, "a long, b long, t long")
    got = df.select("a", "b", "t", scaled(F.col("a"), F.col("b"), F.col("t")).alias("p")).collect()
    assert all(r.p == (r.a * r.t + r.b * r.t // PRIME) // PRIME for r in got)
    assert "decimal" not in str(point(F.col("a"), 1, 2, 10**18))


def test_pooling_moves_ids_and_no_sums(spark):
    """Histories are dealt once by key; the sums of their vectors stay where they are made."""
    histories = spark.createDataFrame([(1, [1, 2, 0]), (2, [2, 9]), (None, [1]), (2, [1]), (3, [9])], "row_id long, hist_items array<long>")
    items = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 6.0])], "item_id long, vector array<double>")
    pooled = retrieval.pooled_vectors(histories, F.broadcast(items), "row_id")
    plan = pooled._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert {r.row_id: r.vector for r in pooled.collect()} == {1: [2.0, 4.0], 2: [2.0, 4.0], None: [1.0, 2.0]}
