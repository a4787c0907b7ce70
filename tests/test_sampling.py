import pytest
from pyspark.sql import functions as F

from feedforge.functions.draws import mix, point
from feedforge.operators import sampling


@pytest.fixture(scope="module")
def world(spark):
    """User 1 has few positives, user 2 nearly all, user 3 every item, user 4 none."""
    items = spark.range(1, 201).select(F.col("id").alias("item_id")).persist()
    positives = [(1, i) for i in range(1, 6)] + [(2, i) for i in range(1, 199)] + [(3, i) for i in range(1, 201)]
    positives = spark.createDataFrame(positives, "user_id long, item_id long").persist()
    samples = spark.createDataFrame([(10 * u + j, u) for u in (1, 2, 3, 4) for j in range(5)], "sample_id long, user_id long").persist()
    known = {}
    for r in positives.collect():
        known.setdefault(r.user_id, set()).add(r.item_id)
    return samples, positives, items, known


def _by_sample(df):
    return {r.sample_id: (r.user_id, list(r.negatives)) for r in df.collect()}


def test_uniform_negatives(world):
    samples, positives, _, known = world
    found = _by_sample(sampling.uniform_negatives(samples, positives, 201, 6, 1))
    assert len(found) == 20
    for user, items in found.values():
        assert len(items) <= 6 and not set(items) & known.get(user, set()) and all(0 <= i < 201 for i in items)
        if user in (1, 4):
            assert len(items) == 6


def test_pool_negatives(world):
    samples, positives, items, known = world
    found = _by_sample(sampling.pool_negatives(samples, positives, items, 6, 1))
    assert len(found) == 20
    for user, picked in found.values():
        if user == 3:
            assert picked == []
        elif user == 2:
            assert len(picked) == 6 and set(picked) <= {199, 200}
        else:
            assert len(set(picked)) == 6 and not set(picked) & known.get(user, set())


def test_pool_negatives_of_dense_users_in_a_large_pool(spark):
    """The walk ends before the pool does; the difference supplies the rest."""
    items = spark.range(1, 5001).select(F.col("id").alias("item_id"))
    positives = spark.range(1, 4991).select(F.lit(7).cast("bigint").alias("user_id"), F.col("id").alias("item_id"))
    samples = spark.range(12).select(F.col("id").alias("sample_id"), F.lit(7).cast("bigint").alias("user_id"))
    for hot_rows in (5_000_000, 2):
        found = _by_sample(sampling.pool_negatives(samples, positives, items, 4, 3, hot_rows))
        assert len(found) == 12
        for _, picked in found.values():
            assert len(set(picked)) == 4 and set(picked) <= set(range(4991, 5001))


def test_pool_negatives_of_an_empty_pool(world):
    samples, positives, items, _ = world
    found = _by_sample(sampling.pool_negatives(samples, positives, items.limit(0), 3))
    assert len(found) == 20 and all(picked == [] for _, picked in found.values())


def test_slot_negatives(world):
    samples, positives, items, known = world
    found = _by_sample(sampling.slot_negatives(samples, positives, items, 6, 1))
    assert len(found) == 20
    for user, picked in found.values():
        assert len(picked) == 6
        if user in (1, 4):
            assert not set(picked) & known.get(user, set())


def test_popularity_negatives_follow_weights(spark):
    frequencies = spark.createDataFrame([(1, 10_000), (2, 1), (3, 0)], "item_id long, frequency long")
    positives = spark.createDataFrame([(9, 1)], "user_id long, item_id long")
    samples = spark.range(400).select(F.col("id").alias("sample_id"), F.lit(5).cast("bigint").alias("user_id"))
    found = sampling.exploded(sampling.popularity_negatives(samples, positives, frequencies, 5, seed=2))
    counts = {r.item_id: r["count"] for r in found.groupBy("item_id").count().collect()}
    assert sum(counts.values()) == 2000 and 3 not in counts and counts[1] > 1900
    mine = samples.withColumn("user_id", F.lit(9).cast("bigint"))
    left = sampling.exploded(sampling.popularity_negatives(mine, positives, frequencies, 5, seed=2))
    assert {r.item_id for r in left.collect()} <= {2}


def test_popularity_without_weights(spark):
    frequencies = spark.createDataFrame([(1, 0)], "item_id long, frequency long")
    positives = spark.createDataFrame([], "user_id long, item_id long")
    samples = spark.createDataFrame([(1, 1)], "sample_id long, user_id long")
    assert _by_sample(sampling.popularity_negatives(samples, positives, frequencies, 5)) == {1: (1, [])}


def test_filled_negatives(world):
    samples, positives, items, known = world
    found = _by_sample(sampling.filled_negatives(samples, positives, items, 6, 1))
    assert all(len(picked) == 6 for _, picked in found.values())
    assert all(not set(picked) & known.get(u, set()) for u, picked in found.values() if u in (1, 4))


@pytest.mark.parametrize("sampler", [sampling.pool_negatives, sampling.slot_negatives, sampling.filled_negatives])
def test_samples_do_not_depend_on_partitions(world, sampler):
    samples, positives, items, _ = world
    one = _by_sample(sampler(samples.coalesce(1), positives.coalesce(1), items.coalesce(1), 6, 11))
    two = _by_sample(sampler(samples.repartition(5), positives.repartition(3), items.repartition(7), 6, 11))
    assert one == two
    assert one != _by_sample(sampler(samples, positives, items, 6, 12))


def test_next_prime():
    assert [sampling.next_prime(n) for n in (0, 2, 4, 100, 101, 200)] == [2, 2, 5, 101, 101, 211]


def test_ids_far_apart_draw_differently(spark):
    """Ids 2**31 - 1 apart, over the whole range of longs, have draws of their own."""
    ids = sorted({i * 2147483647 for i in range(-2000, 2000)} | {-(1 << 63), (1 << 63) - 1})
    df = spark.createDataFrame([(i,) for i in ids], "id long")
    rows = df.select(mix(F.col("id"), 1).alias("a"), point(F.col("id"), 1, 0, 1 << 62).alias("b")).collect()
    assert len({r.a for r in rows}) > 0.99 * len(ids) and len({r.b for r in rows}) == len(ids)
    assert all(0 <= r.b < 1 << 62 for r in rows)


def test_points_are_uniform(spark):
    for total in (1, 7, 10**18 + 9):
        df = spark.range(40_000).select(F.floor(point(F.col("id"), 5, F.col("id") % 3, total) / F.lit(total / 7.0)).alias("b"))
        counts = {r.b: r["count"] for r in df.groupBy("b").count().collect()}
        if total > 1:
            assert set(counts) == set(range(7)) and all(abs(n - 40_000 / 7) < 300 for n in counts.values())


def test_the_rarest_item_can_be_drawn(spark):
    """Shares of one in 10**10: the points of a rare item's range are hit as often as its share says."""
    steps = spark.range(0, 4_000_000, 1, 8)
    total, share = 10**17, 10**10
    hits = steps.select(point(F.col("id"), 3, 0, total).alias("p")).agg(
        *[F.count_if((F.col("p") >= i * (total // 50)) & (F.col("p") < i * (total // 50) + 1000 * share)).alias(f"n{i}") for i in range(50)]
    ).first()
    expected = 4_000_000 * 1000 * share / total * 50
    assert abs(sum(hits) - expected) < 6 * expected**0.5
    # a range of one unit: the draw that falls on it is found by the operator
    chosen = steps.limit(1).select(point(F.lit(0), 42, 0, 10**10 + 1).alias("p")).first().p
    assert 0 <= chosen <= 10**10


def test_popularity_draws_follow_the_weights(spark):
    frequencies = spark.createDataFrame([(1, 1), (2, 16), (3, 81), (4, 10**12)], "item_id long, frequency long")
    samples = spark.range(3000).select(F.col("id").alias("sample_id"), F.lit(9).cast("bigint").alias("user_id"))
    none = spark.createDataFrame([(9, 4)], "user_id long, item_id long")
    found = _by_sample(sampling.popularity_negatives(samples, none.limit(0), frequencies, 1))
    assert {i for _, items in found.values() for i in items} == {4}
    weights = frequencies.where("item_id < 4")
    drawn = [i for _, items in _by_sample(sampling.popularity_negatives(samples, none, weights, 1)).values() for i in items]
    for item, weight in ((1, 1), (2, 8), (3, 27)):
        assert abs(drawn.count(item) - 3000 * weight / 36) < 150
