import random

import pytest
from pyspark.sql import functions as F

from feedforge.operators import index
from feedforge.operators.split import subsample, temporal_split


@pytest.fixture(scope="module")
def log(spark):
    rng = random.Random(3)
    rows = [(i, rng.randrange(20), 1_700_000_000 + rng.choice([0, 0, 0, 5, 90_000, 400_000]) + rng.randrange(4)) for i in range(1000)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "row_id long, user_id long, ts_s long").repartition(4).persist()


@pytest.mark.parametrize("small", [1_000_000, 10, 0])
def test_split_cuts_at_exact_positions(log, small, monkeypatch):
    monkeypatch.setattr(index, "SMALL", small)
    ordered = sorted((r.ts_s, r.row_id) for r in log.collect())
    parts = {}
    for r in temporal_split(log).collect():
        parts.setdefault(r.split, []).append((r.ts_s, r.row_id))
    assert sorted(parts["train"]) == ordered[:800]
    assert sorted(parts["val"]) == ordered[800:900]
    assert sorted(parts["test"]) == ordered[900:]


@pytest.mark.parametrize("bits", [1, 3, 10])
def test_wild_values_in_few_driver_rows(spark, monkeypatch, bits):
    """Values over the whole range of longs, constant ones, repeated keys and NULLs; the fan-out bounds every level."""
    rng = random.Random(bits)
    monkeypatch.setattr(index, "SMALL", 0)
    monkeypatch.setattr(index, "LEVEL_BITS", bits)
    wild = lambda: rng.choice([-(1 << 63), (1 << 63) - 1, 0, -1, 1 << 40, rng.randrange(-(1 << 63), 1 << 63), 7, 7, 7])
    rows = [(wild(), rng.randrange(3), wild()) for _ in range(300)]
    df = spark.createDataFrame([*rows, (None, 1, 1), (1, 1, None)], "a long, b long, c long").repartition(5)
    seen = []
    collect = type(df).collect
    monkeypatch.setattr(type(df), "collect", lambda self: seen.append(out := collect(self)) or out)
    want = sorted(rows)
    got = index.order_statistics(df, ["a", "b", "c"], {"0": lambda n: 0, "50": lambda n: n // 2, "end": lambda n: n - 1, "no": lambda n: n})
    assert got == {"0": want[0], "50": want[150], "end": want[-1], "no": None}
    assert max(map(len, seen)) <= 3 << bits


def test_log_without_timestamps(spark):
    df = spark.range(0, 5_000_000, 1, 8).select(F.col("id").alias("row_id"), F.col("id").alias("ts_s"))
    counts = {r.split: r["count"] for r in temporal_split(df).groupBy("split").count().collect()}
    assert counts == {"train": 4_000_000, "val": 500_000, "test": 500_000}


@pytest.mark.parametrize("ratios", [(1.0, 0.0), (0.0, 1.0), (0.0, 0.0)])
def test_split_with_empty_parts(log, ratios):
    counts = {r.split: r["count"] for r in temporal_split(log, *ratios).groupBy("split").count().collect()}
    want = {"train": int(1000 * ratios[0]), "val": int(1000 * ratios[1])}
    want["test"] = 1000 - sum(want.values())
    assert counts == {k: v for k, v in want.items() if v}


def test_split_of_nothing(log):
    assert temporal_split(log.limit(0)).count() == 0


@pytest.mark.parametrize("small", [1_000_000, 0])
def test_subsample_takes_exactly_n(log, small, monkeypatch):
    monkeypatch.setattr(index, "SMALL", small)
    one = {r.row_id for r in subsample(log, 123, 5).collect()}
    two = {r.row_id for r in subsample(log.repartition(7), 123, 5).collect()}
    assert len(one) == 123 and one == two
    assert {r.row_id for r in subsample(log, 123, 6).collect()} != one
    assert subsample(log, 5000).count() == 1000


@pytest.mark.parametrize("buckets", [1, 7, 4096])
def test_shuffled_index_is_dense_and_stable(log, buckets):
    rows = index.shuffled_index(log, "row_id", 9, buckets=buckets).select("row_id", "idx").collect()
    assert sorted(r.idx for r in rows) == list(range(1000))
    again = index.shuffled_index(log.repartition(3), "row_id", 9, buckets=64).select("row_id", "idx").collect()
    assert {r.row_id: r.idx for r in rows} == {r.row_id: r.idx for r in again}


def test_split_moves_no_rows(log):
    plan = temporal_split(log.select("*"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hash" not in plan.split("InMemory")[0] and "Window" not in plan.split("InMemory")[0]
    assert F is not None


def test_popular_items_for_users_who_met_the_popular_ones(spark):
    from feedforge.workload.log_queries import popular_unseen

    rows = [(u, i) for i in range(40) for u in range(100, 140 - i // 2)]
    rows += [(1, i) for i in range(33)] + [(2, i) for i in range(40)] + [(3, 0), (3, 0), (4, 39)]
    train = spark.createDataFrame(rows, "user_id long, item_id long")
    users = train.select("user_id").distinct().union(spark.createDataFrame([(5,)], "user_id long"))
    met, n = {}, {}
    for u, i in rows:
        met.setdefault(u, set()).add(i)
        n[i] = n.get(i, 0) + 1
    order = sorted(n, key=lambda i: (-n[i], i))
    wanted = set()
    for u in {u for u, _ in rows} | {5}:
        rest = [i for i in order if i not in met.get(u, set())][:5]
        wanted |= {(u, i, float(n[i]), at) for at, i in enumerate(rest, 1)}
    for first in (5, 12, 100):
        got = [tuple(r) for r in popular_unseen(train, users, 5, first).collect()]
        assert len(got) == len(set(got)) and set(got) == wanted
    assert popular_unseen(train.limit(0), users.limit(0)).count() == 0
