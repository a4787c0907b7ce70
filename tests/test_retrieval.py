"""Exact top-K retrieval against brute force, with many blocks, ties and early stops."""

import numpy as np
import pytest

from feedforge.operators.retrieval import item_blocks, top_k_items, top_k_with_work


def frame(spark, ids, vectors, name):
    rows = [(int(i), None if v is None else [float(x) for x in v]) for i, v in zip(ids, vectors)]
    return spark.createDataFrame(rows, f"{name} long, vector array<float>")


def brute(user_ids, users, item_ids, items, k):
    out = []
    for u, v in zip(user_ids, users):
        scores = np.round(items.astype(np.float32).astype(float) @ v.astype(np.float32).astype(float), 9)
        order = np.lexsort((item_ids, -scores))[:k]
        out += [(int(u), int(item_ids[i]), round(float(scores[i]), 6), r + 1) for r, i in enumerate(order)]
    return sorted(out)


def result(df):
    return sorted((r.user_id, r.item_id, round(r.score, 6), r["rank"]) for r in df.collect())


def data(seed, n_users, n_items, d=8, spread=2.0):
    draw = np.random.default_rng(seed)
    items = draw.integers(-4, 5, (n_items, d)) / 4 * np.exp(spread * draw.normal(size=(n_items, 1))).round(2)
    users = draw.integers(-4, 5, (n_users, d)) / 4
    return np.arange(n_users) + 5, users, draw.permutation(n_items) + 1, items


@pytest.mark.parametrize(("k", "block", "round_bytes"), [(3, 16, 1 << 11), (10, 7, 1), (40, 64, 1 << 30), (500, 50, 1 << 12)])
def test_equals_brute_force(spark, k, block, round_bytes):
    user_ids, users, item_ids, items = data(k, 60, 400)
    items[50:90] = items[10]  # forty items tie
    users[3] = 0  # every score is zero
    found = top_k_items(frame(spark, user_ids, users, "user_id"), frame(spark, item_ids, items, "item_id"), k, block, round_bytes)
    assert result(found) == brute(user_ids, users, item_ids, items, k)


def test_equal_norms(spark):
    user_ids, users, item_ids, items = data(9, 40, 300)
    items = np.sign(items) + (items == 0)
    found = top_k_items(frame(spark, user_ids, users, "user_id"), frame(spark, item_ids, items, "item_id"), 5, 32, 1 << 12)
    assert result(found) == brute(user_ids, users, item_ids, items, 5)


def test_blocks_of_small_norm_are_skipped(spark):
    user_ids, users, item_ids, items = data(2, 50, 1000, spread=1.0)
    left, right = frame(spark, user_ids, users, "user_id"), frame(spark, item_ids, items, "item_id")
    blocks = item_blocks(right, 20)
    assert sum(r.n for r in blocks.collect()) == 1000 and blocks.count() >= 50
    read = {r.user_id: r.blocks_read for r in top_k_with_work(left, right, 5, 20, 1 << 12).collect()}
    moving = {u for u, v in zip(user_ids, users) if v.any()}
    assert np.mean([read[u] for u in moving]) < 0.7 * blocks.count()


def test_missing_and_few(spark):
    users = frame(spark, [1, 2], [[1, 0], None], "user_id")
    items = frame(spark, [7, 8, 9], [[1, 1], None, [-2, 0]], "item_id")
    assert result(top_k_items(users, items, 5)) == [(1, 7, 1.0, 1), (1, 9, -2.0, 2)]
    assert top_k_items(users, items.limit(0), 5).collect() == []
    assert top_k_items(users.limit(0), items, 5).collect() == []
