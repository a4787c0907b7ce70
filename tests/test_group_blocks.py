import random

from pyspark.sql import functions as F

from feedforge.operators import filters

COLUMNS = "request_id long, pos long, user_id long, item_id long, author_id long, ts_s long"


def tables(spark):
    """Users and authors in no, one or several groups, null ids and groups, repeated rows."""
    rng = random.Random(3)
    key = lambda n: rng.choice([*range(n), None])
    users = [(key(9), rng.choice([0, 1, 2, None])) for _ in range(14)]
    authors = [(key(9), rng.choice([0, 1, 2, None])) for _ in range(14)]
    rows = [(i % 5, i, key(11), key(6), key(11), 100 + i) for i in range(150)]
    blocks = filters.GroupBlocks(spark.createDataFrame(users, "user_id long, group long"), spark.createDataFrame(authors, "author_id long, group long"))
    wanted = {(u, a) for u, g in users for a, h in authors if g is not None and g == h and u is not None and a is not None}
    return spark.createDataFrame(rows, COLUMNS), rows, blocks, wanted


def test_groups_block_as_their_pairs(spark):
    df, rows, blocks, wanted = tables(spark)
    pairs = blocks.users.join(blocks.authors, "group").select("user_id", "author_id")
    assert wanted
    for seen in ([], [(1, 1), (2, 2)]):
        seen = spark.createDataFrame(seen, "user_id long, item_id long")
        by_group = filters.batch_filter(df, blocks, seen, now=200, max_age=50)
        by_pair = filters.batch_filter(df, pairs, seen, now=200, max_age=50)
        assert sorted(by_group.collect(), key=str) == sorted(by_pair.collect(), key=str)
    marked = filters.blocked_author(df, blocks).select("pos", "removed_by").collect()
    assert {r.pos: r.removed_by for r in marked} == {r[1]: "blocked_author" if (r[2], r[4]) in wanted else None for r in rows}
    assert len(marked) == len(rows)


def test_pairs_of_large_groups_are_not_built(spark):
    """10^10 pairs of one group."""
    users = spark.range(100_000).select(F.col("id").alias("user_id"), F.lit(1).alias("group"))
    authors = spark.range(100_000).select(F.col("id").alias("author_id"), F.lit(1).alias("group"))
    df = spark.createDataFrame([(1, 1, 5, 1, 7, 0), (1, 2, 5, 1, 100_000, 0)], COLUMNS)
    blocked = filters.blocked_author(df, filters.GroupBlocks(users, authors))
    plan = blocked._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Inner" not in plan and "Join LeftOuter" in plan
    assert [(r.pos, r.removed_by) for r in blocked.orderBy("pos").collect()] == [(1, "blocked_author"), (2, None)]
