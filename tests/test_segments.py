import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from feedforge.operators.segments import asc, desc, row_number, running, top_n


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(7)
    data = [("hot", i, float(rng.randrange(5)), rng.randrange(100)) for i in range(900)]
    data += [(f"g{i % 7}", 1000 + i, float(rng.randrange(5)), rng.randrange(100)) for i in range(100)]
    return spark.createDataFrame(data, "g string, pos long, score double, v long").repartition(5)


@pytest.mark.parametrize("hot_rows", [50, 5, 10_000])
def test_running_equals_plain_window(rows, hot_rows):
    order = [desc("score"), asc("pos")]
    got = running(
        rows,
        ["g"],
        order,
        {
            "rn": ("count", None),
            "s": ("sum", F.col("v")),
            "hi": ("max", F.col("v")),
            "lo": ("min", F.col("v")),
            "head": ("first", F.col("v")),
        },
        hot_rows,
    )
    w = Window.partitionBy("g").orderBy(F.desc("score"), "pos").rowsBetween(Window.unboundedPreceding, 0)
    want = rows.select(
        "*",
        F.count(F.lit(1)).over(w).alias("rn"),
        F.sum("v").over(w).alias("s"),
        F.max("v").over(w).alias("hi"),
        F.min("v").over(w).alias("lo"),
        F.first("v").over(w).alias("head"),
    )
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_global_group(rows):
    got = row_number(rows, [], [asc("pos")], "rn", hot_rows=100)
    assert all(
        r.rn == i + 1 for i, r in enumerate(sorted(got.collect(), key=lambda r: r.pos))
    )


def test_top_n_limits_before_the_shuffle(rows):
    best = top_n(rows, ["g"], [desc("score"), asc("pos")], 3)
    assert best.groupBy("g").count().where("count <> 3").count() == 0
    plan = best._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_cut_groups_place_null_and_nan_like_plain_windows(spark):
    rows = [(1, i, [None, float("nan"), 0.0, -0.0, float(i % 5), -1.5][i % 6]) for i in range(60)]
    df = spark.createDataFrame(rows, "g long, pos long, score double")
    for first in (desc("score"), asc("score")):
        order = [first, asc("pos")]
        plain = {r.pos: r["rank"] for r in row_number(df, ["g"], order, "rank").collect()}
        cut = {r.pos: r["rank"] for r in row_number(df, ["g"], order, "rank", hot_rows=2).collect()}
        assert cut == plain


def test_many_large_groups(spark):
    """All of 1 500 large groups are cut, a NULL group among them."""
    df = spark.range(30_000).selectExpr("nullif(id % 1500, 7) AS g", "id * 7919 % 30011 AS pos", "id % 3 AS v")
    got = running(df, ["g"], [desc("pos")], {"rn": ("count", None), "s": ("sum", F.col("v"))}, hot_rows=6)
    w = Window.partitionBy("g").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, 0)
    want = df.select("*", F.count(F.lit(1)).over(w).alias("rn"), F.sum("v").over(w).alias("s"))
    assert got.exceptAll(want).isEmpty() and got.count() == 30_000


def test_one_group_of_many_segments(spark):
    """Totals of 400 segments are carried by a tree of several levels."""
    df = spark.range(2000).selectExpr("id * 7919 % 2003 AS pos", "nullif(id % 5, 0) AS v", "double(id) / 7 AS x")
    kinds = {"rn": ("count", None), "s": ("sum", F.col("v")), "hi": ("max", F.col("x")), "head": ("first", F.col("v"))}
    w = Window.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    e = Window.orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    for exclusive, frame in ((False, w), (True, e)):
        got = running(df, [], [asc("pos")], kinds, hot_rows=5, exclusive=exclusive)
        count = F.count(F.lit(1)).over(frame)
        want = df.select("*", count.alias("rn"), F.sum("v").over(frame).alias("s"), F.max("x").over(frame).alias("hi"), F.first("v").over(frame).alias("head"))
        assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))


def test_smallest_integer_in_descending_order(spark):
    df = spark.createDataFrame([(-(1 << 63),), ((1 << 63) - 1,), (0,), (None,), (5,)], "x long")
    ranks = {r.x: r["rn"] for r in row_number(df, [], [desc("x")], "rn", hot_rows=1).collect()}
    assert ranks == {(1 << 63) - 1: 1, 5: 2, 0: 3, -(1 << 63): 4, None: 5}
