import random

from pyspark.sql import functions as F

from feedforge.functions.actions import ACTIONS
from feedforge.operators.stats import item_dimension
from feedforge.plans import models

FEATURES = ["item_count", "activity_score", "activity_level", "category_preference"]


def table(spark, seed):
    rng = random.Random(seed)
    rows = [(i, 1 if i % 3 == 0 else rng.randrange(2, 9), rng.randrange(15), rng.randrange(60)) for i in range(300)]
    rows = [(*r, *(rng.randrange(2) for _ in ACTIONS), r[2] % 4) for r in rows]
    schema = "row_id long, user_id long, item_id long, ts_s long, " + ", ".join(f"`{a}` int" for a in ACTIONS) + ", video_category int"
    return rows, spark.createDataFrame(rows, schema)


def features(log, hot_rows=5_000_000):
    rows = log.select(F.col("row_id").alias("sample_id"), F.lit(0).alias("cand_pos"), "user_id", "item_id", "ts_s")
    found = models.with_prior_features(rows, log, item_dimension(log), hot_rows)
    return {r.sample_id: tuple(round(r[f], 9) for f in FEATURES) for r in found.collect()}


def test_features_count_only_earlier_seconds(spark):
    """Against plain loops, with and without cutting the user that has a third of all rows."""
    rows, log = table(spark, 1)
    got = features(log)
    assert features(log, hot_rows=30) == got
    for r in rows:
        earlier = [x for x in rows if x[3] < r[3]]
        own = [x for x in earlier if x[1] == r[1]]
        points = sum(x[4] + 2 * x[5] for x in own)
        same = sum(x[4] + 2 * x[5] for x in own if x[-1] == r[-1])
        assert got[r[0]][0] == sum(x[2] == r[2] for x in earlier)
        assert got[r[0]][3] == round(same / points if points else 0.0, 9)


def test_own_labels_do_not_reach_features(spark):
    """All labels from one second on are turned round: no row of that second or before may change."""
    _, log = table(spark, 2)
    turned = log.withColumns({a: F.when(F.col("ts_s") >= 30, 1 - F.col(a)).otherwise(F.col(a)) for a in ACTIONS})
    before, after = features(log), features(turned)
    unchanged = {r.row_id for r in log.where("ts_s <= 30").collect()}
    assert all(before[i] == after[i] for i in unchanged)
    assert any(before[i] != after[i] for i in before if i not in unchanged)


def test_ids_beyond_32_bits(spark):
    rng = random.Random(3)
    far = 1 << 40
    rows = [(far + rng.randrange(12), -far + rng.randrange(9), 1) for _ in range(200)]
    model = models.fit_retrieval(spark.createDataFrame(rows, "user_id long, item_id long, click int"), rank=4, iterations=2)
    assert {r.user_id for r in model.user_vectors().collect()} == {r[0] for r in rows}
    assert {r.item_id for r in model.item_vectors().collect()} == {r[1] for r in rows}


def test_one_second_for_all_rows(spark):
    """Totals before a second are what running windows give rows that all ask in it, with null users, items and seconds."""
    _, log = table(spark, 4)
    log = log.withColumns({c: F.when(F.col("row_id") % m != 0, F.col(c)) for c, m in (("user_id", 11), ("item_id", 13), ("ts_s", 17))})
    asked = log.select("user_id", "item_id").distinct().withColumns({"cand_pos": F.lit(0), "ts_s": F.lit(40).cast("long")})
    asked = asked.withColumn("sample_id", F.xxhash64("user_id", "item_id"))
    dimension = item_dimension(log)
    plain = models.with_prior_features(asked, log, dimension).select("sample_id", *FEATURES)
    at_once = models.with_features_at(asked, log, dimension, 40).select("sample_id", *FEATURES)
    assert sorted(at_once.collect()) == sorted(plain.collect())


def test_windows_of_a_user_share_a_shuffle(spark, monkeypatch):
    """Candidates are neither written between the windows nor dealt anew for the categories of a user; large users still are."""
    _, log = table(spark, 5)
    rows = log.select(F.col("row_id").alias("sample_id"), F.lit(0).alias("cand_pos"), "user_id", "item_id", "ts_s")
    names = []
    real = models.written
    monkeypatch.setattr(models, "written", lambda df, name: names.append(name) or real(df, name))
    found = models.with_prior_features(rows, log, item_dimension(log))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert not names and plan.count("Window") >= 3
    shuffles = found._jdf.queryExecution().executedPlan().toString()
    assert shuffles.count("hashpartitioning(user_id") == 1
    models.with_prior_features(rows, log, item_dimension(log), hot_rows=30)
    assert names == ["item-features", "user-features"]
