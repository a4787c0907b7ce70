import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from feedforge.operators import metrics
from feedforge.operators.progress import patience_stop, running_best

SCHEMA = "sample_id long, cand_pos long, label int, score double"


def brute_auc(labels, scores):
    pos = [s for y, s in zip(labels, scores) if y == 1]
    neg = [s for y, s in zip(labels, scores) if y == 0]
    if not pos or not neg:
        return 0.5
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    out = [(1, i, int(rng.random() < 0.2), float(rng.randrange(9))) for i in range(200)]
    for sample in range(2, 12):
        out += [(sample, i, int(rng.random() < 0.3), float(rng.randrange(6))) for i in range(rng.randrange(1, 15))]
    out += [(20, i, 0, 1.0) for i in range(4)] + [(21, i, 1, 1.0) for i in range(4)]
    return out


def brute(rows, k):
    by = {}
    for s, pos, y, score in rows:
        by.setdefault(s, []).append((-score, pos, y))
    res = {"ndcg": [], "hit_rate": [], "recall": [], "precision": [], "mrr": []}
    for items in by.values():
        ranked = [y for _, _, y in sorted(items)]
        n, kk, total = len(ranked), min(k, len(ranked)), sum(ranked)
        gain = lambda ys: sum(y / np.log2(i + 2) for i, y in enumerate(ys))
        ideal = gain(sorted(ranked, reverse=True)[:kk])
        res["ndcg"].append(gain(ranked[:kk]) / ideal if ideal else 0.0)
        hits = sum(ranked[:kk])
        res["hit_rate"].append(float(hits > 0))
        res["recall"].append(hits / total if total else 0.0)
        res["precision"].append(hits / kk)
        res["mrr"].append(1 / (ranked.index(1) + 1) if total else 0.0)
        assert n
    return {m: float(np.mean(v)) for m, v in res.items()}


@pytest.mark.parametrize("hot_rows", [5_000_000, 30])
@pytest.mark.parametrize("k", [1, 5, 300])
def test_ranking_metrics(spark, rows, k, hot_rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = metrics.mean_metrics(df, [k], hot_rows).first().asDict()
    for name, value in brute(rows, k).items():
        assert got[name if name == "mrr" else f"{name}@{k}"] == pytest.approx(value)
    if k < 300:
        want = brute(rows, k)
        assert metrics.hit_rate_at_k(df, k).first()[0] == pytest.approx(want["hit_rate"])
        assert metrics.recall_at_k(df, k).first()[0] == pytest.approx(want["recall"])
        assert metrics.precision_at_k(df, k).first()[0] == pytest.approx(want["precision"])


def test_auc_with_ties(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    want = brute_auc([r[2] for r in rows], [r[3] for r in rows])
    assert metrics.auc(df).first()[0] == pytest.approx(want)


@pytest.mark.parametrize("labels", [[], [1, 1], [0, 0, 0]])
def test_auc_of_one_class(spark, labels):
    df = spark.createDataFrame([(1, i, y, 0.5) for i, y in enumerate(labels)], SCHEMA)
    assert metrics.auc(df).first()[0] == 0.5


def test_auc_of_many_scores(spark):
    rng = random.Random(9)
    data = [(1, i, int(rng.random() < 0.4), rng.random()) for i in range(5000)]
    df = spark.createDataFrame(data, SCHEMA).repartition(16)
    assert metrics.auc(df).first()[0] == pytest.approx(brute_auc([r[2] for r in data], [r[3] for r in data]))


@pytest.mark.parametrize("hot_rows", [5_000_000, 3])
def test_average_ranks(spark, hot_rows):
    df = spark.createDataFrame([(x,) for x in (3.0, 1.0, 3.0, 2.0, 3.0, 9.0, 8.0, 7.0)], "score double")
    got = {r.score: (r.n, r.avg_rank) for r in metrics.average_ranks(df, hot_rows=hot_rows).collect()}
    assert got == {1.0: (1, 1.0), 2.0: (1, 2.0), 3.0: (3, 4.0), 7.0: (1, 6.0), 8.0: (1, 7.0), 9.0: (1, 8.0)}


def test_bundle_uses_the_first_positive(spark):
    rows = [(1, 0, 0, 9.0), (1, 1, 1, 5.0), (1, 2, 1, 8.0), (2, 0, 0, 1.0)]
    df = spark.createDataFrame(rows, "sample_id long, cand_pos long, click int, score double")
    df = df.withColumns({"like": F.lit(0), "click_logit": F.col("score"), "like_logit": F.lit(0.0)})
    row = metrics.evaluation_bundle(df, ["click", "like"]).first()
    assert row["hit@1"] == 0.0 and row["mrr"] == pytest.approx(1 / 3) and row["like_auc"] == 0.5


def test_bundle_without_positives(spark):
    df = spark.createDataFrame([(1, 0, 0, 9.0)], "sample_id long, cand_pos long, click int, score double")
    df = df.withColumns({"like": F.lit(0), "click_logit": F.col("score"), "like_logit": F.lit(0.0)})
    row = metrics.evaluation_bundle(df, ["click", "like"]).first()
    assert row["hit@1"] == 0.0 and row["mrr"] == 0.0 and row["auc"] == 0.5


@pytest.mark.parametrize("hot_rows", [5_000_000, 2])
def test_progress(spark, hot_rows):
    values = [0.5, 0.7, 0.6, 0.7, 0.65, 0.8, 0.1]
    rows = [("m/auc", i, v) for i, v in enumerate(values)] + [("m/loss", i, v) for i, v in enumerate(values)]
    log = spark.createDataFrame(rows, "name string, step long, value double")
    best = {(r.name, r.step): r.best for r in running_best(log, hot_rows).collect()}
    assert [best["m/auc", i] for i in range(7)] == [0.5, 0.7, 0.7, 0.7, 0.7, 0.8, 0.8]
    assert [best["m/loss", i] for i in range(7)] == [0.5, 0.5, 0.5, 0.5, 0.5, 0.5, 0.1]
    stop = {r.name: r.step for r in patience_stop(log.where("name = 'm/auc'"), 3, hot_rows).collect()}
    assert stop == {"m/auc": 4}
