"""Stages that look at one request at a time: candidates are dealt by request once, with the results of any other way."""

import random

import pytest
from pyspark.sql import functions as F

from feedforge.operators import filters, ranking
from feedforge.plans.candidates import CandidatePipeline, Stage, column_scorer, lookup


def tables(spark):
    rng = random.Random(3)
    ids = [1, 2, 3, 4]
    requests = [(r, 10 + r % 3, r % 2 == 0, r > 2) for r in ids] + [(4, 12, True, True)]
    rows = [(r, 10 + r % 3, rng.choice([*range(12), None]), rng.choice([1, 2, None]), rng.randrange(3), p, rng.randrange(1, 9) / 8)
            for r in ids for p in range(40)]
    seen = [(u, i) for u in (10, 11) for i in range(0, 12, 3)] * 2 + [(None, 1), (11, None)]
    return (
        spark.createDataFrame(requests, "request_id long, user_id long, cap boolean, diversify boolean"),
        spark.createDataFrame(rows, "request_id long, user_id long, item_id long, author_id long, category int, pos long, base double"),
        spark.createDataFrame(seen, "user_id long, item_id long"),
    )


def pipeline(requests, rows, seen, together, most=None):
    """The same stages either way."""
    def not_seen(df, bounded=False):
        return filters.seen_by_request(df, requests, seen, most=most) if bounded else filters.seen(df, seen)

    prices = rows.select("item_id").where("item_id < 9").distinct().withColumn("price", F.col("item_id") * 2)
    return CandidatePipeline(
        sources=[Stage("all", lambda asked: rows), Stage("some", lambda asked: rows.where("base > 0.5"))],
        hydrators=[Stage("price", lookup(prices, "item_id", ["price"]))],
        filters=[
            Stage("dedup", filters.dedup, per_request=together),
            Stage("seen", not_seen, per_request=together),
            Stage("category_cap", filters.category_cap, enable="cap", per_request=together),
        ],
        scorers=[
            Stage("base", column_scorer(F.col("base"))) if not together else Stage("base", lambda df, bounded: F.col("base"), per_request=True),
            Stage("diversity", ranking.author_diversity, enable="diversify", per_request=together),
        ],
        result_size=12,
    )


def outcome(result):
    at = lambda df, *more: sorted(str((r.request_id, r.pos, r.item_id, r.price, *[r[c] for c in more])) for r in df.collect())
    return at(result.selected, "rank", "score"), at(result.removed, "removed_by"), result.retrieved.count()


@pytest.mark.parametrize("most", [None, 2])
def test_results_do_not_depend_on_the_way(spark, most):
    requests, rows, seen = tables(spark)
    want = outcome(pipeline(requests, rows, seen, False).execute(requests))
    assert outcome(pipeline(requests, rows, seen, True, most).execute(requests)) == want
    assert all(want)


def test_large_requests_keep_the_windows_that_cut_groups(spark, monkeypatch):
    requests, rows, seen = tables(spark)
    want = outcome(pipeline(requests, rows, seen, False).execute(requests))
    monkeypatch.setattr("feedforge.plans.candidates.is_bounded", lambda df, keys: False)
    assert outcome(pipeline(requests, rows, seen, True).execute(requests)) == want


def test_candidates_travel_once_after_hydration(spark):
    """One shuffle for the lookup by item and one by request; windows and the selector need none."""
    requests, rows, seen = tables(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = pipeline(requests, rows, seen, True).execute(requests).selected._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    wide = [line for line in plan.splitlines() if "Exchange hashpartitioning(" in line]
    assert "Union" not in plan and plan.count("Window ") >= 4
    assert sum("REPARTITION_BY_COL" in line for line in wide) == 1
    # By item: candidates and prices (two); by user: what was seen and requests; by request: those joined.
    assert len(wide) <= 9
