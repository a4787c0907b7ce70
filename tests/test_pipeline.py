import pytest
from pyspark.sql import functions as F

from feedforge.operators import filters
from feedforge.plans import datasets
from feedforge.plans.candidates import CandidatePipeline, Stage, column_scorer, lookup
from feedforge.session import new_scratch_path
from feedforge.sources import tables

SCHEMA = "request_id long, user_id long, item_id long, pos long"


@pytest.fixture(scope="module")
def requests(spark):
    return spark.createDataFrame([(1, 11, True), (2, 12, False)], "request_id long, user_id long, wide boolean")


def _source(spark, items):
    rows = [(r, 10 + r, i, p) for r in (1, 2) for p, i in enumerate(items)]
    return lambda asked: spark.createDataFrame(rows, SCHEMA).join(asked.select("request_id"), "request_id", "left_semi")


def _selected(result):
    rows = sorted(result.selected.collect(), key=lambda r: (r.request_id, r["rank"]))
    return {q: [r.item_id for r in rows if r.request_id == q] for q in (1, 2)}


@pytest.mark.parametrize("lazy", [False, True])
def test_stages_run_in_order(spark, requests, lazy):
    weights = spark.createDataFrame([(i, float(i)) for i in range(10)], "item_id long, weight double")
    done = []
    pipeline = CandidatePipeline(
        sources=[Stage("a", _source(spark, [3, 5, 3])), Stage("b", _source(spark, [8, 5]), enable="wide")],
        hydrators=[Stage("weight", lookup(weights, "item_id", ["weight"]))],
        filters=[Stage("dedup", filters.dedup)],
        scorers=[Stage("weight", column_scorer(F.col("weight"))), Stage("negated", column_scorer(-F.col("score")), enable="wide")],
        side_effects=[Stage("count", lambda requests, selected: done.append(selected.count()))],
        check_rows=True,
        **({"materialize": None} if lazy else {}),
    )
    result = pipeline.execute(requests)
    assert _selected(result) == {1: [3, 5, 8], 2: [5, 3]}
    assert done == [5]
    assert {(r.request_id, r.item_id, r.removed_by) for r in result.removed.collect()} == {
        (1, 3, "dedup"), (1, 5, "dedup"), (2, 3, "dedup"),
    }
    assert result.retrieved.groupBy("source").count().orderBy("source").collect()[0]["count"] == 6


def test_failing_stages_are_left_out(spark, requests):
    pipeline = CandidatePipeline(
        sources=[Stage("bad", lambda r: r.select("nothing")), Stage("a", _source(spark, [3, 5]))],
        hydrators=[Stage("bad", lambda r, c: c.select("nothing")), Stage("loses", lambda r, c: c.where("item_id = 3"))],
        filters=[Stage("bad", lambda c: c.select("nothing"))],
        scorers=[Stage("bad", column_scorer(F.col("nothing"))), Stage("good", column_scorer(F.col("item_id").cast("double")))],
        side_effects=[Stage("bad", lambda r, s: 1 / 0)],
        check_rows=True,
        result_size=1,
    )
    assert _selected(pipeline.execute(requests)) == {1: [5], 2: [5]}
    pipeline.on_error = "raise"
    with pytest.raises(Exception):
        pipeline.execute(requests)


def test_evaluation_rows_of_the_plain_store(spark):
    """100 rows, user ids 0..99, item ids 2 * id, one click each, a history of ones."""
    log = spark.range(100).select(
        F.col("id").alias("row_id"), F.col("id").alias("user_id"), (F.col("id") * 2).alias("item_id"), F.col("id").alias("ts_s"),
        F.lit(1).alias("click"), F.lit(0).alias("like"), F.lit(0).alias("share"), F.lit(0).alias("follow"),
        F.array_repeat(F.lit(1).cast("bigint"), 10).alias("hist_items"),
    )
    positives = log.select("user_id", "item_id")
    pool = spark.range(500, 900).select(F.col("id").alias("item_id"))
    folder = new_scratch_path(spark, "evaluation-test")
    key = tables.evaluation_key(log, "plain", "val", 4, 42)
    built = []

    def build():
        built.append(1)
        return datasets.evaluation_rows(log, positives, pool, 4, 5, 1000)

    rows = tables.evaluation_table(spark, folder, key, build).collect()
    again = tables.evaluation_table(spark, folder, key, build).collect()
    assert sorted(rows) == sorted(again) and len(built) == 1 and len(rows) == 100
    for r in rows:
        assert r.user_ids == r.sample_id * 2654435761 % 1000 + 1
        assert len(r.candidate_item_ids) == 5 and len(r.history_item_ids) == 5
        assert r.history_item_ids == [2654435761 % 1000 + 1] * 5
        assert [a[0] for a in r.history_actions] == [1.0] * 5
        assert sorted(map(list, r.labels)) == [[0, 0, 0, 0]] * 4 + [[1, 0, 0, 0]]
        at = [i for i, label in enumerate(r.labels) if label[0] == 1.0][0]
        assert r.candidate_item_ids[at] == r.sample_id * 2 * 2654435761 % 1000 + 1
    places = {[i for i, label in enumerate(r.labels) if label[0] == 1.0][0] for r in rows}
    assert places == {0, 1, 2, 3, 4}
    tables.evaluation_table(spark, folder, {**key, "seed": 43}, build)
    assert len(built) == 2


def test_batches_of_ten(spark):
    log = spark.range(100).select(F.col("id").alias("row_id"))
    for options in ({"shuffle": False}, {"epoch": 1}, {"epoch": 2}):
        sizes = tables.with_batches(log, 10, **options).groupBy("batch_id").count().collect()
        assert sorted(r["batch_id"] for r in sizes) == list(range(10)) and all(r["count"] == 10 for r in sizes)
    assert tables.with_batches(log, 30, drop_last=True).count() == 90
    one, two = (sorted((r.batch_id, r.batch_pos, r.row_id) for r in tables.with_batches(log, 10, epoch=e).collect()) for e in (1, 2))
    assert one != two
