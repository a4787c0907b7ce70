import random

import pytest
from pyspark.sql import functions as F

from feedforge.functions import history, vectors
from feedforge.functions.hashing import table_hash
from feedforge.operators.filters import batch_filter, category_cap, category_cap_kept, dedup, dedup_kept, kept, muted_keyword
from feedforge.operators.histories import with_history_items, with_prior_history
from feedforge.operators.ranking import author_diversity, category_interleave
from feedforge.operators.scoring import weighted_score
from feedforge.operators.stats import category_diversity, dataset_statistics, min_max_normalize


@pytest.fixture(scope="module")
def log(spark):
    rng = random.Random(5)
    rows = [(i, 1 if i < 500 else rng.randrange(2, 8), rng.randrange(50), rng.randrange(300), rng.randrange(2)) for i in range(600)]
    schema = "row_id long, user_id long, item_id long, ts_s long, click int"
    return spark.createDataFrame(rows, schema).withColumns({a: F.lit(0) for a in ("like", "share", "follow")}).persist()


@pytest.mark.parametrize("hot_rows", [5_000_000, 50, 10, 3])
@pytest.mark.parametrize("size", [1, 4, 40])
def test_prior_history_is_strictly_earlier(log, size, hot_rows):
    rows = [r.asDict() for r in log.collect()]
    got = {r.row_id: [s["item_id"] for s in r.history] for r in with_prior_history(log, size, hot_rows=hot_rows).collect()}
    assert len(got) == len(rows)
    for r in rows:
        earlier = [x for x in rows if x["user_id"] == r["user_id"] and x["ts_s"] < r["ts_s"]]
        earlier.sort(key=lambda x: (x["ts_s"], x["row_id"]), reverse=True)
        assert got[r["row_id"]] == [x["item_id"] for x in earlier[:size]]


def test_history_items_keep_other_columns(log):
    found = with_history_items(log, 3)
    assert set(found.columns) == {*log.columns, "hist_items"} and found.count() == 600


def _one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_history_functions(spark):
    hist = F.array(*[F.lit(x).cast("bigint") for x in (5, 0, 5, 9)])
    empty = F.array().cast("array<bigint>")
    row = _one(
        spark,
        length=history.valid_length(hist),
        uniqueness=history.uniqueness(hist),
        span=history.id_span(hist),
        padded=history.pad_history(hist, 6),
        cut=history.pad_history(hist, 2),
        actions=history.placeholder_actions(history.pad_history(hist, 5)),
        decay=history.position_decay(F.lit(3)),
        none=history.position_decay(F.lit(0)),
        overlap=history.in_history(F.lit(9).cast("bigint"), hist),
        zero=history.in_history(F.lit(0).cast("bigint"), hist),
        empty_span=history.id_span(empty),
        empty_unique=history.uniqueness(empty),
    )
    assert (row.length, row.span) == (3, 4) and row.uniqueness == pytest.approx(2 / 3)
    assert row.padded == [5, 0, 5, 9, 0, 0] and row.cut == [5, 0]
    assert [a[0] for a in row.actions] == [1, 0, 1, 1, 0]
    assert row.decay == pytest.approx([1, 0.9, 0.81]) and row.none == []
    assert row.overlap and not row.zero and row.empty_span == 0 and row.empty_unique == 0


@pytest.mark.parametrize("value", [0, 1, 31, 4_000_000_000, 9_000_000_000_000_000_000])
def test_table_hash_is_exact(spark, value):
    row = _one(spark, a=table_hash(F.lit(value).cast("bigint"), 1), b=table_hash(F.lit(value).cast("bigint"), 0, 1000, 31))
    assert row.a == value * 2 * 2654435761 % 100000 + 1
    assert row.b == value * 31 * 2654435761 % 1000 + 1


def test_weighted_score_example(spark):
    predictions = F.create_map(F.lit("click"), F.lit(0.8), F.lit("like"), F.lit(0.3), F.lit("share"), F.lit(0.1))
    assert _one(spark, s=weighted_score(predictions)).s == pytest.approx(1.8)


def test_zero_vector(spark):
    zero = F.array(F.lit(0.0), F.lit(0.0))
    row = _one(spark, n=vectors.l2_normalize(zero), s=vectors.two_tower_score(zero, zero))
    assert row.n == [0.0, 0.0] and row.s == 0.0


@pytest.fixture(scope="module")
def candidates(spark):
    rng = random.Random(1)
    rows = [(1 if i < 300 else 2, i, 7 if i % 3 == 0 else rng.randrange(40), rng.randrange(6), rng.randrange(4), 100 + rng.randrange(50)) for i in range(400)]
    schema = "request_id long, pos long, item_id long, author_id long, category int, ts_s long"
    df = spark.createDataFrame(rows, schema).withColumns({"user_id": F.col("request_id"), "score": F.pmod(F.col("pos") * 7, F.lit(13)).cast("double")})
    return df.repartition(4).persist()


@pytest.mark.parametrize("operator", [
    dedup, category_cap, author_diversity, category_interleave,
    lambda df, **k: category_diversity(df, **k),
])
def test_cut_groups_give_the_same_rows(candidates, operator):
    plain, cut = operator(candidates), operator(candidates, hot_rows=20)
    assert sorted(map(str, plain.collect())) == sorted(map(str, cut.select(plain.columns).collect()))


def test_dedup_keeps_the_first(candidates):
    seen, want = set(), []
    for r in sorted(candidates.collect(), key=lambda r: (r.request_id, r.pos)):
        if (r.request_id, r.item_id) not in seen:
            seen.add((r.request_id, r.item_id))
            want.append((r.request_id, r.pos))
    assert sorted((r.request_id, r.pos) for r in kept(dedup(candidates)).collect()) == want
    assert sorted((r.request_id, r.pos) for r in dedup_kept(candidates).collect()) == want


def test_cap_forms_agree(candidates):
    flagged = kept(category_cap(candidates, 2)).select(candidates.columns)
    limited = category_cap_kept(candidates, 2)
    assert sorted(map(str, flagged.collect())) == sorted(map(str, limited.select(candidates.columns).collect()))


def test_copy_of_a_removed_row_is_a_duplicate(spark):
    rows = [(1, 0, 5, 9, 10), (1, 1, 5, 9, 100), (1, 2, 6, 1, 100), (1, 3, 8, 3, 100), (1, 4, 9, 9, 999)]
    df = spark.createDataFrame(rows, "request_id long, pos long, item_id long, author_id long, ts_s long").withColumn("user_id", F.lit(1).cast("bigint"))
    blocked = spark.createDataFrame([(1, 3)], "user_id long, author_id long")
    seen = spark.createDataFrame([], "user_id long, item_id long")
    got = {r.pos: r.removed_by for r in batch_filter(df, blocked, seen, 120, 50).collect()}
    assert got == {0: "age", 1: "dedup", 2: "self_item", 3: "blocked_author", 4: "age"}


def test_empty_keyword_matches_everything(spark):
    df = spark.createDataFrame([(1, 0, "Some TEXT"), (1, 1, None)], "request_id long, pos long, text string")
    assert {r.pos: r.removed_by for r in muted_keyword(df, [""]).collect()} == {0: "muted_keyword", 1: None}
    assert {r.pos: r.removed_by for r in muted_keyword(df, ["text"]).collect()} == {0: "muted_keyword", 1: None}


def test_statistics_of_nothing(log):
    row = dataset_statistics(log.limit(0)).first()
    assert row.total_interactions == 0 and row.total_users == 0 and row.total_clicks == 0 and row.click_rate == 0.0


def test_min_max_edges(spark):
    df = spark.createDataFrame([(1, 2.0), (1, float("nan")), (1, 4.0), (2, 3.0)], "g int, x double")
    got = [r.s for r in min_max_normalize(df, "x", "s", ["g"]).orderBy("g", "x").collect()]
    assert got[0] == 0.0 and got[1] == 1.0 and got[2] != got[2] and got[3] == 0.5
    assert min_max_normalize(df.limit(0), "x", "s").count() == 0
