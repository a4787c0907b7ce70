import random

import pytest
from pyspark.sql import functions as F

from feedforge.operators.filters import muted_keyword_by_user
from feedforge.operators.histories import history_pages, histories_for, whole_histories
from feedforge.operators.keywords import found_keywords

SCHEMA = "request_id long, pos long, user_id long, text string"


def table(spark, n=400):
    rng = random.Random(3)
    draw = lambda k: "".join(rng.choice("abÄ .") for _ in range(k))
    rows = [(i // 10, i % 10, rng.randrange(6), draw(rng.randrange(40))) for i in range(n)]
    rows += [(90, 0, 1, None), (90, 1, 2, ""), (90, 2, None, "ab"), (91, 0, 3, "x" * 50_000 + "AB"), (91, 1, 3, "a+b (c")]
    words = [(u, draw(rng.randrange(1, 6))) for u in range(6) for _ in range(20)]
    words += [(1, None), (2, ""), (None, "ab"), (3, "xab"), (3, "+b ("), (3, "+b (")]
    return rows, words, spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(words, "user_id long, keyword string")


@pytest.mark.parametrize("round_bytes", [1 << 20, 64])
def test_found_keywords_equal_contains(spark, round_bytes):
    rows, words, df, keywords = table(spark)
    found = found_keywords(df, keywords.select(F.lower("keyword").alias("_word")), round_bytes=round_bytes)
    got = sorted((r.request_id, r.pos, r._word) for r in found.collect())
    distinct = {w.lower() for _, w in words if w is not None}
    assert got == sorted((q, p, w) for q, p, _, t in rows if t is not None for w in distinct if w in t.lower())


def test_users_mute_only_their_own_keywords(spark):
    rows, words, df, keywords = table(spark)
    got = {(r.request_id, r.pos): r.removed_by for r in muted_keyword_by_user(df, keywords).collect()}
    own = {u: [w.lower() for v, w in words if v == u and w is not None] for u in range(6)}
    assert len(got) == len(rows)
    for q, p, user, text in rows:
        hit = user is not None and text is not None and any(w in text.lower() for w in own[user])
        assert got[q, p] == ("muted_keyword" if hit else None)
    assert muted_keyword_by_user(df, keywords.limit(0)).where("removed_by IS NOT NULL").count() == 0
    assert muted_keyword_by_user(df.limit(0), keywords).count() == 0


def test_thousands_of_keywords_in_one_scan(spark):
    df = spark.range(2000).select(F.lit(0).alias("request_id"), "id", F.concat(F.lit("word "), "id", F.lit(" end")).alias("text"))
    words = spark.range(5000).select(F.concat(F.lit("d "), "id", F.lit(" ")).alias("_word"))
    found = found_keywords(df, words)
    assert found.count() == 2000
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Range (") == 1


@pytest.mark.parametrize("hot_rows", [5_000_000, 40])
def test_whole_histories_span_pages(spark, hot_rows):
    """User 1 has a third of all rows."""
    rng = random.Random(4)
    rows = [(i, 1 if i % 3 == 0 else rng.randrange(2, 30), rng.randrange(9), rng.randrange(50), 1) for i in range(900)]
    log = spark.createDataFrame(rows, "row_id long, user_id long, item_id long, ts_s long, click int")
    log = log.withColumns({a: F.lit(0) for a in ("like", "share", "follow")})
    steps = whole_histories(log, 16, hot_rows)
    users = spark.createDataFrame([(1,), (1,), (5,), (777,)], "user_id long")
    got = [(r.user_id, r.page, r.seq, r.row_id) for r in histories_for(users, steps).collect()]
    want = [(777, None, None, None)]
    for user in (1, 5):
        own = sorted((r for r in rows if r[1] == user), key=lambda r: (r[3], r[0]))
        want += [(user, at // 16, at + 1, r[0]) for at, r in enumerate(own)]
    assert sorted(got, key=str) == sorted(want, key=str)
    pages = history_pages(steps).collect()
    assert max(len(p.history) for p in pages) == 16 and sum(len(p.history) for p in pages) == 900
    assert all([s.seq for s in p.history] == list(range(p.page * 16 + 1, p.page * 16 + 1 + len(p.history))) for p in pages)
