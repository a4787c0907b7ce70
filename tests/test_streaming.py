import random

import pytest
from pyspark.sql import functions as F

from feedforge.session import new_scratch_path
from feedforge.streaming import recency

SCHEMA = "row_id long, user_id long, item_id long, ts_s long, item_type tinyint"


def model(batches, cap):
    """Sequential timelines: first arrival wins, the oldest leaves."""
    lines = {}
    for batch in batches:
        for row, user, item, ts, kind in sorted(batch, key=lambda r: (r[3], r[0])):
            line = lines.setdefault(user, [])
            if all(item != i for i, *_ in line):
                line.append((item, ts, kind, row))
                del line[:-cap]
    return {(u, *i) for u, line in lines.items() for i in line}


def events(n=600):
    rng = random.Random(8)
    return [(i, rng.randrange(4), rng.randrange(30), 1_700_000_000 + i * 60 + rng.randrange(600), i % 3) for i in range(n)]


def as_set(df):
    return {(r.user_id, r.item_id, r.ts_s, r.item_type, r.arrival) for r in df.collect()}


@pytest.mark.parametrize("cap", [5, 12, 500])
def test_replay(spark, cap):
    df = spark.createDataFrame(events(), SCHEMA)
    assert as_set(recency.replay(df, cap=cap)) == model([events()], cap)


def test_snapshot_equals_replay_without_eviction(spark):
    df = spark.createDataFrame(events(), SCHEMA)
    deleted = spark.createDataFrame([(3,), (4,)], "item_id long")
    assert as_set(recency.snapshot(df, deleted)) == as_set(recency.replay(df, deleted)) == model([[e for e in events() if e[2] not in (3, 4)]], 500)


def run_stream(spark, batches, compact_every=2, **options):
    source, state, checkpoint = (new_scratch_path(spark, n) for n in ("src", "state", "chk"))
    schema = SCHEMA + ", ts timestamp"
    query = None
    for batch in batches:
        df = spark.createDataFrame(batch, SCHEMA).withColumn("ts", F.timestamp_seconds("ts_s"))
        df.coalesce(1).write.mode("append").parquet(source)
        stream = recency.recency_stream(spark.readStream.schema(schema).parquet(source), **options)
        query = recency.start_snapshot_sink(stream, state, checkpoint, compact_every=compact_every)
        query.awaitTermination()
    folders = recency._folders(spark, state, "batch"), recency._folders(spark, state, "base")
    assert len(folders[0]) <= 2 * compact_every and len(folders[1]) <= 2
    return recency.latest_snapshot(spark, state)


@pytest.mark.parametrize(("cap", "compact_every"), [(8, 2), (500, 1), (12, 100)])
def test_stream_equals_the_model(spark, cap, compact_every):
    data = events(240)
    batches = [data[i : i + 60] for i in range(0, 240, 60)]
    assert as_set(run_stream(spark, batches, compact_every, cap=cap, retention=31_536_000)) == model(batches, cap)


def test_stream_needs_no_provider_in_the_session(spark):
    """A session that keeps Spark's own provider runs the stream, and has its settings back afterwards."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    plain = "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"
    spark.conf.set(name, plain)
    try:
        data = events(60)
        assert as_set(run_stream(spark, [data], cap=8, retention=31_536_000)) == model([data], 8)
        assert spark.conf.get(name) == plain
    finally:
        spark.conf.set(name, before)


def test_a_batch_that_runs_again_changes_nothing(spark):
    """The sink's folders of a batch are replaced, not added to, compactions included."""
    path = new_scratch_path(spark, "state")
    held = {}

    class Writer:
        outputMode = option = trigger = lambda self, *a, **k: self
        start = lambda self: None

        def foreachBatch(self, f):
            held["write"] = f
            return self

    class Stream:
        writeStream = Writer()

    recency.start_snapshot_sink(Stream(), path, "unused", compact_every=2)
    make = lambda rows: spark.createDataFrame(rows, recency.CHANGE_SCHEMA)
    batches = [
        [(1, 0, False, 5, 10, 0, 100), (1, 1, False, 6, 11, 0, 101)],
        [(1, 0, True, 5, 10, 0, 100), (1, 2, False, 7, 12, 0, 102)],
        [(1, 3, False, 5, 13, 0, 103)],
        [(1, 1, True, 6, 11, 0, 101)],
    ]
    for i, rows in enumerate(batches):
        held["write"](make(rows), i)
        held["write"](make(rows), i)
    assert as_set(recency.latest_snapshot(spark, path)) == {(1, 7, 12, 0, 102), (1, 5, 13, 0, 103)}
    assert set(recency._folders(spark, path, "base")) == {1, 3} and set(recency._folders(spark, path, "batch")) == {2, 3}


def test_stream_trims_old_items(spark):
    first = [(0, 1, 5, 1_700_000_000, 0), (1, 2, 6, 1_700_000_100, 0)]
    later = [(2, 2, 7, 1_700_500_000, 0)]
    last = [(3, 2, 8, 1_700_500_001, 0)]
    left = as_set(run_stream(spark, [first, later, last], retention=172_800))
    assert left == {(2, 7, 1_700_500_000, 0, 2), (2, 8, 1_700_500_001, 0, 3)}


def test_read_and_trim(spark):
    state = recency.snapshot(spark.createDataFrame(events(), SCHEMA))
    deleted = spark.createDataFrame([(3,)], "item_id long")
    users = spark.createDataFrame([(1,), (1,), (99,)], "user_id long")
    rows = recency.read_histories(state, users, deleted, 4).collect()
    assert len(rows) == 4 and {r.user_id for r in rows} == {1} and 3 not in {r.item_id for r in rows}
    now = 1_700_000_000 + 172_800 + 3_000
    kept = recency.trim(state, now).count()
    assert kept + recency.trimmed_count(state, now).first()[0] == state.count() and kept < state.count()
