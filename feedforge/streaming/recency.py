"""Recent items per user: batch form and stream form.

Input rows: row_id, user_id, item_id, ts_s, item_type. A user's timeline holds
each item once, at its first arrival, and at most ``cap`` items; the oldest
arrivals leave first. Deleted items are neither stored nor shown.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from feedforge.operators.segments import desc, top_n
from feedforge.session import SETTINGS

# Items per user, two days, items per read.
CAP = 500
RETENTION_SECONDS = 172_800
READ_SIZE = 20
# Places of a stream's timeline that are read and written together.
PAGE = 64

SNAPSHOT_COLUMNS = ("user_id", "item_id", "ts_s", "item_type", "arrival")


def without_deleted(df: DataFrame, deleted: DataFrame | None) -> DataFrame:
    """Rows whose item is not soft-deleted."""
    if deleted is None:
        return df
    return df.join(deleted.select("item_id").distinct(), "item_id", "left_anti")


def snapshot(events: DataFrame, deleted: DataFrame | None = None, cap: int = CAP) -> DataFrame:
    """State after loading events in (ts_s, row_id) order.

    First arrivals are aggregated before the shuffle, and a per-task limit
    keeps ``cap`` rows per user. It equals the stream as long as no item
    arrives again after leaving; :func:`replay` has no such condition.
    """
    arrival = F.struct("ts_s", "row_id", "item_type")
    first = (
        without_deleted(events, deleted)
        .groupBy("user_id", "item_id")
        .agg(F.min(arrival).alias("_first"))
        .select("user_id", "item_id", "_first.*")
        .withColumnRenamed("row_id", "arrival")
    )
    return top_n(first, ["user_id"], [desc("ts_s"), desc("arrival")], cap, "_n").select(*SNAPSHOT_COLUMNS)


def replay(events: DataFrame, deleted: DataFrame | None = None, cap: int = CAP) -> DataFrame:
    """State after loading events in order, items returning after they left included.

    Whether a returning item is new depends on everything before it, so each
    user is read in order. Rows pass through a task in batches and only the
    current user's ``cap`` items are held.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        user, line = None, OrderedDict()

        def dump() -> pd.DataFrame:
            rows = [(user, item, *rest) for item, rest in line.items()]
            return pd.DataFrame(rows, columns=list(SNAPSHOT_COLUMNS))

        for batch in batches:
            columns = [batch[c].tolist() for c in ("user_id", "item_id", "ts_s", "item_type", "row_id")]
            for who, item, ts, kind, row in zip(*columns):
                if who != user:
                    if line:
                        yield dump()
                    user, line = who, OrderedDict()
                if item not in line:
                    line[item] = (ts, kind, row)
                    if len(line) > cap:
                        line.popitem(last=False)
        if line:
            yield dump()

    rows = without_deleted(events, deleted).select("user_id", "item_id", "ts_s", "item_type", "row_id")
    ordered = rows.repartition("user_id").sortWithinPartitions("user_id", "ts_s", "row_id")
    return ordered.mapInPandas(run, "user_id long, item_id long, ts_s long, item_type tinyint, arrival long")


def read_histories(
    state: DataFrame, users: DataFrame | None = None, deleted: DataFrame | None = None, max_items: int = READ_SIZE
) -> DataFrame:
    """Newest ``max_items`` live items per user, optionally for given users."""
    live = without_deleted(state, deleted)
    if users is not None:
        live = live.join(users.select("user_id").distinct(), "user_id", "left_semi")
    return top_n(live, ["user_id"], [desc("ts_s"), desc("arrival")], max_items, "recency")


def trim(state: DataFrame, now: int, retention: int = RETENTION_SECONDS) -> DataFrame:
    """State without items older than the retention."""
    return state.where(F.col("ts_s") >= now - retention)


def trimmed_count(state: DataFrame, now: int, retention: int = RETENTION_SECONDS) -> DataFrame:
    """Number of items :func:`trim` removes."""
    return state.agg(F.count_if(F.col("ts_s") < now - retention).alias("trimmed"))


def store_statistics(state: DataFrame, deleted: DataFrame) -> DataFrame:
    """Users, items and deleted items."""
    users = state.select("user_id").distinct().agg(F.count(F.lit(1)).alias("n")).scalar()
    gone = deleted.select("item_id").distinct().agg(F.count(F.lit(1)).alias("n")).scalar()
    return state.agg(F.count(F.lit(1)).alias("items")).select(users.alias("users"), "items", gone.alias("deleted"))


CHANGE_SCHEMA = (
    "user_id bigint, place bigint, gone boolean, item_id bigint, ts_s bigint, item_type tinyint, arrival bigint"
)


def timeline_processor(cap: int) -> type[StatefulProcessor]:
    """A processor that keeps a user's timeline in pages of ``PAGE`` places.

    Every call to the state passes through a socket, so a user's rows of a micro-batch read the timeline once, at most ``cap``
    items, and write the pages that changed. ``ends`` holds the next place and when the user's only timer is due: just
    after the oldest item leaves the retention. When the watermark passes it, all items behind the watermark leave together
    and the timer moves on to the oldest one left. The output is what changed: rows that came, and rows that are gone.
    """

    class Timeline(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            columns = "places array<long>, items array<long>, times array<long>, types array<int>, arrivals array<long>"
            self.pages = handle.getMapState("pages", "page long", columns)
            self.ends = handle.getValueState("ends", "next long, due long")

        def handleInputRows(self, key, rows, timerValues):
            (user,) = key
            after, due = self.ends.get() or (0, None)
            line, stored = self._line() if after else ({}, set())
            known, touched = {item for item, *_ in line.values()}, set()
            for chunk in rows:
                changes = []
                ordered = chunk.sort_values(["ts_s", "row_id"])
                columns = [ordered[c].tolist() for c in ("item_id", "ts_s", "item_type", "row_id")]
                for item, *rest in zip(*columns):
                    if item in known:
                        continue
                    known.add(item)
                    line[after] = (item, *rest)
                    touched.add(after // PAGE)
                    changes.append((user, after, False, item, *rest))
                    after += 1
                    if len(line) > cap:
                        place = next(iter(line))
                        changes.append(self._left(user, place, line, touched))
                        known.remove(changes[-1][3])
                if changes:
                    yield _changes(changes)
            self._store(line, touched, stored)
            self.ends.update((after, self._timer(line, due, timerValues.getCurrentWatermarkInMs())))

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            (user,) = key
            watermark, touched = timerValues.getCurrentWatermarkInMs(), set()
            after, _ = self.ends.get()
            line, stored = self._line()
            expired = [place for place, (_, ts, *_) in line.items() if ts * 1000 < watermark]
            changes = [self._left(user, place, line, touched) for place in expired]
            self._store(line, touched, stored)
            self.ends.update((after, self._timer(line, None, watermark)))
            if changes:
                yield _changes(changes)

        def _line(self) -> tuple[dict, set]:
            """The timeline by place, oldest arrival first, and the pages it is stored in."""
            line, stored = {}, set()
            for (page,), (places, *columns) in self.pages.iterator():
                stored.add(page)
                line.update(zip(places, zip(*columns)))
            return dict(sorted(line.items())), stored

        def _store(self, line: dict, touched: set, stored: set) -> None:
            for page in touched:
                own = [(place, *line[place]) for place in range(page * PAGE, (page + 1) * PAGE) if place in line]
                if own:
                    self.pages.updateValue((page,), tuple(map(list, zip(*own))))
                elif page in stored:
                    self.pages.removeKey((page,))

        def _timer(self, line: dict, due: int | None, watermark: int) -> int | None:
            """When the timer is due; it is set anew if none is, or if an item that is now the oldest comes before it."""
            if not line:
                return due
            oldest = max(min(ts for _, ts, *_ in line.values()) * 1000, watermark) + 1
            if due is not None and due <= oldest:
                return due
            if due is not None:
                self.handle.deleteTimer(due)
            self.handle.registerTimer(oldest)
            return oldest

        def _left(self, user: int, place: int, line: dict, touched: set) -> tuple:
            touched.add(place // PAGE)
            return (user, place, True, *line.pop(place))

        def close(self) -> None:
            pass

    def _changes(rows: list) -> pd.DataFrame:
        names = ["user_id", "place", "gone", "item_id", "ts_s", "item_type", "arrival"]
        return pd.DataFrame({n: np.array(c, "bool" if n == "gone" else "int64") for n, c in zip(names, zip(*rows))})

    return Timeline


def recency_stream(
    events: DataFrame, deleted: DataFrame | None = None, cap: int = CAP, retention: int = RETENTION_SECONDS
) -> DataFrame:
    """Stream of changes of timelines: (user_id, place, gone, item_id, ts_s, item_type, arrival).

    ``events`` is a streaming DataFrame that also has the timestamp column ``ts``. The watermark follows the newest event by
    ``retention`` seconds: later rows are dropped and older items leave the state by their user's timer. A user's new rows pass
    through in Arrow batches, so a micro-batch of any size needs bounded memory; within an Arrow batch they are taken in
    (ts_s, row_id) order, and a micro-batch of more rows of one user in the order in which Spark delivers its Arrow batches.
    """
    rows = events.withWatermark("ts", f"{retention} seconds")
    rows = without_deleted(rows, deleted)
    return rows.groupBy("user_id").transformWithStateInPandas(
        statefulProcessor=timeline_processor(cap)(), outputStructType=CHANGE_SCHEMA, outputMode="append", timeMode="EventTime"
    )


# Micro-batches between two compactions of a change log.
COMPACT_EVERY = 20


def _folders(spark: SparkSession, path: str, name: str) -> dict[int, str]:
    """Finished folders ``name=<number>`` below ``path``, by number."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not files.exists(root):
        return {}
    found = {}
    for status in files.listStatus(root):
        own = status.getPath()
        label, _, number = own.getName().partition("=")
        if label == name and files.exists(spark._jvm.org.apache.hadoop.fs.Path(own, "_SUCCESS")):
            found[int(number)] = own.toString()
    return found


def _remove(spark: SparkSession, folders: list[str]) -> None:
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def _current(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """Live rows of a change log, with their places: the last base and the changes after it.

    ``before`` leaves out later batches and bases.
    """
    limit = float("inf") if before is None else before
    bases = {n: f for n, f in _folders(spark, path, "base").items() if n < limit}
    upto = max(bases, default=-1)
    changes = [f for n, f in _folders(spark, path, "batch").items() if upto < n < limit]
    read = [*([bases[upto]] if bases else []), *changes]
    rows = spark.read.schema(CHANGE_SCHEMA).parquet(*read) if read else spark.createDataFrame([], CHANGE_SCHEMA)
    places = rows.groupBy("user_id", "place").agg(
        F.bool_or("gone").alias("gone"), *(F.first(c).alias(c) for c in ("item_id", "ts_s", "item_type", "arrival"))
    )
    return places.where("not gone")


def start_snapshot_sink(
    stream: DataFrame,
    path: str,
    checkpoint: str,
    state_partitions: int | None = None,
    compact_every: int = COMPACT_EVERY,
    **trigger,
):
    """Write every micro-batch's changes below ``path`` as a log that is compacted every ``compact_every`` batches.

    A batch has a folder of its own and replaces it when it runs again. A compaction writes the live rows as a new base and
    removes what the base before it had replaced, so readers of that one can finish; the log never holds more than two bases
    and twice ``compact_every`` batches, however long the stream runs. The number of state partitions is fixed by a
    stream's first start: ``state_partitions`` or the session's shuffle width. State lies in RocksDB, whatever the session's
    provider, since a timeline has several tables a key.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        if (batch_id + 1) % compact_every:
            return
        rows = _current(spark, path, before=batch_id).unionByName(spark.read.parquet(f"{path}/batch={batch_id}"))
        places = rows.groupBy("user_id", "place").agg(
            F.bool_or("gone").alias("gone"), *(F.first(c).alias(c) for c in ("item_id", "ts_s", "item_type", "arrival"))
        )
        bases = _folders(spark, path, "base")
        places.where("not gone").write.mode("overwrite").parquet(f"{path}/base={batch_id}")
        last = max((n for n in bases if n < batch_id), default=-1)
        old = {n: f for n, f in bases.items() if n < last}
        _remove(spark, [*old.values(), *(f for n, f in _folders(spark, path, "batch").items() if n <= last)])

    writer = (
        stream.writeStream.outputMode("append")
        .option("checkpointLocation", checkpoint)
        .foreachBatch(write)
        .trigger(**(trigger or {"availableNow": True}))
    )
    # A started query keeps its own copy of the settings.
    held = {"spark.sql.streaming.stateStore.providerClass": SETTINGS["spark.sql.streaming.stateStore.providerClass"]}
    if state_partitions is not None:
        held["spark.sql.shuffle.partitions"] = str(state_partitions)
    conf = getattr(stream, "sparkSession", SparkSession.active()).conf
    before = {name: conf.get(name, None) for name in held}
    try:
        for name, value in held.items():
            conf.set(name, value)
        return writer.start()
    finally:
        for name, value in before.items():
            conf.unset(name) if value is None else conf.set(name, value)


def latest_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """Current state from a change log; reads the last base and the changes since, at most ``compact_every`` batches."""
    return _current(spark, path).select(*SNAPSHOT_COLUMNS)


def clear(spark: SparkSession, path: str) -> None:
    """Empty a change log; a stream that starts over takes a new checkpoint and path."""
    later = max([-1, *_folders(spark, path, "base"), *_folders(spark, path, "batch")]) + 1
    old = [*_folders(spark, path, "base").values(), *_folders(spark, path, "batch").values()]
    spark.createDataFrame([], CHANGE_SCHEMA).write.mode("overwrite").parquet(f"{path}/base={later}")
    _remove(spark, old)
