"""User histories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from feedforge.functions.actions import ACTIONS, action_vector
from feedforge.operators.segments import HOT_ROWS, SEGMENT, asc, cut, desc, row_number, top_n

TIME_ORDER = (asc("ts_s"), asc("row_id"))
MAX_HISTORY = 128
PAGE_SIZE = 1000
STEP_FIELDS = ("ts_s", "row_id", "item_id", *ACTIONS)


def timelines(df: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Every interaction with its place ``seq`` in the user's time order."""
    return row_number(df, ["user_id"], TIME_ORDER, "seq", hot_rows)


def recent_items(df: DataFrame, max_len: int = MAX_HISTORY) -> DataFrame:
    """Latest ``max_len`` rows of every user; ``recency`` 1 is the newest."""
    return top_n(df, ["user_id"], [desc("ts_s"), desc("row_id")], max_len, "recency")


def user_histories(df: DataFrame, max_len: int = MAX_HISTORY) -> DataFrame:
    """Latest ``max_len`` interactions of every user as one array, oldest first."""
    steps = F.sort_array(F.collect_list(F.struct(*STEP_FIELDS)))
    return recent_items(df, max_len).groupBy("user_id").agg(steps.alias("history"))


def whole_histories(df: DataFrame, page_size: int = PAGE_SIZE, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Every interaction of every user with its place ``seq`` in time order and its ``page`` of ``page_size`` places.

    The long form of unlimited histories: a user spans as many rows, pages and tasks as the history needs, and a page is a
    bounded unit for readers that want arrays (:func:`history_pages`).
    """
    page = F.floor((F.col("seq") - 1) / F.lit(page_size)).cast("bigint")
    return timelines(df, hot_rows).withColumn("page", page)


def history_pages(steps: DataFrame) -> DataFrame:
    """:func:`whole_histories` as one array per user and page, oldest first."""
    page = F.sort_array(F.collect_list(F.struct("seq", *STEP_FIELDS)))
    return steps.groupBy("user_id", "page").agg(page.alias("history"))


def latest_rows(df: DataFrame) -> DataFrame:
    """Newest row of every user."""
    others = [c for c in df.columns if c != "user_id"]
    newest = df.groupBy("user_id").agg(
        F.max_by(F.struct(*others), F.struct("ts_s", "row_id")).alias("_last")
    )
    return newest.select("user_id", "_last.*").select(df.columns)


def histories_for(users: DataFrame, steps: DataFrame) -> DataFrame:
    """Rows of :func:`whole_histories` of a list of users; a user without any has one row with nulls in the other columns.

    Users are made distinct, so the large side of each join is the one that AQE may split where a user is hot.
    """
    wanted = users.select("user_id").distinct()
    own = steps.join(wanted, "user_id", "left_semi")
    without = wanted.join(steps.select("user_id").distinct(), "user_id", "left_anti")
    return own.unionByName(without, allowMissingColumns=True)


def latest_actions(df: DataFrame) -> DataFrame:
    """Action vector of the last interaction of every (user, item)."""
    last = F.max_by(action_vector(), F.struct("ts_s", "row_id"))
    return df.groupBy("user_id", "item_id").agg(last.alias("actions"))


def with_actions(pairs: DataFrame, log: DataFrame) -> DataFrame:
    """Latest actions for given (user_id, item_id) rows, zeros when there are none."""
    zeros = F.array(*[F.lit(0.0).cast("float")] * len(ACTIONS))
    joined = pairs.join(latest_actions(log), ["user_id", "item_id"], "left")
    return joined.withColumn("actions", F.coalesce("actions", zeros))


def with_prior_history(
    df: DataFrame,
    size: int,
    fields: Sequence[str] = ("item_id", *ACTIONS),
    name: str = "history",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """The latest ``size`` interactions strictly before each row, newest first.

    One window per user with a frame of ``size`` rows. A user with too many
    rows is cut along time; each later segment is given copies of the last
    ``size`` rows before it. Rows of one second share the history of the first
    of them, so a row never sees its own second.
    """
    rows = cut(df, ["user_id"], [asc("ts_s")], hot_rows)
    if rows is None:
        everything = df.withColumns({SEGMENT: F.lit(0), "_own": F.lit(True)})
    else:
        everything = _with_earlier_tails(rows, size, fields)
    by = Window.partitionBy("user_id", SEGMENT).orderBy("ts_s", "row_id")
    step = F.struct(*fields)
    before = F.collect_list(step).over(by.rowsBetween(-size, -1))
    second = Window.partitionBy("user_id", SEGMENT, "ts_s").orderBy("row_id")
    shared = F.first("_before").over(second.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    result = everything.withColumn("_before", before).withColumn(name, F.reverse(shared)).where("_own")
    return result.drop("_before", "_own", SEGMENT)


def _with_earlier_tails(rows: DataFrame, size: int, fields: Sequence[str]) -> DataFrame:
    """Cut rows, with copies of the ``size`` rows before each later segment.

    Only the last ``size`` rows of each segment matter to later ones. Ordered by time, the last ``size`` of these at the end
    of a segment are what its successor starts from.
    """
    carried = ["user_id", "ts_s", "row_id", *[f for f in fields if f not in ("user_id", "ts_s", "row_id")]]
    tails = top_n(
        rows.where("_cut").select(*carried, SEGMENT), ["user_id", SEGMENT], [desc("ts_s"), desc("row_id")], size, "_back"
    )
    by = Window.partitionBy("user_id").orderBy("ts_s", "row_id")
    kept = F.collect_list(F.struct(*carried)).over(by.rowsBetween(1 - size, Window.currentRow))
    ends = tails.withColumns({"_kept": kept, "_next": F.lead(SEGMENT).over(by)}).where("_back = 1 AND _next IS NOT NULL")
    copies = ends.select(F.explode("_kept").alias("_row"), F.col("_next").alias(SEGMENT)).select("_row.*", SEGMENT)
    own = rows.withColumn("_own", F.lit(True)).drop("_cut")
    return own.unionByName(copies.withColumn("_own", F.lit(False)), allowMissingColumns=True)


def with_history_items(df: DataFrame, size: int = 10, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``hist_items``: ids of the latest ``size`` earlier interactions, newest first."""
    prior = with_prior_history(df, size, ("item_id",), "_steps", hot_rows)
    return prior.withColumn("hist_items", F.transform("_steps", lambda s: s["item_id"])).drop("_steps")
