"""Training and evaluation tables.

A sample is one interaction: its history, and a candidate list of the item
itself and sampled negatives, shuffled together with their labels. Arrays are
bounded by the history length and by one plus the number of negatives.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedforge.functions.actions import ACTIONS, action_vector
from feedforge.functions.draws import mix
from feedforge.functions.hashing import TABLE_SIZE, author_hash, multi_hash, product_surface, table_hash
from feedforge.functions.history import pad_history, placeholder_actions
from feedforge.operators.histories import with_history_items, with_prior_history
from feedforge.operators.sampling import filled_negatives, pool_negatives, slot_negatives
from feedforge.operators.segments import HOT_ROWS
from feedforge.operators.split import rows_of_first_positions

HISTORY_LENGTH = 128
# Distance between the seeds of two epochs, and the seed of the
# shuffle relative to the seed of the draws.
EPOCH_STRIDE = 1_000_003
SHUFFLE_SHIFT = 7777


def training_items(split: DataFrame) -> DataFrame:
    """Items of the training part: the pool that leaks nothing from the future."""
    return split.where(F.col("split") == "train").select("item_id").distinct()


def _samples(df: DataFrame) -> DataFrame:
    return df.select(F.col("row_id").alias("sample_id"), "user_id")


def _with_negatives(df: DataFrame, negatives: DataFrame) -> DataFrame:
    found = negatives.select(F.col("sample_id").alias("row_id"), "negatives")
    return df.join(found, "row_id")


def candidate_list(seed: int) -> Column:
    """Shuffled candidates of a row with item_id, action flags and ``negatives``.

    Each element has the original place ``origin`` (0 is the item itself), the
    item and its labels. The shuffle sorts by a hash of sample and place.
    """
    zeros = F.array(*[F.lit(0.0).cast("float")] * len(ACTIONS))
    own = F.array(F.struct(F.col("item_id").alias("item_id"), action_vector().alias("labels")))
    others = F.transform("negatives", lambda x: F.struct(x.alias("item_id"), zeros.alias("labels")))
    keyed = F.transform(
        F.concat(own, others),
        lambda c, i: F.struct(
            mix(F.col("row_id"), seed, i).alias("h"),
            i.cast("int").alias("origin"),
            c["item_id"].alias("item_id"),
            c["labels"].alias("labels"),
        ),
    )
    return F.array_sort(keyed)


def with_candidates(df: DataFrame, negatives: DataFrame, seed: int) -> DataFrame:
    """Join the negatives of each row and build its candidate list."""
    return _with_negatives(df, negatives).withColumn("candidates", candidate_list(seed)).drop("negatives")


def history_blocks(
    steps: Column, length: int, num_hashes: int = 2, table_size: int = TABLE_SIZE
) -> dict[str, Column]:
    """Padded history arrays from steps (item_id and actions), newest first."""
    zero_hashes = F.array(*[F.lit(0).cast("bigint")] * num_hashes)
    zero_actions = F.array(*[F.lit(0.0).cast("float")] * len(ACTIONS))

    def padded(f, filler: Column) -> Column:
        return F.slice(F.concat(F.transform(steps, f), F.array_repeat(filler, length)), 1, length)

    def masked(value, filler: Column):
        return lambda s: F.when(s["item_id"] == 0, filler).otherwise(value(s))

    return {
        "history_item_hashes": padded(
            masked(lambda s: multi_hash(s["item_id"], num_hashes, table_size), zero_hashes), zero_hashes
        ),
        "history_author_hashes": padded(
            masked(lambda s: author_hash(s["item_id"], num_hashes, table_size), zero_hashes), zero_hashes
        ),
        "history_actions": padded(masked(lambda s: s["actions"], zero_actions), zero_actions),
        "history_surface": padded(lambda s: product_surface(s["item_id"]), F.lit(0).cast("bigint")),
    }


def _prebuilt_steps() -> Column:
    one = F.array(F.lit(1.0).cast("float"), *[F.lit(0.0).cast("float")] * (len(ACTIONS) - 1))
    return F.transform("hist_items", lambda x: F.struct(x.alias("item_id"), one.alias("actions")))


def _recorded_steps() -> Column:
    vector = lambda s: F.array(*[s[a].cast("float") for a in ACTIONS])
    return F.transform("_prior", lambda s: F.struct(s["item_id"].alias("item_id"), vector(s).alias("actions")))


def with_history_block(
    df: DataFrame,
    length: int = HISTORY_LENGTH,
    num_hashes: int = 2,
    table_size: int = TABLE_SIZE,
    log: DataFrame | None = None,
    hot_rows: int = HOT_ROWS,
    stored_only: bool = False,
) -> DataFrame:
    """The four history arrays of every row.

    A stored history is used where a row has one, with clicks standing in for
    its unknown actions; else the latest interactions strictly before the row.
    ``log`` gives those interactions when ``df`` is only a part of the log.
    ``stored_only`` uses stored histories for all rows and moves no row.
    """
    if stored_only:
        blocks = history_blocks(F.col("_steps"), length, num_hashes, table_size)
        steps = F.slice(_prebuilt_steps(), 1, length)
        return df.withColumn("_steps", steps).withColumns(blocks).drop("_steps")
    source = df if log is None else log
    prior = with_prior_history(source, length, ("item_id", *ACTIONS), "_prior", hot_rows)
    if log is not None:
        prior = df.join(prior.select("row_id", "_prior"), "row_id")
    stored = F.size("hist_items") > 0 if "hist_items" in df.columns else F.lit(False)
    if "hist_items" in df.columns:
        steps = F.when(stored, _prebuilt_steps()).otherwise(_recorded_steps())
    else:
        steps = _recorded_steps()
    blocks = history_blocks(F.col("_steps"), length, num_hashes, table_size)
    return prior.withColumn("_steps", F.slice(steps, 1, length)).withColumns(blocks).drop("_steps", "_prior")


def _hashed_candidates(num_hashes: int, table_size: int) -> dict[str, Column]:
    def each(f) -> Column:
        return F.transform("candidates", f)

    return {
        "candidate_item_hashes": each(lambda c: multi_hash(c["item_id"], num_hashes, table_size)),
        "candidate_author_hashes": each(lambda c: author_hash(c["item_id"], num_hashes, table_size)),
        "candidate_surface": each(lambda c: product_surface(c["item_id"])),
        "labels": each(lambda c: c["labels"]),
    }


def training_rows(
    df: DataFrame,
    positives: DataFrame,
    pool: DataFrame,
    num_negatives: int = 4,
    history_length: int = HISTORY_LENGTH,
    num_hashes: int = 2,
    table_size: int = TABLE_SIZE,
    seed: int = 42,
    epoch: int = 0,
    log: DataFrame | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Hashed training rows; another ``epoch`` draws and shuffles anew."""
    drawn = seed + epoch * EPOCH_STRIDE
    history = with_history_block(df, history_length, num_hashes, table_size, log, hot_rows)
    negatives = pool_negatives(_samples(df), positives, pool, num_negatives, drawn, hot_rows)
    rows = with_candidates(history, negatives, drawn + SHUFFLE_SHIFT)
    rows = rows.withColumn("user_hashes", multi_hash(F.col("user_id"), num_hashes, table_size))
    hashed = _hashed_candidates(num_hashes, table_size)
    return rows.withColumns(hashed).select(
        F.col("row_id").alias("sample_id"),
        "user_hashes",
        "history_item_hashes",
        "history_author_hashes",
        "history_actions",
        "history_surface",
        *hashed,
    )


def raw_training_rows(
    df: DataFrame,
    positives: DataFrame,
    pool: DataFrame,
    item_dim: DataFrame,
    num_negatives: int = 4,
    history_length: int = 10,
    seed: int = 42,
    epoch: int = 0,
) -> DataFrame:
    """Training rows with raw ids, side information and candidate categories."""
    drawn = seed + epoch * EPOCH_STRIDE
    negatives = pool_negatives(_samples(df), positives, pool, num_negatives, drawn)
    rows = with_candidates(df, negatives, drawn + SHUFFLE_SHIFT)
    flat = rows.select(
        F.col("row_id").alias("sample_id"), F.posexplode("candidates").alias("cand_pos", "c")
    ).select("sample_id", "cand_pos", "c.item_id", "c.labels")
    known = flat.join(item_dim.select("item_id", "category"), "item_id", "left")
    element = F.struct("cand_pos", "item_id", F.coalesce("category", F.lit(0)).alias("category"), "labels")
    lists = known.groupBy("sample_id").agg(F.sort_array(F.collect_list(element)).alias("_c"))
    padded = pad_history(F.col("hist_items"), history_length)
    side = df.select(F.col("row_id").alias("sample_id"), "user_id", "gender", "age", padded.alias("history_item_ids"))
    return side.join(lists, "sample_id").select(
        "sample_id",
        "user_id",
        "gender",
        "age",
        "history_item_ids",
        placeholder_actions(F.col("history_item_ids")).alias("history_actions"),
        F.transform("_c", lambda c: c["item_id"]).alias("candidate_item_ids"),
        F.transform("_c", lambda c: c["category"]).alias("candidate_categories"),
        F.transform("_c", lambda c: c["labels"]).alias("labels"),
    )


def evaluation_rows(
    df: DataFrame,
    positives: DataFrame,
    pool: DataFrame,
    num_negatives: int = 127,
    history_length: int = HISTORY_LENGTH,
    table_size: int = TABLE_SIZE,
    seed: int = 42,
) -> DataFrame:
    """The evaluation table: first hash of every id, fixed draws and order."""
    negatives = slot_negatives(_samples(df), positives, pool, num_negatives, seed)
    rows = with_candidates(df, negatives, seed + SHUFFLE_SHIFT)
    padded = pad_history(F.col("hist_items"), history_length)
    zero = F.lit(0).cast("bigint")
    hashed = F.transform("_padded", lambda x: F.when(x == 0, zero).otherwise(table_hash(x, 0, table_size)))
    return rows.withColumn("_padded", padded).select(
        F.col("row_id").alias("sample_id"),
        table_hash(F.col("user_id"), 0, table_size).alias("user_ids"),
        hashed.alias("history_item_ids"),
        placeholder_actions(F.col("_padded")).alias("history_actions"),
        F.transform("candidates", lambda c: table_hash(c["item_id"], 0, table_size)).alias("candidate_item_ids"),
        F.transform("candidates", lambda c: c["labels"]).alias("labels"),
    )


def candidate_rows(df: DataFrame, negatives: DataFrame, seed: int) -> DataFrame:
    """Candidate lists in long form: one row per sample and shuffled place."""
    rows = with_candidates(df, negatives, seed + SHUFFLE_SHIFT)
    flat = rows.select(F.col("row_id").alias("sample_id"), "user_id", F.posexplode("candidates").alias("cand_pos", "c"))
    labels = [F.get(F.col("c.labels"), F.lit(i)).cast("int").alias(a) for i, a in enumerate(ACTIONS)]
    return flat.select("sample_id", "user_id", "cand_pos", F.col("c.origin").alias("origin"), F.col("c.item_id").alias("item_id"), *labels)


def demo_rows(
    df: DataFrame, positives: DataFrame, pool: DataFrame, num_negatives: int = 9, history_length: int = 10, seed: int = 42
) -> DataFrame:
    """First row of each user that has a history, with its candidates unshuffled."""
    first = rows_of_first_positions(df)
    negatives = filled_negatives(_samples(first), positives, pool, num_negatives, seed)
    rows = _with_negatives(first, negatives)
    return rows.select(
        F.col("row_id").alias("sample_id"),
        "user_id",
        pad_history(F.col("hist_items"), history_length).alias("history_item_ids"),
        F.concat(F.array("item_id"), F.col("negatives")).alias("candidate_item_ids"),
    )


def with_stored_history(df: DataFrame, length: int = 10) -> DataFrame:
    """Fill ``hist_items`` from the log itself, for logs that carry none."""
    return with_history_items(df.drop("hist_items"), length)
