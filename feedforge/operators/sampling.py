"""Reproducible negative sampling.

A sample is a row of ``samples(sample_id, user_id)``; ``positives`` has
(user_id, item_id). Every draw comes from :mod:`feedforge.functions.draws`.
Draws are made ahead in rounds: the first round is small, and only samples
that are still short draw again. Results are one row per sample with the
array ``negatives``, which holds at most the requested number of items.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from feedforge.functions.draws import PRIME, draw, mix, scaled, words
from feedforge.operators.index import BUCKETS, shuffled_index
from feedforge.operators.segments import HOT_ROWS, asc, row_number
from feedforge.session import written

ATTEMPTS_PER_NEGATIVE = 10
SLOT_TRIES = 100
# Fixed-point scale of popularity weights: sums of whole numbers do not
# depend on the order of addition.
WEIGHT_SCALE = 1_000_000
# Known items a user may have as one array; users with more are joined item by item.
SET_ITEMS = 4096
# Seeds of one sampler's own draws.
START, STRIDE, REFILL = 1_000_001, 1_000_002, 1_000_003


def _spread(samples: DataFrame) -> DataFrame:
    """Sample keys spread evenly before each becomes many draws.

    Two id columns are narrow and compress well, so one input split can hold
    very many samples; the draws made from them are many times larger, so the
    partitions are not merged by their size either.
    """
    width = int(samples.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return samples.select("sample_id", "user_id").repartition(width, "sample_id", "user_id")


def _steps(samples: DataFrame, first: int, stop: int | Column) -> DataFrame:
    """Samples repeated for the attempts ``first .. stop - 1``."""
    last = (F.lit(stop) if isinstance(stop, int) else stop).cast("bigint") - 1
    begin = F.lit(first).cast("bigint")
    steps = F.when(last >= begin, F.sequence(begin, last, F.lit(1).cast("bigint")))
    return samples.withColumn("step", F.explode(steps))


@dataclass(frozen=True)
class _Known:
    """Distinct positives: as pairs, as one array per user, and the users with too many for an array, or None."""

    pairs: DataFrame
    sets: DataFrame
    large: DataFrame | None


def _known(positives: DataFrame, set_items: int | None = None) -> _Known:
    """Distinct positives, written once for all rounds."""
    most = SET_ITEMS if set_items is None else set_items
    pairs = written(positives.select("user_id", "item_id").distinct(), "positives")
    large = pairs.groupBy("user_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > most).select("user_id")
    large = written(large, "large-users")
    if large.isEmpty():
        large = None
    small = pairs if large is None else pairs.join(large, "user_id", "left_anti")
    sets = small.where("user_id IS NOT NULL").groupBy("user_id").agg(F.collect_list("item_id").alias("_known"))
    return _Known(pairs, written(sets, "known-sets"), large)


def _indexed(pool: DataFrame, seed: int) -> DataFrame:
    """Distinct pool items in a seeded order, written once for all rounds."""
    return written(shuffled_index(pool.select("item_id").distinct(), "item_id", seed), "pool")


def _checked(draws: DataFrame, known: _Known, whole: bool = False) -> DataFrame:
    """Per sample its drawn items by attempt, ``_draws``, and ``_known``, which holds those of them that the user knows.

    With ``whole`` an element of ``_draws`` is (step, item_id). A sample's draws become one array before they meet the user's
    known items, so one row per sample travels and not one per draw. ``_known`` may hold other items of the user, or be null.
    """
    keys = ["sample_id", "user_id"]
    in_order = F.sort_array(F.collect_list(F.struct("step", "item_id")))
    drawn = (in_order if whole else F.transform(in_order, lambda h: h["item_id"])).alias("_draws")
    if known.large is None:
        return draws.groupBy(*keys).agg(drawn).join(known.sets, "user_id", "left")
    own = draws.join(known.large, "user_id", "left_anti").groupBy(*keys).agg(drawn).join(known.sets, "user_id", "left")
    pairs = known.pairs.withColumn("_is_known", F.lit(True))
    wide = draws.join(known.large, "user_id", "left_semi").join(pairs, ["user_id", "item_id"], "left")
    wide = wide.groupBy(*keys).agg(drawn, F.collect_set(F.when(F.col("_is_known"), F.col("item_id"))).alias("_known"))
    return own.unionByName(wide)


def _free(item: Column) -> Column:
    """Whether an item is none of the user's known ones."""
    return ~F.coalesce(F.array_contains("_known", item), F.lit(False))


def _first_accepted(draws: DataFrame, n: int, known: _Known) -> DataFrame:
    """First ``n`` drawn items per sample by attempt that are not known. Samples with none stay."""
    items = F.slice(F.filter("_draws", _free), 1, n)
    return _checked(draws, known).select("sample_id", "user_id", items.alias("negatives"))


def _first_drawn(draws: DataFrame, n: int) -> DataFrame:
    """First ``n`` drawn items per sample by attempt."""
    hits = F.sort_array(F.collect_list(F.struct("step", "item_id")))
    items = F.transform(F.slice(hits, 1, n), lambda h: h["item_id"])
    return draws.groupBy("sample_id", "user_id").agg(items.alias("negatives"))


def _short(found: DataFrame, n: int) -> DataFrame:
    return found.where(F.size("negatives") < n)


def _enough(found: DataFrame, n: int) -> DataFrame:
    return found.where(F.size("negatives") >= n)


def _rounds(samples: DataFrame, n: int, stops: list[int], sample_round) -> DataFrame:
    """Run rounds of attempts; each round serves the samples still short.

    A round's result is written before the next one reads it twice, so no
    draw is repeated. Rounds end as soon as no sample is short.
    """
    found = written(sample_round(_steps(_spread(samples), 0, stops[0])), "negatives")
    for begin, stop in zip(stops, stops[1:]):
        short = _short(found, n).withColumnRenamed("negatives", "_have")
        if stop <= begin or short.isEmpty():
            break
        again = sample_round(_steps(_spread(short), begin, stop))
        again = short.join(again.withColumnRenamed("negatives", "_more"), ["sample_id", "user_id"], "left")
        have = F.when(F.col("_more").isNull(), F.col("_have")).otherwise(F.concat("_have", "_more"))
        topped = written(again.select("sample_id", "user_id", F.slice(have, 1, n).alias("negatives")), "negatives")
        found = _enough(found, n).unionByName(topped)
    return found


def uniform_negatives(
    samples: DataFrame, positives: DataFrame, pool_size: int | Column, n: int, seed: int = 42
) -> DataFrame:
    """Up to ``n`` draws from ``[0, pool_size)`` that are not positives.

    Items may repeat. Each sample makes at most ``10 n`` attempts.
    """

    known = _known(positives)

    def one_round(steps: DataFrame) -> DataFrame:
        item = draw(F.col("sample_id"), seed, F.col("step"), pool_size)
        return _first_accepted(steps.withColumn("item_id", item), n, known)

    return _rounds(samples, n, [2 * n, ATTEMPTS_PER_NEGATIVE * n], one_round)


def user_negatives(positives: DataFrame, pool_size: int | Column, n: int, seed: int = 42) -> DataFrame:
    """:func:`uniform_negatives` with one sample per user."""
    users = positives.select("user_id").distinct().withColumn("sample_id", F.col("user_id"))
    return uniform_negatives(users, positives, pool_size, n, seed)


def popularity_ranges(frequencies: DataFrame, power: float = 0.75, seed: int = 0) -> DataFrame:
    """Each item's share ``[lo, hi)`` of the summed weights ``frequency ** power``.

    Items lie in a seeded hash order, so ranges are summed per hash bucket and
    only bucket totals are ordered globally.
    """
    weight = F.round(F.pow(F.col("frequency").cast("double"), F.lit(power)) * WEIGHT_SCALE).cast("bigint")
    width = F.lit(PRIME // BUCKETS + 1).cast("bigint")
    hashed = frequencies.select("item_id", weight.alias("_w"), mix(F.col("item_id"), seed).alias("_hash"))
    hashed = hashed.withColumn("_bucket", F.floor(F.col("_hash") / width).cast("int"))
    earlier = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = hashed.groupBy("_bucket").agg(F.sum("_w").alias("_sum"))
    offsets = sums.select("_bucket", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_offset"))
    upto = Window.partitionBy("_bucket").orderBy("_hash", "item_id")
    placed = hashed.withColumn("_until", F.sum("_w").over(upto)).join(F.broadcast(offsets), "_bucket")
    hi = F.col("_offset") + F.col("_until")
    return placed.select("item_id", (hi - F.col("_w")).alias("lo"), hi.alias("hi"))


def popularity_negatives(
    samples: DataFrame,
    positives: DataFrame,
    frequencies: DataFrame,
    n: int,
    power: float = 0.75,
    seed: int = 42,
) -> DataFrame:
    """Up to ``n`` draws with probability ``frequency ** power``, not positives.

    A draw is a point of the summed weights, of 62 bits, so an item of any
    share can be drawn. Points and item ranges meet on equal cells of the
    line, one cell per item on average.
    """
    frequencies = written(frequencies.select("item_id", "frequency"), "frequencies")
    weight = F.round(F.pow(F.col("frequency").cast("double"), F.lit(power)) * WEIGHT_SCALE).cast("bigint")
    sums = frequencies.agg(F.sum(weight).alias("total"), F.count(F.lit(1)).alias("items"))
    total = sums.select("total").scalar()
    cell_width = sums.select((F.floor(F.col("total") / F.col("items")) + 1).cast("bigint")).scalar()
    known = _known(positives)
    ranges = written(popularity_ranges(frequencies, power), "ranges").where(F.col("hi") > F.col("lo"))
    cells = F.sequence(F.floor(F.col("lo") / cell_width), F.floor((F.col("hi") - 1) / cell_width))
    ranges = ranges.withColumn("_cell", F.explode(cells))

    def one_round(steps: DataFrame) -> DataFrame:
        first, second = words(F.col("sample_id"), seed, F.col("step"))
        drawn = steps.withColumns({"_first": first, "_second": second})
        # A generated column is computed once; an expression would be repeated in the join's conditions.
        drawn = drawn.withColumn("_point", F.explode(F.array(scaled(F.col("_first"), F.col("_second"), total))))
        drawn = drawn.drop("_first", "_second").withColumn("_cell", F.floor(F.col("_point") / cell_width))
        inside = (F.col("_point") >= F.col("lo")) & (F.col("_point") < F.col("hi"))
        hits = drawn.join(ranges, "_cell").where(inside).drop("_cell", "_point", "lo", "hi")
        return _first_accepted(hits, n, known)

    found = _rounds(samples, n, [2 * n, ATTEMPTS_PER_NEGATIVE * n], one_round)
    return _with_every_sample(samples, found)


def _with_every_sample(samples: DataFrame, found: DataFrame) -> DataFrame:
    """Samples that found nothing get an empty array."""
    keys = ["sample_id", "user_id"]
    empty = F.array().cast("array<bigint>")
    joined = samples.select(*keys).join(found, keys, "left")
    return joined.withColumn("negatives", F.coalesce("negatives", empty))


def next_prime(value: int) -> int:
    """Smallest prime that is not below ``value``."""
    candidate = max(value, 2)
    while any(candidate % d == 0 for d in range(2, int(candidate**0.5) + 1)):
        candidate += 1
    return candidate


def pool_negatives(
    samples: DataFrame,
    positives: DataFrame,
    pool: DataFrame,
    n: int,
    seed: int = 42,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """``n`` different items of ``pool`` that are not positives.

    A sample walks through the pool with its own start and stride modulo a
    prime, so it meets no item twice. Users whose positives cover almost the
    whole pool are short after the walk; for them the difference of pool and
    positives is built, which is no larger than their positives. When it has
    fewer than ``n`` items they repeat; when it is empty so is the result.
    """
    indexed, known = _indexed(pool, seed), _known(positives)
    size = indexed.count()
    if size == 0:
        return _with_every_sample(samples, samples.select("sample_id", "user_id").limit(0).withColumn(
            "negatives", F.array().cast("array<bigint>")))
    prime = next_prime(size)
    modulus = F.lit(prime).cast("bigint")

    def one_round(steps: DataFrame) -> DataFrame:
        start = F.pmod(mix(F.col("sample_id"), seed, START), modulus)
        stride = F.lit(1) + F.pmod(mix(F.col("sample_id"), seed, STRIDE), modulus - F.lit(1))
        at = F.pmod(start + F.col("step") * stride, modulus)
        drawn = steps.withColumn("idx", at).join(indexed, "idx", "left").drop("idx")
        # Places beyond the pool hold no item.
        items = F.slice(F.filter("_draws", lambda x: x.isNotNull() & _free(x)), 1, n)
        return _checked(drawn, known).select("sample_id", "user_id", items.alias("negatives"))

    stops = [min(4 * n, prime), min(68 * n, prime)]
    found = _rounds(samples, n, stops, one_round)

    short = _short(found, n).select("sample_id", "user_id")
    if short.isEmpty():
        return found
    left = written(_difference(short.select("user_id").distinct(), known.pairs, indexed, size), "difference")
    left = row_number(left, ["user_id"], [asc("idx")], "_k", hot_rows)
    counts = left.groupBy("user_id").agg(F.count(F.lit(1)).alias("_left"))
    slots = short.join(counts, "user_id").withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    start = F.pmod(mix(F.col("sample_id"), seed, START), F.col("_left"))
    spread = F.pmod(start + F.col("step") * F.floor(F.col("_left") / n), F.col("_left"))
    repeat = F.pmod(mix(F.col("sample_id"), seed, F.lit(REFILL) + F.col("step")), F.col("_left"))
    place = F.when(F.col("_left") >= n, spread).otherwise(repeat) + 1
    picks = slots.withColumn("_k", place.cast("bigint")).join(left, ["user_id", "_k"])
    refilled = _first_drawn(picks, n)
    return _with_every_sample(samples, _enough(found, n).unionByName(refilled))


def _difference(users: DataFrame, known: DataFrame, indexed: DataFrame, size: int) -> DataFrame:
    """Pool items that are no positives of the given users, as (user_id, idx, item_id)."""
    block = 10_000
    blocks = F.sequence(F.lit(0), F.lit((size - 1) // block))
    spread = users.withColumn("_block", F.explode(blocks)).repartition("user_id", "_block")
    begin = F.col("_block").cast("bigint") * block
    idx = F.explode(F.sequence(begin, F.least(begin + (block - 1), F.lit(size - 1).cast("bigint"))))
    pairs = spread.select("user_id", idx.alias("idx")).join(indexed, "idx")
    return pairs.join(known, ["user_id", "item_id"], "left_anti")


def slot_negatives(
    samples: DataFrame, positives: DataFrame, pool: DataFrame, n: int, seed: int = 42
) -> DataFrame:
    """Exactly ``n`` draws from ``pool`` per sample, with replacement.

    A draw that hits a positive is repeated up to 100 times, and then stays as
    first drawn. The pool must not be empty. Only open slots draw again; what
    a round found is written before the next one reads it, one row a sample.
    """
    indexed, known = _indexed(pool, seed), _known(positives)
    size = indexed.count()

    keys = ["sample_id", "user_id"]

    def tries(slots: DataFrame, first: int, stop: int) -> DataFrame:
        """Draws of slots; attempt ``try`` of a slot is step try * n + slot."""
        drawn = slots.withColumn("try", F.explode(F.sequence(F.lit(first), F.lit(stop - 1))))
        drawn = drawn.withColumn("step", F.col("try").cast("bigint") * n + F.col("slot")).drop("try", "slot")
        return drawn.withColumn("idx", draw(F.col("sample_id"), seed, F.col("step"), size)).join(indexed, "idx").drop("idx")

    slot = F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("slot")
    first = _checked(tries(_spread(samples).select(*keys, slot), 0, 1), known, whole=True)
    done = F.filter("_draws", lambda d: _free(d["item_id"])).alias("_done")
    state = written(first.select(*keys, done, F.filter("_draws", lambda d: ~_free(d["item_id"])).alias("_open")), "slots")
    found = state.where(F.size("_open") == 0).select(*keys, "_done")
    state = state.where(F.size("_open") > 0)
    for begin, stop in ((1, 9), (9, SLOT_TRIES + 1)):
        if state.isEmpty():
            break
        slots = F.explode(F.array_distinct(F.transform("_open", lambda d: d["step"])))
        again = state.repartition(*keys).select(*keys, slots.alias("slot"))
        checked = _checked(tries(again, begin, stop), known, whole=True)
        hits = checked.select(*keys, F.filter("_draws", lambda d: _free(d["item_id"])).alias("_hits"))
        tried = written(state.join(hits, keys, "left"), "slots")
        # Hits lie by attempt, so the first one of a slot is its earliest.
        own = lambda d: F.get(F.filter("_hits", lambda h: F.pmod(h["step"], F.lit(n)) == d["step"]), F.lit(0))
        got = F.transform("_open", lambda d: F.struct(d["step"].alias("step"), own(d)["item_id"].alias("item_id")))
        now = F.concat("_done", F.filter(got, lambda d: d["item_id"].isNotNull()))
        still = F.filter("_open", lambda d: own(d).isNull())
        state = tried.select(*keys, now.alias("_done"), still.alias("_open"))
        found = found.unionByName(state.where(F.size("_open") == 0).select(*keys, "_done"))
        state = state.where(F.size("_open") > 0)
    found = found.unionByName(state.select(*keys, F.concat("_done", "_open").alias("_done")))
    return found.select(*keys, F.transform(F.array_sort("_done"), lambda d: d["item_id"]).alias("negatives"))


def filled_negatives(
    samples: DataFrame, positives: DataFrame, pool: DataFrame, n: int, seed: int = 42
) -> DataFrame:
    """``n`` draws from ``pool``: up to ``5 n`` attempts avoid positives, the rest may hit them."""
    indexed, known = _indexed(pool, seed), _known(positives)
    size = indexed.count()

    def drawn(steps: DataFrame) -> DataFrame:
        return steps.withColumn("idx", draw(F.col("sample_id"), seed, F.col("step"), size)).join(indexed, "idx").drop("idx")

    def one_round(steps: DataFrame) -> DataFrame:
        return _first_accepted(drawn(steps), n, known)

    def fill_round(steps: DataFrame) -> DataFrame:
        return _first_drawn(drawn(steps), n)

    found = _rounds(samples, n, [2 * n, 5 * n], one_round)
    short = _short(found, n).withColumnRenamed("negatives", "_have")
    extra = fill_round(_steps(short.select("sample_id", "user_id"), 5 * n, 6 * n))
    both = short.join(extra, ["sample_id", "user_id"])
    topped = both.select("sample_id", "user_id", F.slice(F.concat("_have", "negatives"), 1, n).alias("negatives"))
    return _enough(found, n).unionByName(topped)


def pool_draws(samples: DataFrame, pool: DataFrame, seed: int = 42) -> DataFrame:
    """One random pool item per sample, positives not excluded."""
    pool = pool.select("item_id").distinct()
    indexed = shuffled_index(pool, "item_id", seed)
    size = pool.agg(F.count(F.lit(1)).alias("n")).scalar()
    drawn = samples.withColumn("idx", draw(F.col("sample_id"), seed, 1, size))
    return drawn.join(indexed, "idx").drop("idx")


def exploded(negatives: DataFrame) -> DataFrame:
    """One row per negative with its place, from 0."""
    return negatives.select("sample_id", "user_id", F.posexplode("negatives").alias("neg_pos", "item_id"))


def random_candidates(pool_size: int, n: int, seed: int, spark) -> DataFrame:
    """``n`` random item ids from ``[1, pool_size)``; ``n`` is a setting, not data."""
    ids = spark.range(n)
    return ids.select((draw(F.col("id"), seed, 0, pool_size - 1) + 1).alias("item_id"))


def popular_and_random(log: DataFrame, popular: DataFrame, pool_size: int, n_random: int, limit: int, seed: int = 42) -> DataFrame:
    """Popular items and random ones without repeats, at most ``limit``; popular first."""
    spark = log.sparkSession
    ranked = popular.select("item_id", F.lit(0).alias("origin"))
    extra = random_candidates(pool_size, n_random, seed, spark).select("item_id", F.lit(1).alias("origin"))
    union = ranked.unionByName(extra).groupBy("item_id").agg(F.min("origin").alias("origin"))
    return union.orderBy("origin", "item_id").limit(limit)


def pool_minus_positives(pool: DataFrame, positives: DataFrame, user_id: int) -> DataFrame:
    """Pool items one user has no interaction with."""
    mine = positives.where(F.col("user_id") == user_id).select("item_id")
    return pool.select("item_id").distinct().join(mine, "item_id", "left_anti")
