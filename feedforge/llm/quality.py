"""Quality rules with thresholds learned from the corpus itself (operator 1); built-in functions only.

Rates of each document go to quantile sketches per language and source. A sketch is a table of counts per bucket, with
buckets of at most 1/32 relative width, so sketches merge by adding counts: those of a language's sources give the
language's sketch, those of all languages the corpus's. A document is rejected if one of its rates lies above
``median + SPREAD * (median - tenth percentile) + slack`` of its language and source; groups of fewer than ``LEAST``
documents use their language's sketch, small languages the corpus's. Lower quantiles alone enter the threshold, so it
holds as long as less than half of a group is junk, and no fixed share of clean documents is lost.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedforge.session import written

SPACE = r"[\x20\x09-\x0D]+"
WINDOW = 8
LEAST = 200
SPREAD = 4
#: What a rate may always exceed the spread by: symbols and marks per 1000 words, capitals per 1000 letters of words,
#: repeated lines per 1000 lines.
SLACK = {"symbol_rate": 100, "mark_rate": 150, "capital_rate": 150, "dup_line_rate": 500}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value that is computed once per row."""
    return F.transform(F.array(value), body)[0]


def repeated_words(words: Column, width: int = WINDOW) -> Column:
    """Words of an array that lie in windows of ``width`` words found twice or more in it, the first ones included."""

    def covered(windows: Column) -> Column:
        placed = F.array_sort(F.zip_with(windows, F.sequence(F.lit(0), F.size(windows) - 1), lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return let(placed, lambda s: let(same_as_next(s), lambda same: cover(places(s, same))))

    def same_as_next(s: Column) -> Column:
        return F.zip_with(s, F.slice(s, 2, F.size(s)), lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False)))

    def places(s: Column, same: Column) -> Column:
        before = F.concat(F.array(F.lit(False)), F.slice(same, 1, F.size(same) - 1))
        either = F.zip_with(same, before, lambda a, b: a | b)
        marked = F.zip_with(s, either, lambda x, m: F.when(m, x["i"]))
        return F.array_sort(F.array_compact(marked))

    def cover(at: Column) -> Column:
        return let(
            at,
            lambda p: F.aggregate(
                F.zip_with(p, F.slice(p, 2, F.size(p)), lambda a, b: F.least(F.coalesce(b - a, F.lit(width)), F.lit(width))),
                F.lit(0),
                lambda total, x: total + x,
            ),
        )

    windows = F.transform(
        F.sequence(F.lit(1), F.size(words) - (width - 1)), lambda i: F.xxhash64(F.slice(words, i, width))
    )
    found = let(
        windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h))
    )
    return F.when(F.size(words) <= width, F.lit(0)).otherwise(found)


def _kept_length(text: Column, drop: str) -> Column:
    return F.length(F.regexp_replace(text, drop, ""))


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the struct ``quality_of``: counts, rates and the base verdict. A null text has no words."""
    whole = F.coalesce(F.col(text), F.lit(""))
    counts = let(
        F.array_remove(F.split(whole, SPACE), ""),
        lambda words: F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            repeated_words(words).cast("long").alias("n_repeat_words"),
        ),
    )
    lines = let(
        F.filter(F.split(whole, "\n"), lambda line: F.length(F.regexp_replace(line, SPACE, "")) > 0),
        lambda some: F.struct(
            F.size(some).cast("long").alias("n_lines"),
            (F.size(some) - F.size(F.array_distinct(some))).cast("long").alias("n_dup_lines"),
        ),
    )
    symbols = _kept_length(whole, r"[^#*$%&|<>]+").cast("long")
    return docs.withColumn(
        "quality_of",
        let(
            F.struct(
                counts.alias("c"),
                lines.alias("l"),
                symbols.alias("n_symbols"),
                _kept_length(whole, r"[^!?]+").cast("long").alias("marks"),
                _kept_length(whole, r"[^A-Z]+").cast("long").alias("capitals"),
            ),
            lambda m: F.struct(
                *(m["c"][n].alias(n) for n in ("n_words", "word_chars")),
                m["n_symbols"].alias("n_symbols"),
                m["l"]["n_dup_lines"].alias("n_dup_lines"),
                m["c"]["n_repeat_words"].alias("n_repeat_words"),
                ((m["c"]["n_words"] < 20) | (100 * m["c"]["n_repeat_words"] > 30 * m["c"]["n_words"])).alias("base_failed"),
                _rate(m["n_symbols"], m["c"]["n_words"]).alias("symbol_rate"),
                _rate(m["marks"], m["c"]["n_words"]).alias("mark_rate"),
                _rate(m["capitals"], m["c"]["word_chars"]).alias("capital_rate"),
                _rate(m["l"]["n_dup_lines"], m["l"]["n_lines"]).alias("dup_line_rate"),
            ),
        ),
    )


def _rate(part: Column, whole: Column) -> Column:
    return F.coalesce(F.floor(1000 * part / F.when(whole > 0, whole)), F.lit(0)).cast("long")


def bucket(value: Column) -> Column:
    """The lower end of a value's bucket: its five leading binary digits."""
    drop = F.greatest(F.length(F.bin(value)) - 6, F.lit(0))
    size = F.pow(F.lit(2.0), drop).cast("long")
    return F.floor(value / size).cast("long") * size


def sketches(rows: DataFrame) -> DataFrame:
    """Counts per (lang, source, rate, bucket) of rows with ``quality_of``; base failures do not count."""
    rates = F.explode(F.array(*(F.struct(F.lit(n).alias("rate"), bucket(F.col(f"quality_of.{n}")).alias("bucket")) for n in SLACK)))
    return (
        rows.filter(~F.col("quality_of.base_failed"))
        .select("lang", "source", rates.alias("r"))
        .groupBy("lang", "source", "r.rate", "r.bucket")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _quantiles(sketch: DataFrame, *keys: str) -> DataFrame:
    """Per key and rate: documents, median and tenth percentile of a (merged) sketch."""
    merged = sketch.groupBy(*keys, "rate", "bucket").agg(F.sum("n").alias("n"))
    window = Window.partitionBy(*keys, "rate")
    ordered = window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    ranked = merged.withColumns({"upto": F.sum("n").over(ordered), "total": F.sum("n").over(window)})
    at = lambda share: F.min(F.when(100 * F.col("upto") >= share * F.col("total"), F.col("bucket")))
    return ranked.groupBy(*keys, "rate").agg(
        F.max("total").alias("docs"), at(50).alias("middle"), at(10).alias("low")
    )


def thresholds(sketch: DataFrame, least: int = LEAST) -> DataFrame:
    """Upper bounds per lang and source: columns lang, source and one per rate. Null keys are groups of their own."""
    by_source = _quantiles(sketch, "lang", "source").alias("s")
    by_lang = _quantiles(sketch, "lang").alias("l")
    overall = _quantiles(sketch).alias("o")
    joined = by_source.join(
        by_lang, F.col("s.lang").eqNullSafe(F.col("l.lang")) & (F.col("s.rate") == F.col("l.rate"))
    ).join(overall, F.col("s.rate") == F.col("o.rate"))
    chosen = (
        F.when(F.col("s.docs") >= least, F.struct("s.middle", "s.low"))
        .when(F.col("l.docs") >= least, F.struct("l.middle", "l.low"))
        .otherwise(F.struct("o.middle", "o.low"))
    )
    bounds = joined.select("s.lang", "s.source", "s.rate", chosen.alias("q")).select(
        "lang", "source", "rate", (F.col("q.middle") + SPREAD * (F.col("q.middle") - F.col("q.low"))).alias("bound")
    )
    return bounds.groupBy("lang", "source").agg(
        *((F.max(F.when(F.col("rate") == n, F.col("bound"))) + s).alias(n) for n, s in SLACK.items())
    )


def judged(measured_rows: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """Rows of :func:`measured` with ``quality_of`` and ``kept``, judged by thresholds of the whole table.

    The rows are computed once and written to the shared folder; the sketch reads their narrow columns, the join the rest. Sketches are added up within each task before the shuffle, so a hot source costs no more than others;
    the table of thresholds is written first, so Spark knows its size and broadcasts it only if that is small, else it
    splits a hot source's join. Rows, repeated or not, are judged one by one and none is lost: null texts fail the base
    rules, null languages and sources form groups of their own, and an empty table gives an empty result. Other
    columns pass through.
    """
    rows = written(measured_rows, "quality")
    bounds = written(thresholds(sketches(rows.withColumns({"lang": F.col(lang), "source": F.col(source)}))), "thresholds")
    r, b = rows.alias("r"), bounds.alias("b")
    joined = r.join(b, F.col(f"r.{lang}").eqNullSafe(F.col("b.lang")) & F.col(f"r.{source}").eqNullSafe(F.col("b.source")), "left")
    low = [F.col(f"r.quality_of.{n}") <= F.col(f"b.{n}") for n in SLACK]
    verdict = low[0]
    for one in low[1:]:
        verdict = verdict & one
    kept = ~F.col("r.quality_of.base_failed") & F.coalesce(verdict, F.lit(False))
    return joined.select("r.*", kept.alias("kept"))


def scores(docs: DataFrame) -> DataFrame:
    """Counts, base verdict and verdict per document."""
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    return judged(measured(docs.select("doc_id", "text", "lang", "source")).drop("text")).select(
        "doc_id", *(F.col(f"quality_of.{n}").alias(n) for n in names), "kept", *(F.col(f"quality_of.{n}").alias(n) for n in SLACK)
    )


def kept_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with their own columns, whatever names these have."""
    own = docs.columns
    plain = {c: c if c in ("text", "lang", "source") else f"its_{i}" for i, c in enumerate(own)}
    kept = judged(measured(docs.toDF(*plain.values()))).filter("kept")
    return kept.select(*plain.values()).toDF(*own)


_SQL_RATES = ", ".join(f"('{n}', {s})" for n, s in SLACK.items())
_SQL_BOUNDS = ", ".join(f"max(bound) filter (rate = '{n}') as {n}" for n in SLACK)
_SQL_WITHIN = " and ".join(f"m.{n} <= b.{n}" for n in SLACK)
_SQL_LONG = " union all ".join(f"select lang, source, '{n}' as rate, {n} as v from rates where not base_failed" for n in SLACK)


def _sql_quantiles(*keys: str) -> str:
    by = ", ".join([*keys, "rate"])
    return f"""
  select {by}, max(total) as docs, min(bucket) filter (100 * upto >= 50 * total) as middle,
    min(bucket) filter (100 * upto >= 10 * total) as low
  from (select {by}, bucket, sum(sum(n)) over (partition by {by} order by bucket) as upto,
      sum(sum(n)) over (partition by {by}) as total
    from sketch group by {by}, bucket) group by {by}"""


ORACLE_SQL = rf"""
with split as (
  select row_number() over () as r, doc_id, lang, source, coalesce(text, '') as t,
    list_filter(regexp_split_to_array(coalesce(text, ''), '{SPACE}'), lambda x: x <> '') as words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_replace(x, '{SPACE}', '', 'g') <> '') as lines
  from documents),
windows as (
  select r, unnest(g) as g, generate_subscripts(g, 1) as i
  from (select r, list_transform(range(1, len(words) - {WINDOW - 2}), lambda i: array_to_string(words[i : i + {WINDOW - 1}], ' ')) as g
    from split)),
places as (select r, i from (select r, i, count(*) over (partition by r, g) as c from windows) where c > 1),
repeated as (
  select r, sum(least(coalesce(following - i, {WINDOW}), {WINDOW})) as n
  from (select r, i, lead(i) over (partition by r order by i) as following from places) group by r),
counted as (
  select s.r, doc_id, lang, source, len(words) as n_words, length(array_to_string(words, '')) as word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) as n_symbols, len(lines) as n_lines,
    len(lines) - len(list_distinct(lines)) as n_dup_lines, coalesce(p.n, 0)::bigint as n_repeat_words,
    length(regexp_replace(t, '[^!?]+', '', 'g')) as marks, length(regexp_replace(t, '[^A-Z]+', '', 'g')) as capitals
  from split s left join repeated p on s.r = p.r),
rates as (
  select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed,
    coalesce(1000 * n_symbols // nullif(n_words, 0), 0) as symbol_rate,
    coalesce(1000 * marks // nullif(n_words, 0), 0) as mark_rate,
    coalesce(1000 * capitals // nullif(word_chars, 0), 0) as capital_rate,
    coalesce(1000 * n_dup_lines // nullif(n_lines, 0), 0) as dup_line_rate
  from counted),
long as ({_SQL_LONG}),
sketch as (
  select lang, source, rate, v - v % (1::bigint << greatest(length(bin(v)) - 6, 0)) as bucket, count(*) as n
  from long group by all),
by_source as ({_sql_quantiles("lang", "source")}),
by_lang as ({_sql_quantiles("lang")}),
overall as ({_sql_quantiles()}),
chosen as (
  select s.lang, s.source, s.rate, case when s.docs >= {LEAST} then [s.middle, s.low]
    when l.docs >= {LEAST} then [l.middle, l.low] else [o.middle, o.low] end as q
  from by_source s join by_lang l on s.lang is not distinct from l.lang and s.rate = l.rate join overall o on s.rate = o.rate),
bounds as (
  select lang, source, {_SQL_BOUNDS}
  from (select lang, source, rate, q[1] + {SPREAD} * (q[1] - q[2]) + slack as bound
    from chosen join (values {_SQL_RATES}) k(rate, slack) using (rate))
  group by lang, source)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and coalesce({_SQL_WITHIN}, false) as kept, {", ".join(f"m.{n}" for n in SLACK)}
from rates m left join bounds b on m.lang is not distinct from b.lang and m.source is not distinct from b.source
"""
