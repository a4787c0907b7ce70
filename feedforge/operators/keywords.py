"""Which of many keywords a text contains."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedforge.session import written

#: Bytes of keywords in one automaton; its nodes take some 50 times as much in each Python worker.
ROUND_BYTES = 2 << 20


def _search(words: Broadcast):
    """Rows whose last column is a lowered text, to one row for each keyword found in it, that keyword in the text's place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from ahocorasick import Automaton

        automaton = Automaton()
        for word in words.value:
            if word:
                automaton.add_word(word, word)
        automaton.make_automaton()
        always = [""] if "" in words.value else []
        for batch in batches:
            rows, found = [], []
            for row, text in enumerate(batch.column(batch.num_columns - 1)):
                text = text.as_py()
                hits = {word for _, word in automaton.iter(text)} if len(automaton) else ()
                found += [*always, *hits]
                rows += [row] * (len(always) + len(hits))
            kept = batch.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns[:-1], pa.array(found, pa.string())], schema=batch.schema)

    return run


def found_keywords(texts: DataFrame, keywords: DataFrame, text: str = "text", round_bytes: int = ROUND_BYTES) -> DataFrame:
    """One row per row of ``texts`` and distinct keyword that its text contains, the text replaced by ``_word``.

    ``keywords`` has a column ``_word``, lower case as the search lowers texts. All distinct keywords are searched for at once by an
    Aho-Corasick automaton, built in each task from a broadcast list, so texts are read once and never shuffled, whatever
    the number of keywords. A list longer than ``round_bytes`` is dealt by hash to as many rounds as it needs, with one
    scan each. A null text or keyword matches nothing, an empty keyword every text that is not null.
    """
    spark = texts.sparkSession
    words = written(keywords.select("_word").where("_word IS NOT NULL").distinct(), "keywords")
    size = words.agg(F.sum(F.octet_length("_word") + 1)).first()[0] or 0
    rounds = max(1, -(-size // round_bytes))
    others = [c for c in texts.columns if c != text]
    lowered = texts.where(F.col(text).isNotNull()).select(*others, F.lower(text).alias("_word"))
    found = None
    for at in range(rounds):
        own = words.where(F.pmod(F.xxhash64("_word"), F.lit(rounds)) == at)
        sent = spark.sparkContext.broadcast([r[0] for r in own.collect()])
        hits = lowered.mapInArrow(_search(sent), lowered.schema)
        found = hits if found is None else found.unionByName(hits)
    return found
