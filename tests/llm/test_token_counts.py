"""Frequent tokens are found from every pair of text and token, and long words have fingerprints of their own."""

import numpy as np
import pyarrow as pa
import pytest

from feedforge.llm import similarity
from feedforge.llm.words import chunks


def fingerprints(texts):
    chunk = next(chunks([pa.RecordBatch.from_pydict({"text": texts})]))
    return similarity._sets(chunk, 5)


@pytest.mark.parametrize("at_once", [1 << 20, 50])
def test_every_token_of_enough_texts_is_frequent(spark, monkeypatch, at_once):
    monkeypatch.setattr(similarity, "COUNTED_AT_ONCE", at_once)
    texts = [f"one{g} two{g} three{g} four{g} five{g}" for g in range(40) for _ in range(g)] + ["", None, "one39"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs = docs.repartition(3)
    got = sorted(r.key for r in similarity._Join(docs, 5, 80, 32).counts(32).collect())
    tokens, _ = fingerprints([f"one{g} two{g} three{g} four{g} five{g}" for g in range(32, 40)])
    assert got == sorted(int(t) for t in tokens & np.uint64(0xFFFFFFFFFF00))


def test_words_of_swapped_letters_are_not_linked(spark):
    parity = [bin(i).count("1") & 1 for i in range(1 << 11)]
    texts = ["".join("ab"[p] for p in parity), "".join("ba"[p] for p in parity)]
    docs = spark.createDataFrame([(1, texts[0]), (2, texts[1]), (3, texts[0])], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in similarity.similar_texts(docs).collect()}
    assert got == {1: 1, 2: 2, 3: 1}
