"""Stages of the pipeline hand texts to Python in bounded batches, and encoders remember a bounded number of pieces."""

import pyarrow as pa
import public_tokenizers

import corpus_pipeline
from feedforge.llm import tokens


def test_stages_bound_the_batches_of_a_worker(spark):
    before = {name: spark.conf.get(name) for name in corpus_pipeline.BATCHES}
    docs = spark.range(5000, numPartitions=1).selectExpr("id AS doc_id", "concat('call 10.0.0.1 or ', id) AS text")

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows]})

    try:
        rows = corpus_pipeline.masked(spark, docs, "")
        assert rows.filter("text LIKE 'call <IP> or %'").count() == 5000
        assert max(r.n for r in docs.mapInArrow(sizes, "n long").collect()) <= 1000
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def test_memory_of_pieces_starts_anew(monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 50)
    encoder = tokens.Encoder(public_tokenizers.path("byte_bpe_50k.json"), False)
    for i in range(40):
        text = " ".join(f"word{i}x{j}," for j in range(10))
        ids, _ = encoder.encode([text])
        assert ids.tolist() == [*encoder.encode_batch([text], add_special_tokens=False)[0].ids, 1]
        assert len(encoder.rest.memory) < 100
