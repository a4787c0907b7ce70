"""Pieces are learnt once and ids travel as bytes, with the ids of the tokenizers library."""

import numpy as np
import public_tokenizers

from feedforge.llm import packing
from feedforge.llm.tokens import Encoder


def test_known_pieces_are_not_copied_for_each_chunk():
    encoder = Encoder(public_tokenizers.path("byte_bpe_50k.json"), False)
    rooms = set()
    for i in range(300):
        encoder.encode([f"begin{i} piece{i} and, more{i}; words"])
        rooms.add((encoder.rest.ids.room.__array_interface__["data"][0], len(encoder.rest.ids.room)))
    assert len(rooms) < 20


def test_pieces_with_tails_and_heads_equal_the_library():
    for name, dropped in (("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)):
        encoder = Encoder(public_tokenizers.path(name), dropped)
        texts = ["Stem, stem; stem,", "stem", "", "a  b\tc", "\nline\nstem,... (x) n0t3 déjà 漢字,", " lead", "tail "]
        for some in (texts[:2], texts, texts[::-1]):
            ids, bounds = encoder.encode(some)
            for text, a, b in zip(some, bounds[:-1], bounds[1:], strict=True):
                assert ids[a:b].tolist() == [*encoder.encode_batch([text], add_special_tokens=False)[0].ids, 1]


def test_ids_travel_as_bytes_of_any_width(spark):
    rows = packing._Rows(0)
    rows.close([(1, 0, np.array([1, 65535], np.int32), 2)])
    small = rows.batch()
    rows.close([(1, 0, np.array([1, 65536, 1 << 30], np.int32), 3), (2, 0, np.array([5], np.int32), 1)])
    large = rows.batch()
    assert [len(x) for b in (small, large) for x in b.column("ids").to_pylist()] == [4, 12, 4]
    found = [packing._ids(x, n).tolist() for b in (small, large) for x, n in zip(b.column("ids").to_pylist(), b.column("length").to_pylist())]
    assert found == [[1, 65535], [1, 65536, 1 << 30], [5]]
    docs = spark.createDataFrame([(i, f"words of text number {i}, " * (i % 9)) for i in range(200)], "doc_id long, text string")
    path = public_tokenizers.path("byte_bpe_50k.json")
    key = lambda r: (r.sequence_id, r.offset)
    bytes_ = sorted(packing.pack_bytes(docs, path).collect(), key=key)
    arrays = sorted(packing.pack(docs, path).collect(), key=key)
    assert [(*key(r), r.doc_id, packing._ids(r.ids, r.length).tolist()) for r in bytes_] == [(*key(r), r.doc_id, r.ids) for r in arrays]
