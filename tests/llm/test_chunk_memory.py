import tracemalloc

import numpy as np
import pyarrow as pa

from feedforge.llm.decontamination import _Stream
from feedforge.llm.similarity import _sets
from feedforge.llm.words import chunks


def batch():
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{n}" for n in rng.integers(0, 5000, 700)) for _ in range(1000)]
    return pa.RecordBatch.from_pydict({"doc_id": list(range(1000)), "text": texts})


def peak(work) -> int:
    own = batch()
    for chunk in chunks([own]):
        work(chunk)  # tables that stay are made here
        break
    tracemalloc.start()
    for chunk in chunks([own]):
        work(chunk)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return most


def test_what_a_worker_holds_beside_a_batch_is_small():
    """Several arrays of 8 bytes for each byte of a chunk live at once."""
    assert peak(_Stream) < 40 << 20
    assert peak(lambda chunk: _sets(chunk, 5)) < 40 << 20


def test_fingerprints_do_not_depend_on_chunks():
    own = batch()
    of = lambda limit: [np.concatenate([c.words(lower=True)[0] for c in chunks([own], limit=limit)])]
    small, large = of(64 << 10), of(16 << 20)
    assert np.array_equal(small[0], large[0])
