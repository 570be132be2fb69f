import tracemalloc

import numpy as np
import pyarrow as pa

from shorewise.llm import language_id as L


def test_a_batch_is_ranked_in_small_pieces():
    """Two million letters in one batch: what numpy holds at a time is that of a small piece."""
    texts = [f"word{k} of the text {k % 97} " * 40 for k in range(2500)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])
    profiles = {"a": np.arange(1, 400, dtype=np.uint64), "b": np.arange(400, 800, dtype=np.uint64)}
    L._letters()
    tracemalloc.start()
    try:
        rows = sum(b.num_rows for b in L._identified(profiles, L.PROFILE)(iter([batch])))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert rows == len(texts) and peak < 60_000_000, peak


def test_rows_go_on_piece_by_piece():
    """Python has the texts of one piece at a time, and what goes back is no longer than a piece."""
    texts = [f"word{k} of the text {k % 97} " * 400 for k in range(2500)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])
    profiles, size = {"a": np.arange(1, 400, dtype=np.uint64)}, sum(map(len, texts))
    L._letters()
    tracemalloc.start()
    try:
        out = [b.num_rows for b in L._identified(profiles, L.PROFILE)(iter([batch]))]
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert sum(out) == len(texts) and max(out) * (size / len(texts)) < 2 * L._CHUNK_CHARS and peak < size, (out[:3], peak)
