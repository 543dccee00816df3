"""What a task of anchors holds stays bounded."""

import tracemalloc

import numpy as np
import pyarrow as pa

from lodestrata.llm import suffix_dedup as sd
from lodestrata.llm.hashing import mix


def test_a_task_of_anchors_holds_little():
    """Texts of 2 MB, and one of 2 MB, in a batch; anchors are those of each text alone."""
    rng = np.random.default_rng(5)
    for size, n in ((1 << 18, 8), (1 << 21, 1)):
        texts = [rng.integers(97, 123, size, dtype=np.uint8).tobytes().decode() for _ in range(n)]
        batch = pa.RecordBatch.from_arrays([pa.array([bytes([i]) * 16 for i in range(n)]), pa.array(texts)], names=["t", "text"])
        sd.anchors([b"x" * (1 << 21)])  # tables of powers stay
        tracemalloc.start()
        rows = list(sd._send_hashes(1)(iter([batch])))
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert most < 80 << 20
        sent = np.concatenate([np.frombuffer(x, np.uint32) for r in rows for x in r.column(1).to_pylist()])
        alone = np.concatenate([sd._anchors([t.encode()])[2] for t in texts])
        assert sorted(sent.tolist()) == sorted((mix(alone) & np.uint64(0xFFFFFFFF)).tolist())


def test_buckets_of_anchors_are_even():
    """Also of anchors, which are the least hashes of their windows."""
    text = np.random.default_rng(6).integers(97, 123, 1 << 19, dtype=np.uint8).tobytes().decode()
    batch = pa.RecordBatch.from_arrays([pa.array([b"k" * 16]), pa.array([text])], names=["t", "text"])
    sizes = [len(x) // 4 for r in sd._send_hashes(40)(iter([batch])) for x in r.column(1).to_pylist()]
    assert len(sizes) == 40 and max(sizes) < 2 * sum(sizes) / 40
