"""Chains read from Arrow buffers are aligned as their plain values are."""

import random

import numpy as np
import pyarrow as pa

from lakeloom.llm import chaining


def test_near_words_first_is_the_whole_extension(monkeypatch):
    rng = random.Random(3)
    for _ in range(2_000):
        x = [rng.randrange(3 if rng.random() < 0.2 else 10**6) for _ in range(rng.randrange(150))]
        y = [w if rng.random() < rng.choice([0.5, 0.9, 1]) else rng.randrange(10**6) for w in x[rng.randrange(2) :]]
        assert chaining._extend_from(np.array(x, np.uint64), np.array(y, np.uint64)) == chaining.extend(x, y)


def test_sliced_batches(monkeypatch):
    rng, rows = np.random.default_rng(4), []
    for k in range(40):
        words = rng.integers(0, 2**63, 300, dtype=np.uint64)
        other = words.copy()
        other[rng.integers(0, 300, 6)] = 1
        at = [100 + 64, 108 + 64, 116 + 64]
        rows.append({"doc": k + 50, "e_doc": k, "a_at": at[: 1 + k % 3], "b_at": [p + 64 for p in at[: 1 + k % 3]], "aw0": 64, "bw0": 128, "x": words.tobytes(), "y": other[: 300 - k].tobytes()})
    kinds = {"doc": pa.int64(), "e_doc": pa.int64(), "a_at": pa.list_(pa.int32()), "b_at": pa.list_(pa.int32()), "aw0": pa.int32(), "bw0": pa.int32(), "x": pa.binary(), "y": pa.binary()}
    batch = pa.RecordBatch.from_pylist(rows, pa.schema(list(kinds.items())))
    want = []
    for c in rows:
        x, y = (np.frombuffer(c[n], np.uint64) for n in ("x", "y"))
        a0, a1, b0, b1, same = chaining.passage(x, y, [p - 64 for p in c["a_at"]], [p - 128 for p in c["b_at"]], 0.8)
        if min(a1 - a0, b1 - b0) >= 50 and same >= 0.8 * max(a1 - a0, b1 - b0):
            want.append((c["doc"], a0 + 64, a1 + 64, c["e_doc"], b0 + 128, b1 + 128, same / max(a1 - a0, b1 - b0)))
    monkeypatch.setattr(chaining, "ALIGN_ROWS", 7)
    got = [tuple(r.values()) for b in chaining._aligned(50, 0.8)([batch.slice(3), batch.slice(0, 3)]) for r in b.to_pylist()]
    assert sorted(got) == sorted(want) and len(want) > 20
