"""Chains over batches of sorted matches equal those of each pair alone."""

import random

import numpy as np
import pyarrow as pa
import pytest

from lakeloom.llm import chaining as c


@pytest.mark.parametrize("size", [1, 2, 7, 100, 10**6])
def test_chains_do_not_depend_on_batches(size):
    rng = random.Random(9)
    rows = []
    for doc in range(60):
        for e_doc in range(rng.randrange(4)):
            shift = rng.randrange(50)
            at = sorted(rng.sample(range(400), rng.randrange(1, 30)))
            bent = rng.random() < 0.4
            rows += {(doc, e_doc, p, p + shift + (rng.randrange(9) if bent else 0)) for p in at}
    rows.sort()
    columns = [pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int32(), pa.int32()))]
    whole = pa.record_batch(columns, list(c.PAIR))
    got = [r for b in c._chains(whole.slice(k, size) for k in range(0, len(rows), size)) for r in b.to_pylist()]
    want = []
    for pair in sorted({r[:2] for r in rows}):
        later, earlier = (np.array([r[k] for r in rows if r[:2] == pair]) for k in (2, 3))
        for path in c.chain(later, earlier):
            a, b = later[path].tolist(), earlier[path].tolist()
            want.append({"doc": pair[0], "e_doc": pair[1], "a0": a[0], "a1": a[-1] + c.K, "b0": b[0], "b1": b[-1] + c.K, "a_at": a, "b_at": b})
    assert sorted(got, key=str) == sorted(want, key=str)
    assert list(c._chains(iter([]))) == []
