"""Passages whose parts stand in different earlier documents."""

import random

from lakeloom.llm.chaining import passage, repeated_passages

import numpy as np


def test_passages_pieced_from_earlier_documents(spark):
    rng = random.Random(11)
    fresh = lambda n: [f"w{rng.randrange(9**9)}" for _ in range(n)]
    rows, want = [], {}
    for k in range(60):
        a, b = ((30, 30), (49, 49), (40, 15))[k % 3]
        left, right = fresh(a), fresh(b)
        first = 10 * k
        for d, part in enumerate((left, right, left + right, left + right)):
            rows.append((first + d, " ".join(fresh(40) + part + fresh(40))))
        want[first + 3] = (40, 40 + a + b)
    spans = {}
    for r in repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        assert r.identity >= 0.8 and r.source_doc_id < r.doc_id
        spans.setdefault(r.doc_id, []).append((r.start_word, r.end_word, r.source_doc_id))
    lost = [d for d, (a, b) in want.items() if not any(s <= a and b <= e and c == d - 1 for s, e, c in spans.get(d, []))]
    assert not lost and set(spans) == set(want)


def test_poor_ends_are_left_off():
    x = np.arange(400, dtype=np.uint64)
    y = x.copy()
    y[60:][np.arange(340) % 5 < 2] += np.uint64(1000)
    a0, a1, b0, b1, same = passage(x, y, list(range(0, 49, 8)) + [50], list(range(0, 49, 8)) + [50], 0.8)
    assert a1 - a0 >= 58 and same >= 0.8 * (a1 - a0)
