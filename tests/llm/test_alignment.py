"""Operator 4: alignment of short stretches and chains on one diagonal against plain forms."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from lakeloom.llm.chaining import GAP, K, align, chain

words = st.lists(st.integers(0, 4), max_size=70)


@settings(max_examples=200, deadline=None)
@given(words, words)
def test_align_is_longest_common_subsequence(x, y):
    row = [0] * (len(y) + 1)
    for w in x:
        before = row[:]
        for j, v in enumerate(y):
            row[j + 1] = before[j] + 1 if v == w else max(before[j + 1], row[j])
    assert align(x, y) == row[-1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 2 * GAP), min_size=1, max_size=40), st.integers(0, 500))
def test_one_diagonal_gives_the_tree_s_chains(steps, off):
    later = np.cumsum(steps).astype(np.int32)
    earlier = (later + off).astype(np.int32)
    # a match far from all others makes two diagonals, so the tree is used; it is a chain of its own
    far = int(later[-1]) + 10 * (GAP + K)
    by_tree = chain(np.append(later, far).astype(np.int32), np.append(earlier, far + off + 5 * GAP).astype(np.int32))
    assert sorted(chain(later, earlier)) == sorted(c for c in by_tree if c != [len(later)])
