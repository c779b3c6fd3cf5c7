"""Rows that share an id, or have none, in passages and vectors."""

import random

import numpy as np

from lakeloom.llm.chaining import repeated_passages
from lakeloom.llm.lattice import embedding_links


def words(seed, n):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(9**9)}" for _ in range(n))


def test_texts_of_one_id_are_compared_each(spark):
    a, b = words(1, 80), words(2, 80)
    rows = [(1, a), (2, b), (5, a), (5, f"{b} more"), (7, b), (7, b), (None, a), (9, None), (9, ""), (8, a)]
    got = {tuple(r)[:6] for r in repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == {(5, 0, 80, 1, 0, 80), (5, 0, 80, 2, 0, 80), (7, 0, 80, 2, 0, 80), (8, 0, 80, 1, 0, 80)}


def test_vectors_that_share_an_id_or_have_none(spark):
    rng = np.random.default_rng(3)
    x, y, z = (rng.normal(size=16).tolist() for _ in range(3))
    near = [v + 0.001 for v in x]
    rows = [(1, x), (1, x), (2, near), (3, y), (None, y), (None, z), (4, z), (5, [0.0] * 16), (6, None), (3, y)]
    out = embedding_links(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), threshold=0.95).collect()
    got = sorted(((r.vec_id, r.n_links, r.component_id) for r in out), key=str)
    assert got == sorted([(1, 2, 1)] * 2 + [(2, 2, 1)] + [(3, 1, 3)] * 2 + [(None, 0, None)] * 2 + [(k, 0, k) for k in (4, 5, 6)], key=str)
