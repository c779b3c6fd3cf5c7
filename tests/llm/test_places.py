"""Anchors and their likeness against a plain twin."""

import random
from bisect import bisect_left

import xxhash
from pyspark.sql import functions as F

from lakeloom.llm.syncmers import anchors, fingerprint_report, likeness


def signed(x):
    return x - 2**64 if x >= 2**63 else x


def word_hash(word, seed=42):
    return signed(xxhash.xxh64_intdigest(word.encode(), seed))


def long_hash(value, seed):
    return signed(xxhash.xxh64_intdigest((value % 2**64).to_bytes(8, "little"), seed % 2**64))


def run_hash(hashes):
    seed = 42
    for h in hashes:
        seed = long_hash(h, seed)
    return seed


def twin_anchors(text, k=4, keep=128):
    """Runs of k words of which the least hash stands at an edge, by hash, the first place of each."""
    h = [word_hash(w) for w in text.split()]
    first = {}
    for j in range(len(h) - k + 1):
        if min(h[j], h[j + k - 1]) <= min(h[j + 1 : j + k - 1]):
            first.setdefault(run_hash(h[j : j + k]), j)
    return sorted(first.items())[:keep]


def twin_likeness(a, b, keep=128):
    both = sorted({h for h, _ in a} | {h for h, _ in b})[:keep]
    pa, pb = dict(a), dict(b)
    ends = []
    for _, place in sorted((pa[h], pb[h]) for h in both if h in pa and h in pb):
        at = bisect_left(ends, place)
        ends[at : at + 1] = [place]
    return len(ends) / len(both) if both else 1.0


def texts(rng):
    vocabulary = [f"w{k}" for k in range(rng.choice([5, 40, 5000]))]
    a = [rng.choice(vocabulary) for _ in range(rng.randrange(4, 500))]
    b = list(a)
    for _ in range(rng.randrange(4)):
        i, j = sorted(rng.randrange(len(b) + 1) for _ in range(2))
        part = b[i:j]
        b = rng.choice([b[:i] + b[j:] + part, b[:j] + part + b[j:], b[:i] + [rng.choice(vocabulary) for _ in part] + b[j:]])
    return " ".join(a), " ".join(b)


def test_anchors_and_likeness_equal_the_twin(spark):
    rng = random.Random(6)
    rows = [texts(rng) for _ in range(150)]
    df = spark.createDataFrame(rows, "a string, b string").select("a", "b", anchors(F.col("a")).alias("x"), anchors(F.col("b")).alias("y"))
    for r in df.select("*", likeness(F.col("x"), F.col("y")).alias("like"), likeness(F.col("x"), F.col("x")).alias("same")).collect():
        x, y = twin_anchors(r.a), twin_anchors(r.b)
        assert [tuple(p) for p in r.x] == x and [tuple(p) for p in r.y] == y
        assert r.like == twin_likeness(x, y) and r.same == 1


def test_moved_thirds_do_not_add_up(spark):
    words = [f"v{k}" for k in range(900)]
    moved = words[600:] + words[300:600] + words[:300]
    inserted = words[:450] + [f"n{k}" for k in range(60)] + words[450:]
    df = spark.createDataFrame([(" ".join(words), " ".join(moved), " ".join(inserted))], "a string, m string, i string")
    got = df.select(*(likeness(anchors(F.col("a")), anchors(F.col(c))).alias(c) for c in "mi")).first()
    assert got.m < 0.5 < 0.8 < got.i


def test_rows_of_one_id_and_none(spark):
    rows = [(7, "one two three"), (7, "four five six"), (None, "x y z"), (None, None), (3, "p q r"), (9, "a b c")]
    out = fingerprint_report(spark.createDataFrame(rows, "doc_id long, text string"))
    order = ["a b c", "four five six", "one two three", "p q r", "", "x y z"]  # ids descending, rows of one id by text, null ids last
    edited = set()
    for k, text in enumerate(order):
        cut = len(text) // 3
        edited.add(text[: len(text) - cut] + order[(k + 1) % len(order)][:cut])
    import hashlib

    assert {r.edited_sha256 for r in out.collect()} == {hashlib.sha256(t.encode()).hexdigest() for t in edited} and out.count() == 6
