"""Fingerprints of texts that repeat themselves."""

import pytest
from pyspark.sql import functions as F

from lakeloom.llm.syncmers import KEEP, anchors, likeness


def test_repeated_lines_take_one_place_each(spark):
    line, rest = "one two three four five six", " ".join(f"v{k}" for k in range(600))
    df = spark.createDataFrame([(f"{rest} " + f"{line}\n" * 200, rest), ("x y z " * 500 + "p q r s t u v w", "p q r s t u v w")], "a string, b string")
    every = df.select(*(anchors(F.col(c), keep=10**6).alias(c) for c in "ab")).collect()
    some = df.select(likeness(anchors(F.col("a")), anchors(F.col("b"))).alias("like"), F.split("a", r"\s+").alias("words"), *(anchors(F.col(c)).alias(c) for c in "ab"))
    for whole, got in zip(every, some.collect()):
        for c in "ab":
            hashes = [x["hash"] for x in got[c]]
            assert hashes == sorted({x["hash"] for x in whole[c]})[:KEEP]
        a, b = ({x["hash"] for x in whole[c]} for c in "ab")
        assert got.like == pytest.approx(len(a & b) / len(a | b), abs=0.1)
        seen = {}
        for x in got["a"]:
            seen.setdefault(tuple(got.words[x.position : x.position + 4]), x.position)
        first = {}
        for k in range(len(got.words) - 3):
            first.setdefault(tuple(got.words[k : k + 4]), k)
        assert all(first[w] == k for w, k in seen.items())
