"""Rows that share an id, have none, or are equal; columns named like the operator's own."""

import pytest
from pyspark.sql import functions as F

from lakeloom.llm.mixing import PLAN, mix_sources, mixed_documents

WORDS = "word " * 100


@pytest.mark.parametrize("ids", ["none", "one", "equal"])
def test_each_row_counts(spark, ids):
    text = lambda k: WORDS if ids == "equal" else f"{WORDS} {k}"
    rows = [(None if ids == "none" else 7, text(k), "a") for k in range(50)]
    rows += [(None, "x " * 90, "b")] * 40 + [(k, f"y {k}", None) for k in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    for name in (*(f"_mix_{c}" for c in PLAN), *PLAN, "times", "h", "copy", "part", "before", "_part"):
        df = df.withColumn(name, F.lit("clash"))
    out = mix_sources(df, share=0.77)
    taken = {r.source: r for r in out.groupBy("source").agg(F.sum("taken").alias("n"), F.max("target").alias("target"), F.max("size").alias("most"), F.count("*").alias("rows")).collect()}
    assert {s: r.rows for s, r in taken.items()} == {"a": 50, "b": 40, None: 30}
    assert all(abs(r.n - r.target) <= r.most / 2 + 1 for r in taken.values())
    assert all(r.taken in (0, r["size"], 2 * r["size"]) for r in out.collect())
    again = mix_sources(df.repartition(3), share=0.77)
    assert sorted(map(tuple, again.collect()), key=str) == sorted(map(tuple, out.collect()), key=str)
    mixed = mixed_documents(df, share=0.77)
    assert mixed.columns == df.columns
    words = {r.source: r.n for r in mixed.groupBy("source").agg(F.sum(F.regexp_count("text", F.lit(r"\S+"))).alias("n")).collect()}
    assert words == {s: r.n for s, r in taken.items()}
