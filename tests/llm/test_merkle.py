import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from lakeloom.llm.merkle import fold, merkle_manifest, tamper_report

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    return digest(*("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (*row[:4], text)))


def tree(nodes):
    """(last node, the runs' other nodes on the way of each first node), level by level."""
    ways, under = [[] for _ in nodes], [[k] for k in range(len(nodes))]
    while len(nodes) > 1:
        runs = [range(a, min(a + 3, len(nodes))) for a in range(0, len(nodes), 3)]
        for run in runs:
            for k in run:
                for first in under[k]:
                    ways[first].append(("".join(nodes[j] for j in run if j < k), "".join(nodes[j] for j in run if j > k)))
        under = [[first for k in run for first in under[k]] for run in runs]
        nodes = [digest(*(nodes[k] for k in run)) for run in runs]
    return nodes[0], ways


def brute(rows):
    trees = []
    for source in sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode())):
        own = sorted((r for r in rows if r[1] == source), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[4])))
        trees.append((own, *tree([leaf(r, r[4]) for r in own])))
    root, above = tree([t[1] for t in trees])
    out = []
    for (own, subroot, ways), rest in zip(trees, above, strict=True):
        for row, way in zip(own, ways, strict=True):
            text = row[4]
            if text is not None and row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0:
                text = text.replace("\n", "")
            now = leaf(row, text)
            for left, right in way + rest:
                now = digest(left, now, right)
            out.append((row[0], leaf(row, row[4]), subroot, root, digest(*(a + b for a, b in way + rest)), now, now == root))
    return sorted(out, key=str)


CASES = {
    "sizes around runs and blocks": [(100 * s + k, f"s{s}", "en", k, f"text {k}\nof {s}\n") for s, n in enumerate((1, 2, 3, 4, 9, 10, 27, 28, 30, 85)) for k in range(n)],
    "nulls everywhere": [(None, None, None, None, None), (1, None, "en", None, "a\nb"), (None, "x", "en", 3, "a\nb"), (2, "x", None, 3, None), (3, "", "", 0, ""), (4, "", "", 0, "\n")],
    "repeated rows, shared ids": [(7, "s", "en", 3, "a\nb")] * 40 + [(7, "s", "en", 3, f"c\n{k}") for k in range(12)] + [(None, "s", "en", 3, "a\nb")] * 5,
    "sources by bytes": [(k, s, "en", 1, "é\n") for k, s in enumerate(("é", "z", "Z", "\U0001f600", "￮", "-", "=", None, "", "a" * 300))],
    "a long text": [(1, "s", "en", 2, "word\n" * 400_000), (2, "s", "en", 2, "word")],
    "one row": [(5, "s", "en", 1, "alone")],
    "none": [],
}


@pytest.mark.parametrize("case", CASES)
def test_equals_brute_force(spark, case):
    docs = spark.createDataFrame(CASES[case], SCHEMA).repartition(3)
    for name in ("g", "h", "i", "n", "b", "part", "salt", "row", "leaf", "root", "up", "items"):
        docs = docs.withColumn(name, F.lit(1))
    got = sorted(map(tuple, tamper_report(docs, steps=2).collect()), key=str)
    assert got == (brute(CASES[case]) if CASES[case] else [])


def test_blocks_of_any_size_agree(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("source", F.lit("one"))
    small, large = (sorted(map(tuple, tamper_report(docs, steps=k).collect()), key=str) for k in (1, 6))
    assert small == large == brute([tuple(r) for r in docs.select("doc_id", "source", "lang", "n_chars", "text").collect()])


def test_proofs_lead_to_the_root(spark):
    docs = spark.range(100).selectExpr("id", "cast(id % 7 as string) as kind")
    rows = merkle_manifest(docs, F.sha2(F.col("id").cast("string"), 256), "id", "kind", steps=2)
    assert rows.columns == ["id", "kind", "leaf", "siblings", "subroot", "root"]
    assert rows.where(fold(F.col("leaf"), F.col("siblings")) == F.col("root")).count() == 100
    assert rows.where(fold(F.sha2("leaf", 256), F.col("siblings")) == F.col("root")).count() == 0
