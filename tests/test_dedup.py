import hashlib
import re

import pytest
from pyspark.sql import functions as F

from lakeloom.functions.content import content_hash, encoding_of, has_high_byte, normalized
from lakeloom.operators import dedup


def expected(raw: bytes) -> bytes:
    raw = raw.removeprefix(b"\xef\xbb\xbf").replace(b"\r\n", b"\n").replace(b"\r", b"\n")
    return b"\n".join(line.rstrip(b" \t\x0b\x0c") for line in raw.split(b"\n"))


CASES = [b"", b"a", b"a\r\nb\r\n", b"a\rb", b"\xef\xbb\xbfint x;", b"\xef\xbb\xbf\xef\xbb\xbfx", b"  lead\t \n\n x \x0b\x0c", bytes(range(256)), b"a \x1c\n", b"\x85 \xa0\n", "日本".encode("shift_jis"), b"\xff\xfe \r\r\n"]


def test_normalisation(spark):
    df = spark.createDataFrame([(k, bytearray(c)) for k, c in enumerate(CASES)], "k int, c binary")
    for r in df.select("k", normalized(F.col("c")).alias("n"), content_hash(F.col("c")).alias("h"), has_high_byte(F.col("c")).alias("b")).collect():
        assert bytes(r.n) == expected(CASES[r.k])
        assert r.h == hashlib.sha256(expected(CASES[r.k])).hexdigest()
        assert r.b == bool(re.search(rb"[\x80-\xff]", CASES[r.k]))
    kinds = {r.k: r.e for r in df.select("k", encoding_of(F.col("c")).alias("e")).collect()}
    assert kinds[1] == "utf-8" and kinds[10] == "shift_jis" and kinds[7] == "neither"


@pytest.fixture(scope="module")
def hashes(spark):
    files = {"z/one": b"while (1);\r", "m/two": b"while (1);\n", "a/odd\\name": b"while (1);\t\v\n", "q": b"\xef\xbb\xbfreturn 7;", "b": b"return 7;", "k": b"", "lone": b"\n\n"}
    have = spark.createDataFrame([(k, bytearray(v)) for k, v in files.items()], "path string, content binary")
    wanted = spark.createDataFrame([(k,) for k in [*files, "gone"]], "path string")
    return dedup.hash_corpus(wanted, have).cache()


def test_report(spark, hashes):
    rows = {r.path: r for r in hashes.collect()}
    assert rows["gone"].exists is False and rows["gone"].sha256 is None and rows["gone"].bytes is None
    assert rows["a/odd/name"].bytes == rows["m/two"].bytes + 2
    groups = {}
    for r in dedup.duplicate_groups(hashes).orderBy("sha256", "place").collect():
        groups.setdefault((r["count"], r.representative), []).append((r.place, r.path))
    assert groups == {(3, "a/odd/name"): [(1, "a/odd/name"), (2, "m/two"), (3, "z/one")], (2, "b"): [(1, "b"), (2, "q")]}
    assert tuple(dedup.dedup_report(hashes).first()) == (7, 1, 4, 2, 5, 3, 42.8571)
    assert tuple(dedup.dedup_report(spark.createDataFrame([], dedup.HASHES)).first()) == (0, 0, 0, 0, 0, 0, 0.0)
    assert dedup.duplicate_groups(spark.createDataFrame([], dedup.HASHES)).count() == 0


def test_a_content_of_a_million_files(spark):
    n = 1_000_000
    hashes = spark.range(n + 3).select(F.concat(F.lit("p"), F.lpad(F.col("id").cast("string"), 8, "0")).alias("path"), F.when(F.col("id") < n, "hot").otherwise(F.col("id").cast("string")).alias("sha256"), F.lit(1).cast("long").alias("bytes"), F.lit(True).alias("exists"))
    groups = dedup.duplicate_groups(hashes)
    plan = groups._jdf.queryExecution().toString()
    assert "collect_list" not in plan and "collect_set" not in plan
    row = groups.agg(F.count("*").alias("n"), F.count_if(F.col("place") == F.substring("path", 2, 8).cast("long") + 1).alias("right"), F.max("count").alias("count"), F.max("representative").alias("first")).first()
    assert tuple(row) == (n, n, n, "p00000000")


def test_cross_split(spark):
    rows = [("x", "train"), ("x", "val"), ("x", "val"), ("y", "train"), (None, "train"), (None, "val"), ("z", "train"), ("z", "test"), ("w", None)]
    df = spark.createDataFrame(rows, "sha256 string, split string").withColumn("coarse_label", F.lit("A"))
    assert [tuple(r) for r in dedup.cross_split_counts(df, "sha256").collect()] == [("train&val", 1), ("train&test", 1), ("val&test", 0)]
    with pytest.raises(AssertionError, match="train&val"):
        dedup.assert_no_cross_split_duplicates(df)
    clean = dedup.exclude_minority_copies(df)
    dedup.assert_no_cross_split_duplicates(clean)
    kept = sorted((r.sha256 or "", r.split or "") for r in clean.collect())
    assert kept == [("", "train"), ("", "val"), ("w", ""), ("x", "val"), ("x", "val"), ("y", "train"), ("z", "train")]  # a tie goes to the earlier split
    assert tuple(dedup.label_consistency(df).first()) == (2, 0)
    assert {tuple(r) for r in dedup.collision_forensics(df).collect()} == {("x", 3, "train,val"), ("z", 2, "train,test")}
