import pytest
from pyspark.sql import functions as F

from lakeloom.operators import freeze
from lakeloom.operators.audit import Guards


@pytest.fixture
def rows(spark):
    return spark.createDataFrame([(1, "A"), (2, "B"), (3, "A"), (None, "A")], "id long, label string")


def test_guards_take_no_job_of_their_own(spark, rows, tmp_path):
    guards = Guards().no_nulls("label").values("label", {"A": 3, "B": 1}).rows(4).count("small", F.col("id") < 3)
    spark.sparkContext.setJobGroup("guarded", "")
    try:
        guards.watch(rows.repartition(3)).write.parquet(str(tmp_path / "out"))
        found = guards.verify()
    finally:
        spark.sparkContext.setJobGroup("", "")
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("guarded"))
    spark.sparkContext.setJobGroup("plain", "")
    rows.repartition(3).write.parquet(str(tmp_path / "plain"))
    spark.sparkContext.setJobGroup("", "")
    assert jobs == len(spark.sparkContext.statusTracker().getJobIdsForGroup("plain"))
    assert found == {"rows": 4, "label_null": 0, "label=A": 3, "label=B": 1, "label_other": 0, "small": 2}
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4


def test_every_broken_promise_is_named(spark, rows):
    guards = Guards().no_nulls("id").values("label", ("A",)).rows(5)
    guards.watch(rows).write.format("noop").mode("overwrite").save()
    with pytest.raises(AssertionError, match="rows is 4, promised 5; id_null is 1, promised 0; label_other is 1, promised 0"):
        guards.verify()
    with pytest.raises(ValueError):
        Guards().metrics()
    with pytest.raises(ValueError):
        Guards().no_nulls("id").no_nulls("id")


def test_digests_are_of_multisets(spark):
    df = spark.range(500).select("id", F.when(F.col("id") % 3 > 0, F.concat(F.lit("x"), "id")).alias("x"), (F.col("id") % 4).alias("g"), F.timestamp_seconds("id").alias("t"), F.array("id").alias("a"), F.encode(F.col("id").cast("string"), "UTF-8").alias("b"))
    digest = freeze.content_digest(df)
    assert digest == freeze.content_digest(df.repartition(7).select(*reversed(df.columns)))
    assert digest == freeze.content_digest(df.where("id < 99").unionByName(df.where("id >= 99")))
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        assert digest == freeze.content_digest(df)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    others = [df.unionByName(df.where("id = 7")), df.where("id <> 7"), df.withColumn("x", F.coalesce("x", F.lit("-"))), df.withColumn("b", F.lit(b"")), df.withColumn("x", F.col("x").cast("binary"))]
    assert len({digest, *map(freeze.content_digest, others)}) == 6
    by = {r.g: r for r in freeze.content_digests(df, ("g",)).collect()}
    assert sum(r.rows for r in by.values()) == 500 and len({r.digest for r in by.values()}) == 4
    assert by[2].digest == freeze.content_digest(df.where("g = 2").drop("g"))
    assert freeze.content_digests(df.limit(0), ("g",)).count() == 0 and freeze.content_digests(df.limit(0)).first().rows == 0
    assert "collect_list" not in freeze.content_digests(df)._jdf.queryExecution().toString()


def test_digest_of_pairs_that_join_alike(spark):
    a, b = (spark.createDataFrame([row], "x string, y string") for row in (("1:a", "b"), ("1", "a1:b")))
    assert freeze.content_digest(a) != freeze.content_digest(b)
