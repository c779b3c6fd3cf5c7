import pytest

from lakeloom import vocab
from lakeloom.operators import audit, labeling, profile
from lakeloom.sources.fixtures import submissions


def test_guards_fire(spark):
    df = spark.createDataFrame([("1", "Accepted"), ("2", "Aha"), ("3", "Oho"), ("3", None)], "id string, status string")
    with pytest.raises(vocab.UnknownVerdictError, match="2 unknown"):
        labeling.assert_known_verdicts(df)
    with pytest.raises(AssertionError):
        audit.assert_unique(df, "id")
    with pytest.raises(AssertionError):
        audit.assert_no_nulls(df, "id", "status")
    with pytest.raises(AssertionError):
        audit.assert_count(df, 3)
    with pytest.raises(AssertionError):
        audit.assert_distribution(df, "status", {"Accepted": 4})
    with pytest.raises(KeyError):
        audit.require_columns(df, "nope")
    labeling.assert_known_verdicts(df.where("id = '1'"))


def test_manifest(spark, sf_dir):
    rows = submissions(spark, sf_dir)
    labeled = labeling.labeled_manifest(rows)
    assert labeled.count() == rows.where("status in ('Accepted', 'Wrong Answer', 'Compile Error', 'Runtime Error')").count()
    audit.assert_no_nulls(labeled, "coarse_label")
    pool = {r.verdict: r.n for r in labeling.candidate_pool(rows).collect()}
    assert sum(pool.values()) == labeled.count()


def test_empty(spark, sf_dir):
    none = submissions(spark, sf_dir).limit(0)
    assert [r.n for r in labeling.candidate_pool(none).collect()] == [0] * 4
    assert labeling.discard_summary(none).count() == labeling.labeled_manifest(none).count() == 0
    assert profile.chain_profile(none).first().pairs == 0


def test_profiles(spark):
    df = spark.createDataFrame([(None, 1.0), ("a", 2.0), ("a", None)], "g string, x double")
    assert [tuple(r) for r in profile.value_counts(df, "g").collect()] == [("a", 2)]
    assert {tuple(r) for r in profile.null_counts(df).collect()} == {("g", 1), ("x", 1)}
    stats = dict(map(tuple, profile.describe(df, "x").collect()))
    assert stats["count"] == 2 and stats["p50"] == 1.5
    bins = {r.bin: r.n for r in profile.histogram(df, "x", 2, 0, 2).collect()}
    assert bins == {1: 2}
    problems = spark.createDataFrame([("a", "x"), ("a", "y")], "id string, dataset string")
    with pytest.raises(AssertionError):
        profile.with_judge(df.withColumnRenamed("g", "problem_id"), problems)
