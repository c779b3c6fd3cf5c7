import hashlib
import random

import pytest
from pyspark.sql import functions as F

from lakeloom.functions.ordering import exact_sample, random_split
from lakeloom.operators import splitting
from lakeloom.vocab import RATIOS, SPLITS


def ladder(steps=250, seed=11):
    """Group sizes from a geometric ladder with jitter, a few giants and many groups of one row."""
    rng = random.Random(seed)
    sizes = {f"g{k}": int(1.03**k) + rng.randrange(5) + 1 for k in range(steps)}
    return sizes | {f"one{k}": 1 for k in range(steps // 2)}


@pytest.mark.parametrize("seed", [5, 77, 901])
def test_balance(seed):
    sizes = ladder()
    out = splitting.allocate_groups(sizes, seed=seed)
    assert set(out) == set(sizes) and set(out.values()) == set(SPLITS)
    total = sum(sizes.values())
    for s in SPLITS:
        assert abs(sum(sizes[g] for g in out if out[g] == s) / total - RATIOS[s]) < 0.005


@pytest.mark.parametrize("size", [0, -3])
def test_sizes_are_positive(size):
    with pytest.raises(ValueError, match="empty one"):
        splitting.allocate_groups(ladder() | {"empty one": size})


def test_allocation_does_not_depend_on_order_but_on_seed():
    sizes = ladder()
    assert splitting.allocate_groups(dict(reversed(sizes.items()))) == splitting.allocate_groups(sizes)
    even = dict.fromkeys(sizes, 7)
    assert splitting.allocate_groups(even, seed=1) != splitting.allocate_groups(even, seed=2)


@pytest.mark.parametrize("ratios", [{"train": 1.0}, {"train": 0.5, "val": 0.2, "test": 0.2}, {"train": 0.8, "val": 0.2, "test": 0.0}])
def test_bad_ratios(ratios):
    with pytest.raises(ValueError):
        splitting.allocate_groups(ladder(), ratios)


def plainly(sizes, ratios, seed):
    """One group at a time."""
    total = sum(sizes.values())
    lack = {s: total * ratios[s] for s in SPLITS}
    out = {}
    for g in sorted(sizes, key=lambda g: (-sizes[g], hashlib.md5(f"{seed}:{g}".encode()).hexdigest(), g)):
        out[g] = max(SPLITS, key=lambda s: lack[s])
        lack[out[g]] -= sizes[g]
    return out


@pytest.mark.parametrize("seed", range(12))
def test_size_classes_give_the_picks_of_single_groups(seed):
    rng = random.Random(seed)
    for _ in range(40):
        sizes = {f"g{k}": rng.choice([1, 1, 1, 2, 3, 7, 50, rng.randrange(1, 2000)]) for k in range(rng.randrange(3, 120))}
        ratios = rng.choice([RATIOS, {"train": 0.8, "val": 0.1, "test": 0.1}, {"train": 0.2, "val": 0.3, "test": 0.5}, {"train": 1 / 3, "val": 1 / 3, "test": 1 / 3}])
        want = plainly(sizes, ratios, seed)
        if set(want.values()) == set(SPLITS):
            assert splitting.allocate_groups(sizes, ratios, seed) == want
        else:
            with pytest.raises(ValueError, match="a split is empty"):
                splitting.allocate_groups(sizes, ratios, seed)


def test_a_size_class_is_few_runs():
    runs = splitting.size_class_runs({1: 10**15, 7: 10**12, 10**9: 5})
    assert len(runs) <= 9 and sum(r[2] for r in runs) == 10**15 + 10**12 + 5


def test_three_million_groups(spark):
    groups = spark.range(3_000_000).select(F.col("id").cast("string").alias("problem_id"), F.lit(1).alias("x"))
    big = groups.unionByName(groups.where("problem_id % 1000 = 7"))
    splits = splitting.group_splits(big)
    rows = {r.split: r for r in big.join(splits, "problem_id").groupBy("split").agg(F.count("*").alias("n"), F.count_distinct("problem_id").alias("groups")).collect()}
    assert sum(r.groups for r in rows.values()) == 3_000_000
    assert all(abs(rows[s].n - 3_003_000 * RATIOS[s]) <= 2 for s in SPLITS)


def test_group_split_equals_the_picks_in_memory(spark):
    sizes = {g: min(n, 60) for g, n in ladder(90).items()}
    df = spark.createDataFrame([(g,) for g, n in sizes.items() for _ in range(n)], "problem_id string").repartition(7)
    got = {r.problem_id: r.split for r in splitting.group_split(df, seed=3).distinct().collect()}
    assert got == splitting.allocate_groups(sizes, seed=3)


def test_masks(spark):
    rows = [("u1", "p", "train", "val"), ("u1", "p", "train", "test"), ("u1", "p", None, "val"), ("u2", "p", "val", "val"), ("u2", "p", "test", "val"), ("u3", "p", "train", "train")]
    df = spark.createDataFrame(rows, "user_id string, problem_id string, split string, random_split string")
    straddle = splitting.chain_straddle(df)
    assert tuple(straddle.first()) == (3, 2, 5, 1, 1)
    assert "Expand" not in straddle._jdf.queryExecution().toString()
    with pytest.raises(Exception, match="no split: dev"):
        splitting.chain_straddle(df.withColumn("split", F.lit("dev"))).collect()


def test_too_few_groups():
    with pytest.raises(ValueError):
        splitting.allocate_groups({"a": 1, "b": 2})


@pytest.fixture(scope="module")
def chained(spark):
    rows = [(f"s{p}_{k}", f"p{p}", f"u{k % 4}", "AB"[k % 2]) for p in range(90) for k in range(p % 17 + 9)]
    return spark.createDataFrame([*rows, ("s_null", None, "u", "A")], "submission_id string, problem_id string, user_id string, label string")


def test_group_split(spark, chained):
    out = splitting.group_split(chained).cache()
    assert out.count() == chained.count()
    assert out.where("problem_id is null and split is null").count() == 1
    splitting.assert_disjoint(out, "problem_id")
    assert [r.n for r in splitting.cross_split_counts(out, "problem_id").collect()] == [0, 0, 0]
    planted = out.withColumn("split", F.when(F.col("submission_id") == "s7_0", F.when(F.col("split") == "val", "test").otherwise("val")).otherwise(F.col("split")))
    with pytest.raises(AssertionError, match="val"):
        splitting.assert_disjoint(planted, "problem_id")
    summary = splitting.split_summary(out, "label", ("B", "A"))
    assert summary.columns == ["ord", "split", "rows", "pct", "B", "A"]
    assert sum(r.rows for r in summary.collect()) == chained.where("problem_id is not null").count()


def test_random_split_counts_and_leaks(spark, chained):
    big = spark.range(10_000).selectExpr("cast(id as string) as submission_id", "cast(id % 100 as string) as problem_id")
    out = random_split(big, "submission_id", 42, name="split")
    assert {r.split: r["count"] for r in out.groupBy("split").count().collect()} == {"train": 6000, "val": 2000, "test": 2000}
    assert all(r.n > 0 for r in splitting.cross_split_counts(out, "problem_id").collect())
    with pytest.raises(ValueError):
        random_split(big.limit(2), "submission_id", 42)
    assert exact_sample(big, "submission_id", 17, 1).count() == 17


def test_summary_of_absent_split(spark):
    df = spark.createDataFrame([("train",), (None,)], "split string")
    assert [(r.split, r.rows, r.pct) for r in splitting.split_summary(df).collect()] == [("train", 1, 100.0), ("val", 0, 0.0), ("test", 0, 0.0)]
