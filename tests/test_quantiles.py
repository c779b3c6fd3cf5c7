import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakeloom.functions.ordering import running
from lakeloom.operators import profile
from lakeloom.operators.quantiles import quantiles

POINTS = (0.0, 0.01, 0.25, 0.5, 0.95, 1.0)


def test_a_million_different_doubles(spark):
    df = spark.range(1_000_000).select((F.rand(3) * 1e6 + F.col("id") / 1e9).alias("x"))
    values = np.sort(df.toPandas()["x"].to_numpy())
    assert len(np.unique(values)) == 1_000_000
    got = quantiles(df, "x", POINTS).first().quantiles
    assert np.allclose(got, np.quantile(values, POINTS), rtol=1e-12)
    assert got[0] == values[0] and got[-1] == values[-1]


def test_groups_with_ties_and_nulls(spark):
    rng = random.Random(1)
    rows = [(g, rng.choice([None, 1.5, -2.0, float(rng.randrange(9))])) for g in ("a", "b", None, "ALL") for _ in range(rng.randrange(1, 400))]
    rows += [("one", 7.0), ("none", None), ("hot", 3.0), *[("hot", 4.0)] * 5000]
    df = spark.createDataFrame(rows, "g string, x double").repartition(5)
    want = {r.g: list(r.p) for r in df.where("x is not null").groupBy("g").agg(F.percentile("x", list(POINTS)).alias("p")).collect()}
    assert {r.g: list(r.quantiles) for r in quantiles(df, "x", POINTS, ("g",)).collect()} == want
    assert list(quantiles(df, "x", POINTS).first().quantiles) == list(df.agg(F.percentile("x", list(POINTS))).first()[0])


def test_no_rows_and_bad_points(spark):
    empty = spark.createDataFrame([], "g string, x double")
    assert quantiles(empty, "x", (0.5,), ("g",)).count() == 0
    assert list(quantiles(empty, "x", (0.5,)).first().quantiles) == [None]
    with pytest.raises(ValueError, match="from 0 to 1"):
        quantiles(empty, "x", (1.5,))


def test_describe_by_group(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("a", 4), (None, 5)], "g string, n int")
    got = {(r.g, r.stat): r.value for r in profile.describe(df, "n", (0.25,), by=("g",)).collect()}
    assert got["a", "count"] == 3 and got["a", "p50"] == 2 and got["a", "p25"] == 1.5 and got["a", "max"] == 4
    assert got[None, "p50"] == 5 and got[None, "std"] is None
    whole = {r.stat: r.value for r in profile.describe(df, "n").collect()}
    assert whole["count"] == 4 and whole["p50"] == 3 and whole["p75"] == 4.25


def test_running_totals(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["x", "y", None]), rng.choice([None, *range(6)]), rng.randrange(4)) for _ in range(500)]
    df = spark.createDataFrame(rows, "_key string, _part int, w int").repartition(6)
    out = running(df, ["_key"], ["_part"], "upto", "whole", "w").collect()
    assert sorted(map(str, rows)) == sorted(str(tuple(r)[:3]) for r in out)
    for g in ("x", "y", None):
        mine = sorted((r for r in out if r[0] == g), key=lambda r: (r[1] is not None, r[1] or 0, r.upto))
        assert all(r.whole == sum(x.w for x in mine) for r in mine)
        assert [r.upto for r in mine] == list(np.cumsum([r.w for r in mine])) or all(r.upto <= r.whole for r in mine)
        upper = {}
        for r in mine:
            upper[r[1]] = max(upper.get(r[1], 0), r.upto)
        sums = np.cumsum([sum(r.w for r in mine if r[1] == v) for v in upper])
        assert list(upper.values()) == list(sums)
    places = running(df, [], ["_part"]).select("place").collect()
    assert sorted(r.place for r in places) == list(range(1, 501))
