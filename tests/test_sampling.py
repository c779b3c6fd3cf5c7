import pytest

from lakeloom.operators import sampling
from lakeloom.vocab import COARSE, SPLITS


def test_quotas():
    q = sampling.resolve_quotas()
    assert sum(q.values()) == 75_000 and len(q) == 12
    assert q["train", "COMPILE_ERROR"] == 18_000
    with pytest.raises(ValueError):
        sampling.resolve_quotas({"LOGICAL": 5})
    with pytest.raises(ValueError):
        sampling.resolve_quotas(dict.fromkeys(COARSE, 0))
    with pytest.raises(ValueError):
        sampling.resolve_quotas(dict.fromkeys(COARSE, 1))


@pytest.fixture(scope="module")
def manifest(spark):
    rows = [(f"s{p}_{k}", f"p{p}", SPLITS[p % 3], COARSE[k % 4]) for p in range(30) for k in range(40 if p else 400)]
    return spark.createDataFrame(rows, "submission_id string, problem_id string, split string, coarse_label string").cache()


def draw(manifest, **change):
    quotas = {(s, c): 25 for s in SPLITS for c in COARSE} | {k: v for k, v in change.get("quotas", {}).items()}
    sample, report = sampling.draw_sample(manifest, quotas)
    return {r.submission_id for r in sample.collect()}, sample, report


def test_round_robin(manifest):
    ids, sample, report = draw(manifest)
    assert len(ids) == 300
    per = sample.groupBy("split", "coarse_label", "problem_id").count().collect()
    assert {r["count"] for r in per} == {2, 3} and len(per) == 120  # all ten groups of each cell, in turn
    assert all(r.shortfall == 0 and r.taken == 25 and r.problems == 10 for r in report.collect())
    more, wider, _ = draw(manifest, quotas={("val", "LOGICAL"): 45})
    assert ids < more and len(more) == 320
    assert wider.where("not (split = 'val' and coarse_label = 'LOGICAL')").count() == 275


def test_shortfall_and_empty_cells(manifest):
    _, sample, report = draw(manifest.where("split <> 'test'"), quotas={("val", "LOGICAL"): 500})
    rows = {(r.split, r.coarse_label): r for r in report.collect()}
    assert rows["val", "LOGICAL"].shortfall == 500 - rows["val", "LOGICAL"].available > 0
    assert tuple(rows["test", "LOGICAL"])[2:] == (25, 0, 0, 25, 0, 0)
    assert sample.count() == sum(r.taken for r in rows.values())


def test_paths_and_missing_column(spark, manifest):
    out = sampling.archive_paths(spark.createDataFrame([("p1", "s1"), (None, "s2")], "problem_id string, submission_id string"))
    assert [r.archive_path for r in out.collect()] == ["Project_CodeNet/data/p1/C++/s1.cpp", None]
    with pytest.raises(KeyError):
        draw(manifest.drop("problem_id"))


def test_quotas_from_measured_classes(spark):
    rows = [(c,) for c, n in zip(COARSE, (100, 55, 9, 31)) for _ in range(n)] + [("OTHER",), (None,)]
    df = spark.createDataFrame(rows, "coarse_label string")
    totals = sampling.measured_totals(df, 0.5)
    assert totals == dict(zip(COARSE, (50, 28, 4, 16)))
    quotas = sampling.resolve_quotas(totals)
    assert sum(quotas.values()) == 98 and quotas["train", COARSE[0]] == 30
