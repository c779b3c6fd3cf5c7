"""The registered probe takes the reference's whole sample."""

import pytest

from lakeloom.operators import probe
from lakeloom.plans import queries


@pytest.mark.parametrize("have,want", [(25, 25), (600, 500)])
def test_compile_probe_takes_the_whole_sample(spark, monkeypatch, have, want):
    files = spark.range(have).selectExpr("id", "'COMPILE_ERROR' AS coarse_label")
    monkeypatch.setattr(queries, "corpus", lambda spark, sf_dir: files)
    monkeypatch.setattr(probe, "compile_probe", lambda files, n: n)
    assert queries.compile_probe(spark, "") == want
