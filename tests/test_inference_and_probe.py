import math

import pytest
from pyspark.sql import functions as F

from lakeloom.operators import freeze, inference, probe
from lakeloom.operators.audit import reconciliation
from lakeloom.streaming.labels import label_stream, verdicts_by_window
from lakeloom.vocab import SERVING_CLASSES


def test_predict(spark):
    df = spark.createDataFrame([(1, "int main() {}"), (2, ""), (3, None), (4, "x" * 50_001), (5, "y")], "id long, code string")
    predictor = inference.build_predictor({"type": "dummy", "seed": 42})
    out = {r.id: r.prediction for r in inference.predict(df, predictor, "id").collect()}
    assert set(out) == {1, 5}
    for p in out.values():
        assert math.isclose(sum(x.probability for x in p.probabilities), 1.0)
        assert p.predicted_class in SERVING_CLASSES and p.is_placeholder
        assert p.confidence == max(x.probability for x in p.probabilities)
    again = {r.id: r.prediction for r in inference.predict(df.repartition(7), predictor, "id").collect()}
    assert again == out
    with pytest.raises(ValueError):
        inference.assert_valid_requests(df)
    with pytest.raises(ValueError):
        inference.build_predictor({"type": "codebert"})
    assert inference.health(predictor)["num_classes"] == 6
    assert isinstance(predictor, inference.Predictor)


STAND_IN = """#!/bin/sh
if grep -q sleep "$1"; then sleep 5; fi
if grep -q 'main({' "$1"; then echo 'error: expected )' >&2; exit 1; fi
if grep -q 'int f();' "$1"; then echo 'undefined reference to f' >&2; exit 1; fi
"""


def test_compile_probe(spark, tmp_path):
    compiler = tmp_path / "cc"  # stands in for a compiler, which the machine may lack
    compiler.write_text(STAND_IN)
    compiler.chmod(0o755)
    sources = {"clean": b"int main(){}", "link": b"int f(); int main(){return f();}", "bad": b"int main({", "slow": b"sleep", "gone": None}
    df = spark.createDataFrame([(k, "p", "COMPILE_ERROR", None if v is None else bytearray(v)) for k, v in sources.items()], "submission_id string, problem_id string, coarse_label string, content binary")
    report = probe.compile_probe(df, 5, timeout=1.0, command=(str(compiler),))
    got = {r.submission_id: (r.outcome, r.classification) for r in report.collect()}
    assert got == {"clean": ("COMPILED_CLEAN", None), "link": ("FAILED", "LINKER"), "bad": ("FAILED", "OTHER"), "slow": ("TIMEOUT", None), "gone": ("SOURCE_MISSING", None)}
    assert tuple(probe.probe_summary(report, 5).first()) == (2, 1, 50.0, 20.0, 6000)
    with pytest.raises(ValueError):
        probe.compile_probe(df, 6)


def test_digest_ignores_layout(spark):
    df = spark.range(1000).withColumn("x", F.when(F.col("id") % 3 > 0, F.col("id").cast("string")))
    assert freeze.content_digest(df) == freeze.content_digest(df.repartition(5).select("x", "id"))
    assert freeze.content_digest(df) != freeze.content_digest(df.withColumn("x", F.coalesce("x", F.lit(""))))
    config = freeze.freeze_config(df, row_counts={"final": 1000}, findings={})
    assert config["artifact_digest"]["value"] == freeze.content_digest(df)


def test_reconciliation(spark):
    a, b = spark.range(0, 5), spark.range(3, 8)
    assert sorted((r.id, r.side) for r in reconciliation(a, b, "id").collect()) == [(0, "missing"), (1, "missing"), (2, "missing"), (5, "extra"), (6, "extra"), (7, "extra")]


def test_streams(spark, sf_dir, tmp_path):
    from lakeloom.sources.fixtures import submissions

    rows = submissions(spark, sf_dir)
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = label_stream(stream).writeStream.format("memory").queryName("labels").start()
    q.processAllAvailable()
    q.stop()
    from lakeloom.operators.labeling import labeled_manifest

    assert spark.table("labels").count() == labeled_manifest(rows).count()
    timed = stream.withColumn("at", F.timestamp_seconds("date"))
    q = verdicts_by_window(timed, "at").writeStream.outputMode("complete").format("memory").queryName("windows").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("windows").agg(F.sum("n")).first()[0] == rows.count()
