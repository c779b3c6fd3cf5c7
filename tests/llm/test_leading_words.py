"""Lines deal out two words each to find a first holder, not all words of their heads."""

from test_variant_pairs import join_rows

from lakeloom.llm.line_dedup import dedup_lines

VARIANTS = 200


def test_two_words_lead(spark):
    words = [f"v{k}" for k in range(80)]
    rows = [(k, " ".join([*words, f"own{k}"])) for k in range(VARIANTS)]
    since = spark._jsparkSession.sharedState().statusStore().executionsCount()
    out = {r.doc_id: r.removed_lines for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {d for d, lines in out.items() if lines} == set(range(1, VARIANTS))
    assert 0 < join_rows(spark, since) <= 2 * VARIANTS
