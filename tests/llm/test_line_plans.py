"""Words that lead are dealt out once: their first holders and the join with them read one shuffle."""

from lakeloom.llm.line_dedup import dedup_lines


def test_leading_words_are_dealt_once(spark):
    rows = [(k, f"a{k} b{k // 2} c{k // 3} d e f g h\nsome other line {k // 4}") for k in range(60)]
    store = spark._jsparkSession.sharedState().statusStore()
    since = store.executionsCount()
    dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    executions = store.executionsList()
    of = [executions.apply(k) for k in range(executions.size())]
    told = [e.physicalPlanDescription() for e in sorted(of, key=lambda e: e.executionId()) if e.executionId() >= since]
    led = next(t for t in told if "Join" in t and "[t#" in t)
    assert "ReusedExchange" in led.split("Initial Plan")[0]
