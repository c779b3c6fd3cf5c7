"""A group of variants of one line costs pairs in proportion to its size."""

from lakeloom.llm.line_dedup import dedup_lines

VARIANTS = 200


def join_rows(spark, since):
    """The most rows that a join by word has made in executions from ``since`` on."""
    store = spark._jsparkSession.sharedState().statusStore()
    executions, most = store.executionsList(), 0
    for k in range(executions.size()):
        of = executions.apply(k).executionId()
        if of < since:
            continue
        nodes, values = store.planGraph(of).allNodes(), store.executionMetrics(of)
        for node in map(nodes.apply, range(nodes.size())):
            if "Join" not in node.name() or "[t#" not in node.desc():
                continue
            for metric in map(node.metrics().apply, range(node.metrics().size())):
                value = values.get(metric.accumulatorId())
                if metric.name() == "number of output rows" and value.isDefined():
                    most = max(most, int(value.get().replace(",", "")))
    return most


def test_variants_meet_their_first_holder_first(spark):
    words = [f"v{k}" for k in range(40)]
    rows = [(k, " ".join([*words, f"own{k}"])) for k in range(VARIANTS)] + [(1_000 + k, f"other{k} line{k} of{k} its{k} own{k + 5000}") for k in range(50)]
    store = spark._jsparkSession.sharedState().statusStore()
    since = store.executionsCount()
    out = {r.doc_id: r.removed_lines for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {d for d, lines in out.items() if lines} == set(range(1, VARIANTS))
    assert 0 < join_rows(spark, since) < 12 * VARIANTS
