"""Lines of few words against brute force."""

import random

from lakeloom.llm.line_dedup import dedup_lines


def test_short_lines(spark):
    rng = random.Random(8)
    texts = ["All rights reserved.\n\na b c d", "word " * 30 + "\n一二三\na b c d e", "a b c d e\nreserved. rights All\n\nword", "一二三\n \na b c\na b c\na b d"]
    texts += ["\n".join(" ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(9))) for _ in range(12)) for _ in range(20)]
    sets, want = [], {}
    for i, t in enumerate(texts):
        want[i] = []
        for k, line in enumerate(t.split("\n")):
            words = set(line.split())
            if words and any(100 * len(words & s) >= 80 * len(words | s) for s in sets):
                want[i].append(k)
            sets.append(words)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.removed_lines for r in dedup_lines(df).collect()} == want
    assert want[1] == [2] and want[2] == [0, 1, 3] and want[3] == [0, 3]
