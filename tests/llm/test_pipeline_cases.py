"""Pipeline stages on small documents: brute force, null and repeated ids, an empty table."""

import random

import corpus_pipeline as P

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def rows_of(texts):
    return [(i, t, "en", "ab"[len(t or "") % 2], None if t is None else len(t)) for i, t in texts]


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(len(words) - 4, 1))} if words else set()


def test_near_copies_against_brute_force(spark, sf_dir):
    rng = random.Random(4)
    fresh = lambda n: [f"w{rng.randrange(10**5)}" for _ in range(n)]
    bases = [fresh(80) for _ in range(6)]
    texts = []
    for i in range(40):
        words = list(rng.choice(bases)) if i % 2 else fresh(rng.choice([1, 4, 60]))
        if i % 4 == 1:
            words[rng.randrange(len(words))] = "changed"
        texts.append((i, " ".join(words)))
    parent = {i: i for i, _ in texts}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    sets = {i: shingles(t) for i, t in texts}
    for i in sets:
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((top(i), top(j)))
                parent[b] = a
    extra = [(0, texts[0][1]), (None, texts[1][1]), (None, "alone " * 9), (None, "alone " * 9), (50, ""), (50, ""), (51, None), (None, None)]
    docs = spark.createDataFrame(rows_of(texts + extra), COLUMNS)
    got = sorted(((r.doc_id is None, r.doc_id or 0), r.text or "") for r in P.keep_one_of_near_copies(spark, docs, sf_dir).collect())
    want = [(i, t) for i, t in texts if top(i) == i] + [(None, "alone " * 9), (50, ""), (50, ""), (51, ""), (None, "")]
    assert got == sorted(((i is None, i or 0), t) for i, t in want)


def test_empty_table(spark, sf_dir):
    docs = spark.createDataFrame([], COLUMNS)
    for name, stage in P.STAGES:
        out = stage(spark, docs, sf_dir)
        assert out.collect() == []
        if name != "best_fit_packing":
            assert out.columns == docs.columns
