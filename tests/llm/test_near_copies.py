"""Similarity operators against brute force on small fixtures."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakeloom.llm import jaccard_join, lattice
from lakeloom.llm.chaining import chain, repeated_passages
from lakeloom.llm.graph import _large_star, _small_star, components
from lakeloom.llm.jaccard_join import jaccard_components
from lakeloom.llm.lattice import cells, embedding_links, nearest_e8, shortest_vectors
from lakeloom.llm.line_dedup import dedup_lines
from lakeloom.llm.scratch import Scratch

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def parts(vertices, edges):
    up = {v: v for v in vertices}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {v: find(v) for v in vertices}


def edited(rng, words, share):
    return [f"w{rng.randrange(9**9)}" if rng.random() < share else w for w in words]


@pytest.fixture(scope="module")
def corpus():
    """Copies, near copies at all distances, common passages, and odd texts."""
    rng = random.Random(5)
    fresh = lambda n: [f"w{rng.randrange(9**9)}" for _ in range(n)]
    common, texts = fresh(70), [None, "", " \t", "a", "A", "a b", "A B", "a b c", "word " * 3000]
    for _ in range(12):
        base = fresh(rng.choice([9, 40, 150]))
        texts += [" ".join(base)] * 2 + [" ".join(edited(rng, base, s)) for s in (0.01, 0.02, 0.03, 0.05, 0.1)]
        texts.append("\n".join([" ".join(fresh(60)), " ".join(common), " ".join(fresh(30))]))
    return texts


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return spark.createDataFrame(list(enumerate(corpus)), "doc_id long, text string").withColumn("n", F.lit("clash")).withColumn("component", F.lit(0)).cache()


def shingles(text, width):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(words[k : k + width]) for k in range(len(words) - width + 1)} or ({tuple(words)} if words else set())


@pytest.mark.parametrize("width,percent,whole", [(3, 90, 2_000_000), (3, 90, 200), (5, 80, 2_000_000)])
def test_jaccard(monkeypatch, docs, corpus, width, percent, whole):
    monkeypatch.setattr(jaccard_join, "WHOLE_GRAMS", whole)  # small: blocks are split into pairs of parts
    monkeypatch.setattr(jaccard_join, "PART_GRAMS", max(100, whole // 2))
    sets = [shingles(t, width) for t in corpus]
    links = [(i, j) for j in range(len(sets)) for i in range(j) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    want = parts(range(len(sets)), links)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(docs, width=width, percent=percent).collect()}
    assert got == {k: (len(s), want[k]) for k, s in enumerate(sets)}


def test_jaccard_odd_rows(spark, docs):
    rows = spark.createDataFrame([(3, "a b c d"), (3, "a b c d"), (None, "a b c d"), (2, "a b c d"), (9, None)], "doc_id long, text string")
    got = sorted(tuple(r) for r in jaccard_components(rows).fillna(-1).collect())
    assert got == [(-1, 1, 2), (2, 1, 2), (3, 1, 2), (3, 1, 2), (9, 0, 9)]
    assert jaccard_components(docs.limit(0)).count() == 0


def test_components_by_stars(spark, monkeypatch):
    from lakeloom.llm import graph

    rng = random.Random(2)
    edges = [(k, k + 1) for k in range(40)] + [(100 + rng.randrange(60), 100 + rng.randrange(60)) for _ in range(50)]
    want = {v: c for v, c in parts({v for e in edges for v in e}, edges).items()}
    df = spark.createDataFrame([*edges, *edges[:5]], "u long, v long")
    alone = {v for a, b in edges if a == b for v in (a,)} - {v for a, b in edges if a != b for v in (a, b)}
    for most in (500_000, 3):
        monkeypatch.setattr(graph, "ONE_TASK_EDGES", most)
        got = {r.u: r.component for r in components(df, Scratch(spark, "test"), f"g{most}").collect()}
        assert got == {v: c for v, c in want.items() if v not in alone}
    assert _small_star(_large_star(df.where("u <> v"))).count() > 0


def test_lines(docs, corpus):
    texts = [t or "" for t in corpus]
    sets, want = [], {}
    for i, t in enumerate(texts):
        want[i] = []
        for k, line in enumerate(t.split("\n")):
            words = set(WORD.findall(line))
            if len(words) < 5:
                continue
            if any(100 * len(words & s) >= 80 * len(words | s) for s in sets):
                want[i].append(k)
            sets.append(words)
    out = {r.doc_id: r for r in dedup_lines(docs).collect()}
    assert {i: r.removed_lines for i, r in out.items()} == want and any(want.values())
    for i, r in out.items():
        assert r.text == (None if corpus[i] is None else "\n".join(x for k, x in enumerate(texts[i].split("\n")) if k not in want[i]))
        assert r.n == "clash"


def test_lines_odd_rows(spark, docs):
    five = "a b c d e"
    rows = spark.createDataFrame([(2, five), (1, f"{five}\nshort\n{five}"), (None, five), (1, f"{five}\nshort\n{five}"), (3, None)], "doc_id long, text string")
    got = sorted(((r.doc_id or 99, r.removed_lines, r.text, r.n_lines) for r in dedup_lines(rows).collect()), key=str)
    assert got == sorted([(1, [2], f"{five}\nshort", 3), (1, [2], f"{five}\nshort", 3), (2, [0], "", 1), (3, [], None, 0), (99, [0], "", 1)], key=str)
    assert dedup_lines(docs.limit(0)).count() == 0


def test_passages(docs, corpus):
    words = [WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), t or "")) for t in corpus]
    first, want = {}, {}
    for i, w in enumerate(words):
        for k in range(len(w) - 50):
            j = first.setdefault(tuple(w[k : k + 51]), i)
            if j != i:
                want.setdefault(i, []).append(k)
    found = repeated_passages(docs).collect()
    spans = {}
    for r in found:
        assert r.source_doc_id < r.doc_id and r.identity >= 0.8 and r.end_word - r.start_word >= 50
        assert r.end_word <= len(words[r.doc_id]) and r.source_end <= len(words[r.source_doc_id])
        spans.setdefault(r.doc_id, []).append((r.start_word, r.end_word))
    for i, ks in want.items():
        assert all(any(a <= k and k + 51 <= b for a, b in spans[i]) for k in ks)
    clean = {i for i, w in enumerate(words) if not any(set(w) & set(words[j]) for j in range(len(words)) if j != i)}
    assert not clean & set(spans)
    assert repeated_passages(docs.limit(0)).count() == 0


def test_chain_follows_both_texts():
    later, earlier = np.array([0, 10, 20, 30, 12]), np.array([100, 110, 121, 131, 5])
    assert sorted(map(sorted, chain(later, earlier))) == [[0, 1, 2, 3], [4]]


def test_e8():
    short = shortest_vectors()
    assert len(np.unique(short, axis=0)) == 240 and ((short**2).sum(1) == 8).all()
    x = np.random.default_rng(0).standard_normal((500, 8)) * 3
    points = nearest_e8(x) / 2
    gap = ((x - points) ** 2).sum(1)
    for v in short / 2:  # no neighbour is nearer
        assert (gap <= ((x - points - v) ** 2).sum(1) + 1e-9).all()
    assert (gap <= 1 + 1e-9).all()
    own = cells(x / np.linalg.norm(x, axis=1)[:, None], 1, 2, 5, 4.0)
    assert own.shape == (500, 2, 6) and all(len(set(c)) == 6 for c in own[:, 0].tolist())


@pytest.mark.parametrize("block", [1024, 20])
def test_embeddings(spark, monkeypatch, block):
    monkeypatch.setattr(lattice, "BLOCK_ROWS", block)
    rng = np.random.default_rng(1)
    x = rng.standard_normal((60, 64))
    near = np.concatenate([x[:20] + s * rng.standard_normal((20, 64)) for s in (0.02, 0.1, 0.2)])
    crowd = x[:1] + 0.01 * rng.standard_normal((60, 64))
    whole = np.concatenate([x, near, crowd, x[:10], x[:5] * 7.5])
    vectors = [*whole.tolist(), None, [], [0.0] * 64, [float("nan")] + [1.0] * 63, [None] + [1.0] * 63, [float("inf")] + [1.0] * 63, [1e-200] * 64, [1e200] * 64]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(vectors)], "vec_id long, embedding array<double>").withColumn("label", F.lit(1)).withColumn("members", F.lit("clash"))
    unit = whole / np.linalg.norm(whole, axis=1)[:, None]
    close = unit @ unit.T >= 0.95
    np.fill_diagonal(close, False)
    n = len(vectors)
    links = [tuple(e) for e in np.argwhere(close)] + [(n - 2, n - 1)]
    want = parts(range(n), links)
    degree = [*close.sum(1), *[0] * (n - len(whole) - 2), 1, 1]
    got = {r.vec_id: r for r in embedding_links(df).collect()}
    assert all(got[k].n_links <= degree[k] for k in range(n))
    assert sum(r.n_links for r in got.values()) >= 0.95 * sum(degree)
    assert np.mean([got[k].component_id == want[k] for k in range(n)]) >= 0.95
    assert all(r.kept == (r.component_id == r.vec_id) for r in got.values())
    assert [got[k].n_links for k in range(len(whole), n - 2)] == [0] * (n - len(whole) - 2)
    assert embedding_links(df.limit(0)).count() == 0
