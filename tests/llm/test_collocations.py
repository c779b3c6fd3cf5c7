import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lakeloom.llm import collocations as c

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def brute(rows, longest=5, least=100, top=2000):
    counts, words = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        mine = counts.setdefault(lang, Counter())
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            words[lang] += len(w)
            mine.update(tuple(w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    out = []
    for lang, mine in counts.items():
        frequent = {p: f for p, f in mine.items() if f >= least}
        found = []
        for p, a in frequent.items():
            if len(p) == 1 or any(f >= a and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))) for q, f in frequent.items()):
                continue
            score, cut = min((1000 * a * words[lang] // (mine[p[:k]] * mine[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), mine[p[:cut]], mine[p[cut:]]))
        out += [(lang, k + 1, p.decode(), -a, left, right, words[lang], -s) for k, (s, a, p, left, right) in enumerate(sorted(found)[:top])]
    return sorted(out)


def drawn(seed, rows=120):
    rng = random.Random(seed)
    vocabulary = ["a", "B", "c", "\x00", "é", "É", "\x1c", " x", "ß", "A", "\U0001f600"]
    texts = [(rng.choice(["en", None, "und", "x" * 50, ""]), "".join(rng.choice(vocabulary) + rng.choice([" "] * 12 + ["\t", "  ", ".", "\r\n", "\x0b", ", "]) for _ in range(rng.randrange(60)))) for _ in range(rows)]
    return [*texts, ("en", None), (None, ""), ("en", "..!?\n"), ("en", "one two three " * 300), ("de", "ein wort")] + [("fr", "je ne sais pas; je ne sais quoi")] * 150


def found(spark, rows, **how):
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    for name in ("phrase", "f", "n", "a", "w", "cut", "rank", "piece"):
        docs = docs.withColumn(name, F.lit(1))
    got = c.collocations(docs, **how)
    assert got.columns == COLUMNS
    return sorted(map(tuple, got.collect()))


@pytest.mark.parametrize("seed", [1])
def test_equals_brute_force(spark, seed):
    rows = drawn(seed)
    want = brute(rows, least=9)
    assert len(want) > 50
    assert found(spark, rows, least=9) == want
    assert found(spark, rows, least=9, most_bytes=0) == want  # levels by joins
    assert found(spark, rows, least=9, most_bytes=200) == want  # by broadcast first, then by joins


@pytest.mark.parametrize(("chunk", "held"), [(40, 5)])
def test_texts_cut_into_chunks(spark, monkeypatch, chunk, held):
    import lakeloom.llm.collocations as module

    def cut(function):  # sets the bounds in the workers too
        def run(batches):
            import lakeloom.llm.collocations as there

            before = there.CHUNK, there.HELD
            there.CHUNK, there.HELD = chunk, held
            try:
                yield from function(batches)
            finally:
                there.CHUNK, there.HELD = before

        return run

    rows = drawn(4)
    for name in ("_encoder", "_counter"):
        monkeypatch.setattr(module, name, lambda *a, made=getattr(module, name): cut(made(*a)))
    monkeypatch.setattr(module, "_count_words", cut(module._count_words))
    assert found(spark, rows, least=9) == brute(rows, least=9)


def test_top_and_production_bounds(spark):
    rows = drawn(3, 700)
    assert found(spark, rows, top=7) == brute(rows, top=7)
    assert found(spark, rows) == brute(rows)


def test_empty_tables(spark):
    assert found(spark, []) == []
    assert found(spark, [("en", None), (None, "  \t .")]) == []


def test_products_beyond_64_bits(spark):
    row = spark.createDataFrame([(10**13, 10**14, 10**12, 10**12)], "a long, n long, l long, r long")
    wide = row.selectExpr("(cast(a as decimal(18,0)) * cast(n as decimal(18,0)) * cast(1000 as decimal(4,0))) div (cast(l as decimal(18,0)) * cast(r as decimal(18,0))) as s")
    assert wide.first().s == 10**30 // 10**24


def test_chunks_hold_each_run_once(monkeypatch):
    rng = random.Random(5)
    texts = [b"".join(rng.choice([b"a", b"bb", b"ccc"]) + rng.choice([b" ", b" ", b".", b"\t"]) for _ in range(rng.randrange(200))) for _ in range(30)]
    whole = [b" . ".join(re.split(rb"[.]", t)).split() for t in texts]
    for carry in range(5):
        for size in (1, 7, 50, 10_000):
            monkeypatch.setattr(c, "CHUNK", size)
            chunks = [[w.encode() for w in words.to_pylist()] for _, words in c._chunks(texts, carry)]
            runs = Counter(tuple(x[i : i + carry + 1]) for x in chunks for i in range(len(x) - carry))
            want = Counter(tuple(x[i : i + carry + 1]) for x in whole for i in range(len(x) - carry))
            keep = lambda counts: {r: n for r, n in counts.items() if c.BREAK not in r}
            assert keep(runs) == keep(want)
