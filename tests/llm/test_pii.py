import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakeloom.llm import pii
from lakeloom.llm.char_tagger import Tagger

PATTERNS = {  # as the contract has them
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def checks(number):
    total = 0
    for k, d in enumerate(reversed(number)):
        d = int(d) * (1 + k % 2)
        total += d // 10 + d % 10
    return total % 10 == 0


def literal(text):
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in m[0].split(".")), "card": lambda: 12 <= len(digits) <= 19 and checks(digits), "phone": lambda: 9 <= len(digits) <= 15}[kind]
            if good():
                out.append((m.start(), k, kind, m.end()))
    return [(kind, a, b) for a, _, kind, b in sorted(out)]


@pytest.mark.parametrize("alphabet", ["a@.-", "1.2 ", "0123456789 -", "+1 (2).-3", "a1@.+- (\n", "4é٣1@.x ", "25.0"])
def test_base_spans_equal_the_patterns(alphabet):
    rng = random.Random(alphabet)
    for _ in range(4_000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(40)))
        assert pii.base_spans(text) == literal(text), text


def test_long_runs_take_linear_time():
    for part in ("a", "1", "1.", "+1", "@", "a@", "1 ", "(", "a@a.", "at a", "\U0001f600", "[at]"):
        text = part * 300_000
        pii.base_spans(text)
        assert len(pii.windows(text)) <= len(text) // pii.STRIDE + 1
    assert pii.base_spans("9" * 10_000 + ".1.1.1") == []


def test_gradients():
    rng = np.random.default_rng(0)
    tagger = Tagger.new(5, hidden=3, seed=1)
    codes, tags = rng.integers(0, 100, (4, 6)).astype(np.int16), rng.integers(0, 5, (4, 6))
    tagger.weights = {k: v.astype(np.float64) for k, v in tagger.weights.items()}
    _, slopes = tagger.gradients(codes, tags)
    for name, values in tagger.weights.items():
        for _ in range(3):
            at = tuple(rng.integers(n) for n in values.shape)
            at = (at[0], int(codes[0, at[1] % 6]), at[2]) if name == "inputs" else at
            was, found = values[at], []
            for step in (1e-3, -1e-3):
                values[at] = was + step
                found.append(tagger.gradients(codes, tags)[0])
            values[at] = was
            assert abs(slopes[name][at] - (found[0] - found[1]) / 2e-3) < 1e-4


def test_decoding_is_the_best_path():
    from itertools import product

    rng = np.random.default_rng(2)
    tagger = Tagger.new(3, hidden=2, seed=3)
    for k in ("moves", "first", "last"):
        tagger.weights[k] = rng.normal(0, 1, tagger.weights[k].shape).astype(np.float32)
    codes = rng.integers(0, 100, (5, 5)).astype(np.int16)
    emitted, w = tagger.emissions(codes), tagger.weights
    score = lambda e, p: w["first"][p[0]] + w["last"][p[-1]] + sum(e[t, x] for t, x in enumerate(p)) + sum(w["moves"][a, b] for a, b in zip(p, p[1:], strict=False))
    for row, path in zip(emitted, tagger.decode(codes)[0], strict=True):
        assert tuple(path) == max(product(range(3), repeat=5), key=lambda p: score(row, p))


def test_windows_hold_every_span():
    rng = random.Random(4)
    for _ in range(300):
        text = "".join(rng.choice(["word ", "a@b.example.com ", "4539 1488 0343 6467 ", "1.2.3.4, ", "+1 (202) 555-0101 ", "x" * 70 + " ", "me [at] some.org "]) for _ in range(rng.randrange(30)))
        places = pii.windows(text)
        assert all(0 <= a < b <= len(text) and b - a <= pii.WIDTH for a, b in places)
        for _, a, b in pii.base_spans(text):
            assert any(x <= a and b <= y for x, y in places)


def test_parts_and_overlaps_are_reconciled():
    text = "x" * 10 + "me [at] mail [dot] example [dot] org" + "y 1.2.3.4 z"
    a, b = 10, 10 + len("me [at] mail [dot] example [dot] org")
    parts = [("email", a, a + 20, 0.9), ("email", a + 8, b, 0.8)]
    assert pii.reconciled(parts, [], text) == [("email", a, b)]
    assert pii.reconciled(parts, [("card", a + 3, a + 5)], text) == []  # base spans stay
    assert pii.reconciled([("ip", a, b, 0.99)], [], text) == []  # not an address


@pytest.fixture(scope="module")
def fitted(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    extra = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text").where("doc_id % 2 = 0")
    return pii.train(pii.training_windows(rows.unionByName(extra)))


def test_disguised_spans_of_other_documents(spark, fitted):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id % 2 = 1 and doc_id < 6000").select("text").collect()]
    rng, right, of = np.random.default_rng(5), Counter(), Counter()
    for text in texts:
        base = pii.base_spans(text)
        for kind, a, b in base:
            if any(s != (kind, a, b) and s[1] < b + 50 and s[2] > a - 50 for s in base):
                continue
            new, before = pii.disguised(kind, text[a:b], rng), text[max(0, a - 80) : a]
            of[kind] += 1
            found = pii.found_spans([before + new + text[b : b + 80]], fitted)[0]
            right[kind] += any((s[0], s[1], s[2]) == (kind, len(before), len(before) + len(new)) for s in found)
    assert all(right[k] >= 0.8 * of[k] > 8 for k in pii.KINDS), (right, of)
    clean = pii.found_spans(texts, fitted)
    assert [[s[:3] for s in mine if s[3]] for mine in clean] == [pii.base_spans(t) for t in texts]
    assert sum(not s[3] for mine in clean for s in mine) <= 2


def test_report(spark):
    mail, card = "Ask a.b@c.example.org, ", "card 4539-1488-0343-6467 "
    cases = [(1, mail + "\U0001f600" + card), (2, None), (3, ""), (None, mail), (1, "call +1 (202) 555-0101 now"), (4, "é" * 200_000 + mail), (4, "é" * 200_000 + mail), (5, "1.2.3.4 and 4539148803436468 at 300.1.1.1")]
    docs = spark.createDataFrame(cases, "doc_id long, text string").repartition(3)
    for name in ("id", "spans", "redacted", "kind", "start", "n_ip"):
        docs = docs.withColumn(name, F.lit(1))
    got = sorted(map(tuple, pii.personal_data_report(docs).select("doc_id", *(f"n_{k}" for k in pii.KINDS), "base_sha256", "spans").collect()), key=str)
    want = []
    for doc_id, text in cases:
        spans = literal(text or "")
        told = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        want.append((doc_id, *(sum(s[0] == k for s in spans) for k in pii.KINDS), hashlib.sha256(told.encode()).hexdigest(), told))
    assert got == sorted(want, key=str)
    assert pii.personal_data_report(docs.limit(0)).count() == 0
    hidden = pii.personal_data(docs.where("doc_id = 1"), redact=True)
    assert hidden.columns == ["doc_id", "spans", "redacted"]
    assert {r.redacted for r in hidden.collect()} == {"Ask <EMAIL>, \U0001f600card <CARD> ", "call <PHONE> now"}
