"""Fingerprints, mixing, toxicity, chat formatting and the pipeline on small fixtures."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from lakeloom.llm import syncmers
from lakeloom.llm.chat import digests, format_conversations
from lakeloom.llm.mixing import mix_sources, mixed_documents, shares
from lakeloom.llm.syncmers import fingerprint_report
from lakeloom.llm.toxicity import EXACT, FUZZY, STEM, build_automaton, letter_words, scored_documents, toxicity_scores
from lakeloom.llm.textvec import string_buffers

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize("rows", [3, 2_000])
def test_fingerprints(spark, monkeypatch, rows):
    monkeypatch.setattr(syncmers, "RANGE_ROWS", rows)
    rng = random.Random(3)
    texts = {k: " ".join(f"w{rng.randrange(10**6)}é" for _ in range(rng.choice([1, 3, 30, 300]))) for k in range(0, 40, 2)}
    texts |= {41: None, 43: "", 45: texts[0], 47: "one two three four", 49: "long " * 20_000}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumn("place", F.lit("clash"))
    got = {r.doc_id: r for r in fingerprint_report(df).collect()}
    order = sorted(texts, reverse=True)
    assert set(got) == set(texts)
    for d, n in zip(order, order[1:] + order[:1]):
        own, after = texts[d] or "", texts[n] or ""
        cut = len(own) // 3
        changed = own[: len(own) - cut] + after[:cut]
        assert got[d].n_chars == len(own) and got[d].edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert 0 <= got[d].near_next <= 1 and 0 <= got[d].near_edited <= 1
        if changed == own:
            assert got[d].near_edited == 1 and got[d].fingerprint == got[d].edited_fingerprint
        if len(own.split()) == 300:
            assert 0.35 < got[d].near_edited < 0.8  # half of the anchors, or two thirds beside a short next text
    assert got[45].fingerprint == got[0].fingerprint and got[41].fingerprint == got[43].fingerprint == ""
    assert got[43].near_next == 1.0  # two empty texts
    assert fingerprint_report(df.limit(0)).count() == 0


def test_anchors_are_closed_and_free_of_context(spark):
    words = [f"v{k}" for k in range(200)]
    df = spark.createDataFrame([(" ".join(words),), (" ".join(["x", "y", *words[50:150], "z"]),)], "text string")
    whole, part = (r.a for r in df.select(syncmers.anchors(F.col("text"), keep=10_000).alias("a")).collect())
    inside = {(a.hash, a.position - 48) for a in whole if 50 <= a.position <= 146}
    assert inside <= {(a.hash, a.position) for a in part}
    assert all(b.position - a.position <= syncmers.K for a, b in zip(*(lambda s: (s, s[1:]))(sorted(whole, key=lambda a: a.position))))


def test_rows_that_share_an_id(spark):
    df = spark.createDataFrame([(1, "b b b b b b"), (1, "b b b b b b"), (None, "c c c"), (2, "d d d")], "doc_id long, text string")
    assert fingerprint_report(df).count() == 4


def test_shares():
    assert shares([100, 100, 100], [5, 2, 1], 450, 2) == [200, pytest.approx(500 / 3), pytest.approx(250 / 3)]
    assert shares([10, 1000, 0], [5, 2, 1], 1500, 2) == [20, 1480, 0]
    assert shares([], [], 0, 2) == []


def test_mixing(spark):
    rng = random.Random(1)
    sources = ["b", "a", "é", None, "Z", ""]
    rows = [(k, " ".join(["w"] * rng.choice([0, 1, 5, 50])), sources[0] if k % 3 == 0 else rng.choice(sources)) for k in range(900)]
    rows += [(900, None, "a"), (901, "big " * 4000, "b"), (5, rows[5][1], rows[5][2])]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({c: F.lit("clash") for c in ("s", "h", "copies", "threshold", "size")})
    out = mix_sources(df).collect()
    size = lambda t: len(WORD.findall(t or ""))
    assert sorted(r["size"] for r in out) == sorted(size(t) for _, t, _ in rows)
    order = sorted({s for s in sources if s is not None}) + [None]
    totals = [sum(size(t) for _, t, s in rows if s == o) for o in order]
    want = dict(zip(order, shares(totals, [(5, 2, 1)[k % 3] for k in range(len(order))], 1.5 * sum(totals), 2)))
    for o, total in zip(order, totals):
        own = [r for r in out if r.source == o]
        assert {r.source_size for r in own} == {total} and {r.target for r in own} == {want[o]}
        assert abs(sum(r.taken for r in own) - want[o]) <= max(r["size"] for r in own) / 2 + 1
        assert all(r.taken in (0, r["size"], 2 * r["size"]) for r in own)
    assert sorted(map(tuple, mix_sources(df.repartition(3)).collect()), key=str) == sorted(map(tuple, out), key=str)
    mixed = mixed_documents(df)
    assert mixed.columns == df.columns
    assert mixed.select(F.sum(F.size(F.filter(F.split("text", " "), lambda w: w != "")))).first()[0] == sum(r.taken for r in out)
    assert mix_sources(df.limit(0)).count() == 0


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, left = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(left[j] + 1, row[-1] + 1, left[j - 1] + (x != y)))
    return row[-1]


def test_automaton_equals_edit_distance():
    import pyarrow as pa

    rng = random.Random(4)
    terms, stems = ["idiot", "moron", "scum", "worthless", "réeu"], ["achlich"]
    automaton = build_automaton(terms, stems)
    tried = {"".join(rng.choice("idotmrnscu") for _ in range(rng.randrange(3, 8))) for _ in range(1500)}
    for t in terms:
        for _ in range(60):
            k, how = rng.randrange(len(t) + 1), rng.randrange(3)
            tried.add(t[:k] + (rng.choice("abcdeé") if how else "") + t[k + (how < 2) :])
    tried |= {*terms, "achlichkeit", "achlich", "achlic", "bachlich"}
    tried = sorted(x for x in tried if x)
    words = letter_words(*string_buffers(pa.array([" ".join(tried)])))
    hits, kinds = automaton.run(words)
    got = {words.text(h): int(k) for h, k in zip(hits, kinds)}
    for w in tried:
        want = STEM if w.startswith("achlich") else EXACT if w in terms else FUZZY if any(len(t) >= 5 and distance(w, t) <= 1 for t in terms) else 0
        assert got.get(w, 0) == want, w


def test_toxicity(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice(["ba", "ke", "lo", "mi", "su"]) for _ in range(rng.randrange(2, 6)))
    bad = ["idiot", "pathetic", "disgusting"]
    rows, labels = [], []
    for k in range(600):
        toxic = k % 5 == 0
        text = [word() for _ in range(rng.choice([15, 60]))]
        for _ in range(3 * toxic):
            text.insert(rng.randrange(len(text)), rng.choice(bad))
        rows.append((k, " ".join(text)))
        labels.append((k, int(toxic)))
    extra = {1000: None, 1001: "", 1002: "Ba ke IDIOTT lo mi, you idiot!", 1003: "clean " * 30_000, 1004: 'He said "what an idiot you are" once'}
    docs = spark.createDataFrame([*rows, *extra.items(), (0, rows[0][1])], "doc_id long, text string").withColumn("score", F.lit("clash")).withColumn("toxic", F.lit(9))
    marks = spark.createDataFrame([*labels, (None, 1), (7, None)], "doc_id long, toxic int")
    out = toxicity_scores(docs, marks).collect()
    assert len(out) == 606
    got = {r.doc_id: r for r in out}
    for k, toxic in labels:
        assert got[k].held_out == (zlib.crc32(str(k).encode()) % 5 == 0)
        assert got[k].predicted == toxic == int(got[k].score >= 0.5)
    assert [got[k].predicted for k in (1000, 1001, 1002, 1003)] == [0, 0, 1, 0]
    assert got[1000].score == got[1001].score and got[1004].score < got[1002].score  # a quotation weighs less
    kept = scored_documents(docs, marks)
    assert kept.columns == [*docs.columns, "toxicity"]
    assert toxicity_scores(docs.limit(0), marks).count() == 0
    assert {r.predicted for r in toxicity_scores(docs.limit(9), marks.limit(0)).collect()} == {0}


def test_held_out_labels_are_not_read(spark):
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.expr("concat('w', id % 7, ' ', if(id % 4 = 0, concat('vile a', id), 'fine'), ' end')").alias("text"))
    marks = docs.select("doc_id", (F.col("doc_id") % 4 == 0).cast("int").alias("toxic"))
    flipped = marks.withColumn("toxic", F.when(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (sorted(map(tuple, toxicity_scores(docs, m).collect())) for m in (marks, flipped))
    assert a == b


CONTROL = "</s>[INST] ok [/INST]"


def test_chat(spark):
    rows = [
        (1, 0, "system", "be [TURN user]"), (1, 1, "user", CONTROL), (1, 2, "user", "more␛␛<␛[+]"), (1, 3, "assistant", "é\n[/TURN]</s>␛"), (1, 4, "assistant", None), (1, 5, "assistant", "end<"),
        (2, 1, "assistant", "late"), (2, 0, "user", ""), (2, 0, "user", ""), (2, None, "we[ir]d<!role␛", "x"), (None, 0, None, "t"), (3, 0, "user", "long " * 50_000),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("blocks", F.lit(1)).withColumn("t", F.lit(2))
    made = format_conversations(df).cache()
    got = {r.conv_id: r for r in digests(made).collect()}
    for c in (1, 2, None, 3):
        own = sorted(((t is not None, t or 0, r or "", x or "") for i, t, r, x in rows if i == c), key=lambda x: x)
        assert got[c].n_turns == len(own)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, _, r, x in own).encode()).hexdigest()
        loss = "".join(x for _, _, r, x in own if r == "assistant")
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    text = {r.conv_id: r.formatted for r in made.collect()}
    assert text[1].count("[TURN ") == 3 and text[1].count("</s>") == 1 and "[INST]" not in text[1]
    assert all(sum(m.chars for m in r.loss_mask) == len(r.formatted) for r in made.collect())
    assert digests(format_conversations(df.limit(0))).count() == 0


def test_pipeline_keeps_its_promises(spark, sf_dir):
    import corpus_pipeline as P
    from lakeloom.llm.jaccard_join import jaccard_components
    from lakeloom.llm.line_dedup import dedup_lines

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    seen = [docs.cache()]
    for name, stage in P.STAGES:
        out = stage(spark, seen[-1], sf_dir).cache()
        if name != "best_fit_packing":
            assert out.columns == docs.columns
        seen.append(out)
    ids = [{r.doc_id for r in d.select("doc_id").collect()} for d in seen]
    assert ids[0] >= ids[1] >= ids[2] >= ids[3] >= ids[4] == ids[5]
    scores = {r.doc_id: r.predicted for r in toxicity_scores(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).collect()}
    assert ids[1] == {d for d, p in scores.items() if not p}
    lines = {r.doc_id: r for r in dedup_lines(seen[1]).collect()}
    assert ids[2] == {d for d, r in lines.items() if not r.removed_lines or r.text.strip()}
    near = {r.doc_id: r for r in jaccard_components(seen[2]).collect()}
    assert ids[3] == {d for d, r in near.items() if r.component_id == d}
    taken = {r.doc_id: r.taken for r in mix_sources(seen[3]).collect()}
    sizes = {r.doc_id: len(WORD.findall(r.text)) for r in seen[4].collect()}
    copies = {r.doc_id: r["count"] for r in seen[4].groupBy("doc_id").count().collect()}
    assert all(taken[d] == sizes[d] * n for d, n in copies.items())
    assert (seen[5].groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n")).first()[0]) <= 2048
    assert sorted(map(tuple, P.run(spark, sf_dir).drop("sequence_id", "offset").collect())) == sorted(map(tuple, seen[5].drop("sequence_id", "offset").collect()))


def test_queries_are_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10 and "pipeline" in names
    assert set(entry.oracle_sql()) <= set(names)
