"""Line dedup against brute force: long lines, common words, clashing columns, null, shared and repeated ids."""

import random

from lakeloom.llm import line_dedup
from lakeloom.llm.line_dedup import dedup_lines


def brute(rows):
    """Removed lines of (id, text) rows with distinct ids, null last."""
    sets, out = [], {}
    for i, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        out[i] = []
        for k, line in enumerate((text or "").split("\n")):
            words = set(line.replace("\t", " ").replace("\r", " ").split(" ")) - {""}
            if words and any(100 * len(words & s) >= 80 * len(words | s) for s in sets):
                out[i].append(k)
            sets.append(words)
    return out


def variants(rng, count, size, most):
    base = [f"w{rng.randrange(4000)}" for _ in range(size)]
    for _ in range(count):
        line = list(base)
        for _ in range(rng.randrange(most + 1)):
            line[rng.randrange(size)] = f"x{rng.randrange(10**6)}"
        yield " ".join(line)


def test_against_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    lines = [v for size, most in ((6, 2), (12, 4), (30, 9), (75, 20), (150, 40)) for _ in range(3) for v in variants(rng, 12, size, most)]
    lines += ["", "same\tline here again now", "same line\rhere again now"]
    rng.shuffle(lines)
    rows = [(i, "\n".join(lines[i * 5 : i * 5 + 5])) for i in range(len(lines) // 5 + 1)] + [(None, lines[0]), (900, None), (901, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute([r for r in rows if r[1]])
    for hot, times in ((1_000, 4), (2, 0)):  # words that meet all holders, words that meet the first one first
        monkeypatch.setattr(line_dedup, "HOT", hot)
        monkeypatch.setattr(line_dedup, "HOT_TIMES", times)
        got = {r.doc_id: r.removed_lines for r in dedup_lines(df).collect()}
        assert {k: v for k, v in got.items() if k not in (900, 901)} == want
        assert got[900] == got[901] == []


def test_names_ids_and_repeats(spark):
    rows = [(1, "a b c d e\nfresh words of one", 5, 6, 7, 8), (1, "a b c d e\nfresh words of one", 5, 6, 7, 8), (2, "a b c d e\nother", 5, 6, 7, 8), (2, "unlike\na b c d e", 5, 6, 7, 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _id int, _th int, _lost int, N_lines int")
    got = dedup_lines(df)
    assert got.columns == ["doc_id", "text", "_id", "_th", "_lost", "n_lines", "removed_lines"]
    assert sorted((r.doc_id, r.text, r._id, r._th, r._lost, r.n_lines, r.removed_lines) for r in got.collect()) == [(1, rows[0][1], 5, 6, 7, 2, [])] * 2 + [(2, "other", 5, 6, 7, 2, [0]), (2, "unlike", 5, 6, 7, 2, [1])]
    assert dedup_lines(df.limit(0)).collect() == []
