"""Fingerprints and likeness of a text longer than a sketch count all of its anchors."""

import random

from test_places import twin_anchors, twin_likeness

from lakeloom.llm.syncmers import fingerprint_report


def test_no_anchor_of_a_long_text_is_left_out(spark):
    rng = random.Random(7)
    word = lambda: f"w{rng.randrange(2_000)}"
    base = [word() for _ in range(3_000)]
    texts = {4: " ".join(base), 3: " ".join([*base[:2_990], *(word() for _ in range(10))]), 2: " ".join(base[1_500:] + base[:1_500]), 1: "a b c d"}
    order = sorted(texts, reverse=True)
    got = {r.doc_id: r for r in fingerprint_report(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    for d, n in zip(order, order[1:] + order[:1]):
        own, cut = texts[d], len(texts[d]) // 3
        mine, following, changed = (twin_anchors(t, keep=None) for t in (own, texts[n], own[: len(own) - cut] + texts[n][:cut]))
        assert got[d].fingerprint == ",".join(f"{h % 2**64:016x}:{p:x}" for h, p in mine)
        assert got[d].near_next == twin_likeness(mine, following, None) and got[d].near_edited == twin_likeness(mine, changed, None)
    assert got[4].fingerprint != got[3].fingerprint and 0.99 < got[4].near_next < 1
