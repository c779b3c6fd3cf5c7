"""Spans are those that reading every window of a text would give."""

import random

import numpy as np

from lakeloom.llm import pii
from lakeloom.llm.char_tagger import PAD

PARTS = ["me", " at ", " At ", "@", "[at]", "some", ".", " . ", " dot ", " (dot) ", "-dot-", "[.]", "org", "1", "22", "4539", " ", "  ", "-", "/", "+", "00", "(", ")", "\n", "é", "x" * 60, "٣", "at-", "_", "t", ", "]


class Eager:
    """Tags at random, the same for equal windows: many runs of all kinds."""

    def decode(self, codes):
        tags, sure = np.zeros(codes.shape, np.int64), np.ones(codes.shape)
        for row, own in zip(tags, codes, strict=True):
            rng, at, width = np.random.default_rng(int(own.astype(np.int64) @ np.arange(len(own)))), 0, int((own != PAD).sum())
            while at < width:
                n, kind = int(rng.integers(1, 40)), int(rng.integers(5))
                row[at : min(at + n, width)] = 0 if kind == 4 else 2 + 2 * kind
                at += n
        return tags, sure


def test_windows_left_out_change_nothing(monkeypatch):
    rng = random.Random(9)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randrange(200))) for _ in range(1_500)]
    some = pii.found_spans(texts, Eager())
    monkeypatch.setattr(pii, "windows", pii.all_windows)
    assert some == pii.found_spans(texts, Eager()) and sum(not s[3] for mine in some for s in mine) >= 10


def test_every_plausible_span_is_within_windows():
    rng, seen = random.Random(10), 0
    for _ in range(60_000):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randrange(4, 14)))
        kinds = [k for k in pii.KINDS if pii.plausible(k, text)]
        if kinds:
            seen += 1
            before, after = rng.choice(["", "y" * 200 + " ", "y. "]), rng.choice(["", " z" * 100])
            read = {p for a, b in pii.windows(before + text + after) for p in range(a, b)}
            assert set(range(len(before), len(before) + len(text))) <= read, text
    assert seen > 100
    for text in ("1 (dot) 2 (dot) 3 (dot) 4", "Me At some dot org", "me at\nsome dot org", "4539____1488____0343____6467"):
        assert any(pii.plausible(k, text) for k in pii.KINDS)
        assert pii.windows("y" * 300 + " " + text) != []
