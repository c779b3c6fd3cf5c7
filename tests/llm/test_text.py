"""Text primitives, token counts and packing against direct versions."""

import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lakeloom.llm import bpe, textvec
from lakeloom.llm.packing import best_fit_decreasing, bin_bound, pack_documents, split_lengths
from lakeloom.llm.token_counts import RULES, allocate, section_token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t


def random_texts(n, seed=1):
    rng = random.Random(seed)
    letters = " \n\t  '''sstmdrevelllLLE59é中  😀!?.<|endoftext|>\x1c\x85"
    return ["".join(rng.choice(letters) for _ in range(rng.randrange(15))) for _ in range(n)] + [None, "", "it's", "'s", "don't", "''re", "x" * 5000]


def test_ids_equal_the_library(library):
    texts = random_texts(4000)
    data, offsets = textvec.string_buffers(pa.array(texts, pa.string()))
    for first, last, ids, at in bpe.encoder(PATH).chunked(data, offsets):
        for k in range(first, last):
            assert ids[at[k - first] : at[k - first + 1]].tolist() == library.encode(texts[k] or "", add_special_tokens=False).ids


def test_words_and_shingles():
    texts = ["A b\tc\x0bD", "", None, "  ", "a", "a b", " ü\xa0x  y\x85z "]
    data, offsets = textvec.string_buffers(pa.array(texts, pa.string()))
    starts, ends, rows = textvec.words(data, offsets)
    for k, t in enumerate(texts):
        assert [bytes(data[s:e]).decode() for s, e in zip(starts[rows[k] : rows[k + 1]], ends[rows[k] : rows[k + 1]])] == WORD.findall(t or "")
    sets = dict(textvec.document_shingles(data, offsets, 3))
    assert [len(sets[k]) for k in range(7)] == [2, 0, 0, 0, 1, 1, 1]
    again = dict(textvec.document_shingles(*textvec.string_buffers(pa.array(["x", "B c d"], pa.string())), 3))
    assert again[1][0] in sets[0]  # case of A-Z and place do not matter


def test_best_fit_is_exact_and_bounded():
    rng = np.random.default_rng(0)

    def plain(sizes, capacity):
        room = []
        for s in sorted(sizes, reverse=True):
            fits = [(r, k) for k, r in enumerate(room) if r >= s]
            if fits:
                room[min(fits)[1]] -= s
            else:
                room.append(capacity - s)
        return len(room)

    for _ in range(40):
        sizes = rng.integers(1, 101, rng.integers(1, 300))
        bins, offsets = best_fit_decreasing(sizes, 100)
        assert bins.max() + 1 == plain(sizes.tolist(), 100) >= bin_bound(*np.unique(sizes, return_counts=True), 100)
        for b in range(bins.max() + 1):
            own = np.argsort(offsets[bins == b])
            ends = np.cumsum(sizes[bins == b][own])
            assert ends[-1] <= 100 and (offsets[bins == b][own] == ends - sizes[bins == b][own]).all()
    assert bin_bound(np.array([51]), np.array([7]), 100) == 7
    assert bin_bound(np.array([34]), np.array([7]), 100) == 4
    assert split_lengths(2048, 2048) == [2048] and split_lengths(2049, 2048) == [1, 2048] and split_lengths(1, 2048) == [1]


@pytest.fixture(scope="module")
def odd(spark):
    """Null, empty, long, repeated and clashing rows."""
    rows = [(1, None), (2, ""), (3, "word " * 9000), (4, "a b c"), (4, "a b c"), (5, "x\n\ny\n"), (None, "no id")]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("offset", F.lit("clash")).withColumn("piece", F.lit(1)).cache()


def test_pack_documents(spark, library, odd):
    out = pack_documents(odd, PATH).toPandas()
    assert (out.groupby("sequence_id").length.sum() <= 2048).all()
    for _, g in out.sort_values("offset").groupby("sequence_id"):
        assert (g.offset == g.length.cumsum() - g.length).all()
    assert len(out[out.doc_id == 4]) == 2 and out.doc_id.isna().sum() == 1
    ids = np.array([*library.encode("word " * 9000, add_special_tokens=False).ids, 0], "<u4")
    long = out[out.doc_id == 3].sort_values("piece")
    assert long.length.sum() == len(ids) and set(long.length[1:]) == {2048}
    for r in long.itertuples():
        assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
    assert out[out.doc_id == 1].length.tolist() == [1]
    assert pack_documents(odd.limit(0), PATH).count() == 0


def test_pack_exchanges_between_partitions(spark, monkeypatch):
    from lakeloom.llm import packing

    monkeypatch.setattr(packing, "PART_PIECES", 40)
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.expr("repeat('a b ', cast(id * 7919 % 400 as int))").alias("text"))
    out = pack_documents(docs, PATH).toPandas()
    assert len(out) == 400 and (out.groupby("sequence_id").length.sum() <= 2048).all()
    fewest = -(-int(out.length.sum()) // 2048)
    assert out.sequence_id.nunique() <= fewest + 2  # ten partitions alone would leave up to ten open bins


def test_sections(spark, library, odd):
    out = section_token_counts(odd, PATH).toPandas()
    for r in odd.collect():
        own = out[out.doc_id == r.doc_id] if r.doc_id is not None else out[out.doc_id.isna()]
        times = 2 if r.doc_id == 4 else 1
        total = len(library.encode(r.text or "", add_special_tokens=False).ids)
        assert own.n_tokens.sum() == total * times and (own.document_tokens == total).all()
    assert out[out.doc_id == 5].sort_values("section")[["char_start", "char_end"]].values.tolist() == [[0, 2], [2, 3], [3, 5]]
    assert section_token_counts(odd.limit(0), PATH).count() == 0
    with pytest.raises(ValueError):
        section_token_counts(odd, PATH, rule="any")


def test_allocation_rules():
    tokens, sections = np.array([2, 6, 7, 12]), np.array([3, 7, 8, 12])
    got = {rule: allocate(tokens, sections, rule).tolist() for rule in RULES}
    assert got == {"majority": [0, 1, 1, 3], "start": [0, 0, 1, 2], "end": [0, 1, 1, 3]}
    assert allocate(np.array([2]), np.array([1, 2]), "majority").tolist() == [0]  # the earlier one on a tie
