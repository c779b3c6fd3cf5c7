"""Byte-level BPE over whole Arrow batches.

The published pre-tokenizer pattern is evaluated with NumPy over code points; every distinct
piece is then encoded once per worker and its ids are gathered. The vocabulary and its merge
order come from a ``tokenizers`` file; single pieces are merged by ``tiktoken``'s core, which is
several times as fast on a cache miss. The ids equal those of the ``tokenizers`` library,
``Tokenizer.encode(text, add_special_tokens=False)`` with special strings read as ordinary text
(the tests compare the two).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np

from lakeloom.llm import textvec

CACHE_PIECES = 200_000  # distinct pieces a worker remembers, some 30 MB, before it starts anew
TABLE_POINTS = 1 << 14  # code points classed at once
CHUNK = 1 << 18  # bytes of text encoded at once: working memory is some 60 times that

_SPACE, _LETTER, _NUMBER, _OTHER = range(4)
_tables: list[np.ndarray] = []
_encoders: dict[str, PieceEncoder] = {}


def _code_point_tables() -> tuple[np.ndarray, np.ndarray]:
    """Class and hash value of every code point."""
    if not _tables:
        from tokenizers import Regex, normalizers

        table, hashes = np.full(0x110000, _OTHER, np.uint8), np.zeros(0x110000, np.uint64)
        patterns = [(k, normalizers.Replace(Regex(p), "")) for k, p in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_SPACE, r"\s+"))]  # as the library's own engine has them
        # (the library takes some 30 bytes for each byte that it replaces in: all code points at once are 150 MB)
        for first in range(0, 0x110000, TABLE_POINTS):
            points = np.arange(first, min(first + TABLE_POINTS, 0x110000), dtype=np.uint32)
            hashes[points] = textvec.mix(points.astype(np.uint64) + np.uint64(0xA0761D6478BD642F))
            usable = points[(points < 0xD800) | (points > 0xDFFF)]
            text = usable.tobytes().decode("utf-32-le")
            for kind, pattern in patterns if text else ():
                others = np.frombuffer(pattern.normalize_str(text).encode("utf-32-le"), np.uint32)
                table[np.setdiff1d(usable, others, assume_unique=True)] = kind
        _tables.extend((table, hashes))
    return _tables[0], _tables[1]


def piece_starts(points: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where the pre-tokenizer's pieces start; ``bounds`` are the documents' code point offsets."""
    kinds = _code_point_tables()[0][points]
    n = len(points)
    start = np.ones(n + 1, bool)
    start[1:n] = kinds[1:] != kinds[:-1]
    first = np.zeros(n + 1, bool)
    first[bounds] = True
    start |= first
    runs = np.flatnonzero(start[:n])
    ends = np.append(runs[1:], n)
    # white space before other text of its document gives its last character away
    gives = ends[(kinds[runs] == _SPACE) & ~first[ends]]
    start[gives - 1] = True
    start[gives[points[gives - 1] == 0x20]] = False
    # 's 't 'm 'd 're 've 'll where a piece begins at the apostrophe
    q = np.flatnonzero((points == 0x27) & start[:n])
    q = q[(q + 1 < n)]
    q = q[~first[q + 1] & (kinds[np.minimum(q + 1, n - 1)] == _LETTER)]
    padded = np.append(points, [0, 0])
    one, two = padded[q + 1], padded[q + 2]
    short = q[np.isin(one, [ord(c) for c in "stmd"])]
    pair = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
    long = q[pair & ~first[np.minimum(q + 2, n)]]
    start[short + 1] = False
    start[short + 2] = True
    start[long + 1] = False
    start[long + 3] = True
    return np.flatnonzero(start[:n])


class PieceEncoder:
    """Ids of whole batches through a bounded cache of pieces."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that byte-level vocabularies show as themselves
        hidden = [b for b in range(256) if b not in shown]
        byte_of = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}
        tokenizer = Tokenizer.from_file(path)
        special = {t.content for t in tokenizer.get_added_tokens_decoder().values()}
        self.names = {k: v for k, v in tokenizer.get_vocab(with_added_tokens=True).items() if k not in special}
        ranks = {bytes(byte_of[c] for c in name): k for name, k in self.names.items()}
        self.merge = tiktoken.Encoding("pieces", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self._forget()
        textvec.forgets(self._forget)

    def _forget(self) -> None:
        self.slot: dict[int, int] = {}
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.at, self.size = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)

    def _room(self, name: str, need: int) -> None:
        held = getattr(self, name)
        if need > len(held):
            setattr(self, name, np.concatenate([held, np.zeros(max(need - len(held), len(held)), held.dtype)]))

    def _learn(self, hashes: list[int], pieces: list[bytes]) -> None:
        lists = [*map(self.merge, pieces)]
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        ids = np.fromiter(chain.from_iterable(lists), np.uint32, int(sizes.sum()))
        have = len(self.slot)
        self._room("flat", self.used + len(ids))
        self._room("at", have + len(lists))
        self._room("size", have + len(lists))
        self.flat[self.used : self.used + len(ids)] = ids
        self.at[have : have + len(lists)] = self.used + np.cumsum(sizes) - sizes
        self.size[have : have + len(lists)] = sizes
        self.used += len(ids)
        self.slot.update(zip(hashes, range(have, have + len(lists)), strict=True))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all documents in a row, and the documents' offsets in them."""
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        lead = (data & 0xC0) != 0x80
        bounds = np.concatenate([[0], np.cumsum(lead)])[offsets]
        starts = piece_starts(points, bounds)
        ends = np.append(starts[1:], len(points))
        hashes = textvec.range_hashes(_code_point_tables()[1][points], starts, ends)
        distinct, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.slot) > CACHE_PIECES:
            self._forget()
        keys = distinct.tolist()
        new = [k for k, h in enumerate(keys) if h not in self.slot]
        if new:
            whole, places = data.tobytes(), np.append(np.flatnonzero(lead), len(data))
            a, b = places[starts[first[new]]].tolist(), places[ends[first[new]]].tolist()
            self._learn([keys[k] for k in new], [whole[x:y] for x, y in zip(a, b, strict=True)])
        slots = np.fromiter((self.slot[h] for h in keys), np.int64, len(keys))[inverse]
        sizes = self.size[slots]
        after = np.cumsum(sizes)
        ids = self.flat[np.repeat(self.at[slots] - (after - sizes), sizes) + np.arange(after[-1])]
        return ids, np.concatenate([[0], after])[np.searchsorted(starts, bounds)]

    def chunked(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first row, last row, ids, offsets in ids) for chunks of whole documents."""
        for first, last in textvec.chunks(offsets, CHUNK):
            ids, at = self.encode(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
            yield first, last, ids, at

    def byte_lengths(self) -> np.ndarray:
        """Bytes of text behind each id: in this vocabulary every character of a token stands for one byte."""
        if not hasattr(self, "lengths"):
            self.lengths = np.zeros(max(self.names.values()) + 1, np.int64)
            for name, k in self.names.items():
                self.lengths[k] = len(name)
        return self.lengths


def encoder(path: str) -> PieceEncoder:
    """The worker's encoder for a vocabulary file."""
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]
