"""Vectorised text primitives over Arrow string buffers (NumPy only, no per-word Python).

Everything works on whole texts. A batch is cut into chunks of whole documents so that
working memory follows ``CHUNK`` (or the longest single text), not the batch.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1_000_000

_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FOLDED = _BYTE.copy()
_FOLDED[65:91] = _BYTE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_UNBASE = pow(_BASE, -1, 2**64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the hash's odd base and of its inverse, modulo 2**64."""
    if len(_powers[0]) <= n:
        size = 1 << max(18, n.bit_length())
        for k, base in enumerate((_BASE, _UNBASE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def range_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each ``values[start:end]`` that depends on its content and length only."""
    up, down = powers(len(values))
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    h = (sums[ends] - sums[starts]) * down[starts]
    return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


#: What tasks leave in a worker's memory; a worker is used again by other tasks, of other stages.
_held: list[Callable[[], None]] = []


def forgets(let_go: Callable[[], None]) -> None:
    """Has ``let_go`` called at the end of each task whose function is ``frugal``."""
    if let_go not in _held:
        _held.append(let_go)


def give_back() -> None:
    """Lets go of all that tasks have left in this worker."""
    for let_go in _held:
        let_go()
    _powers[:] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def frugal(run: Callable) -> Callable:
    """``run`` (over an iterator of batches), after which the worker gives its memory back."""

    def task(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and the offsets of each row; null rows are empty."""
    column = pc.fill_null(column, "") if column.null_count else column
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32, len(column) + 1 + column.offset)[column.offset :].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if len(column) and column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``size`` bytes, each of whole documents."""
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1)
        yield row, end
        row = end


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the words ``[^\\x20\\x09-\\x0D]+``, and the first word of each row (with a last bound)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~_SPACE[data]
    start = inside[1:-1] & ~inside[:-2]
    stop = inside[1:-1] & ~inside[2:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    start[edges] = inside[1:-1][edges]
    stop[edges - 1] = inside[1:-1][edges - 1]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(stop) + 1, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = False) -> np.ndarray:
    """64-bit hash of each word; ``fold`` reads A-Z as a-z."""
    return range_hashes((_FOLDED if fold else _BYTE)[data], starts, ends)


def shingle_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of the ``width`` words from each word on (the last ones of a chunk are meaningless)."""
    out = np.zeros(len(hashes), np.uint64)
    for k in range(width):
        out[: len(hashes) - k] += hashes[k:] * np.uint64(powers(width)[0][k] | np.uint64(1))
    return mix(out)


def document_shingles(data: np.ndarray, offsets: np.ndarray, width: int, fold: bool = True) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of every row; fewer words than ``width``: the whole sequence as one; no word: none."""
    none = np.zeros(0, np.uint64)
    for first, last in chunks(offsets):
        part, at = data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        starts, ends, rows = words(part, at)
        hashes = word_hashes(part, starts, ends, fold)
        full = shingle_hashes(hashes, width)
        for k in range(last - first):
            a, b = rows[k], rows[k + 1]
            if b - a >= width:
                yield first + k, np.unique(full[a : b - width + 1])
            elif b > a:
                yield first + k, np.array([shingle_hashes(np.append(hashes[a:b], np.zeros(width, np.uint64)), width)[0] + np.uint64(b - a)], np.uint64)
            else:
                yield first + k, none
