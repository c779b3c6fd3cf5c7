"""Operator 2: best-fit packing with certified bin counts.

Documents become token pieces of at most ``capacity``; each partition of pieces is packed by
best-fit decreasing, and dual-feasible functions give a lower bound that certifies its number
of bins. While the partitions together use more bins than the bound of the whole table, bins are
opened and their pieces exchanged: a partition with a gap gives its emptiest bins, up to half of
its pieces, a certified one only its emptiest bin. They are dealt to half as many partitions and
packed again, and the new bins are taken if they are fewer. The last round is one partition.

Best fit runs on (size, count) groups, bin by bin exact, so a partition's work follows the
number of distinct sizes. A partition holds about ``PART_PIECES`` pieces at any input size.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.llm import bpe, textvec
from lakeloom.llm.scratch import Scratch

PART_PIECES = 50_000
STEPS = 24  # staircase functions tried for a bound
NEVER = 2**62

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def split_lengths(total: int, capacity: int) -> list[int]:
    """Piece lengths of one document: whole capacities, after a first piece with the rest."""
    first = total % capacity or min(total, capacity)
    return [first] + [capacity] * ((total - first) // capacity)


def _pieces(path: str, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = bpe.encoder(path)
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            data, offsets = textvec.string_buffers(batch.column(1))
            rows = []
            for first, last, ids, at in encode.chunked(data, offsets):
                for k in range(first, last):
                    own = np.append(ids[at[k - first] : at[k - first + 1]], np.uint32(end_id)).astype("<u4")
                    start = 0
                    for piece, length in enumerate(split_lengths(len(own), capacity)):
                        rows.append((doc_ids[k], piece, start, length, zlib.crc32(own[start : start + length].tobytes())))
                        start += length
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return textvec.frugal(run)


def token_pieces(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece of every document's ids and ``end_id``; a null text is empty and has one piece of one id."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_pieces(path, capacity, end_id), PIECES)


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of every piece, as best fit gives them for pieces in decreasing order.

    Equal sizes are placed together: the fullest bins that still fit take as many as they hold,
    which is what placing them one at a time does.
    """
    order = np.argsort(-lengths, kind="stable")
    sizes, counts = np.unique(lengths, return_counts=True)
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    open_bins: dict[int, list[int]] = {}
    rooms = np.zeros(capacity + 1, bool)
    used = item = 0
    for size, count in zip(sizes[::-1].tolist(), counts[::-1].tolist(), strict=True):
        while count:
            fits = int(rooms[size:].argmax()) + size
            if fits <= capacity and rooms[fits]:
                room, own = fits, open_bins[fits]
            else:
                room = capacity
                new = -(-count // (capacity // size))
                own = list(range(used, used + new))
                used += new
                open_bins[capacity] = own
            each = room // size
            full = min(len(own), count // each)
            if not full:
                full, each = 1, count
            taken, rest = own[:full], own[full:]
            place = order[item : item + full * each]
            bins[place] = np.repeat(taken, each)
            offsets[place] = np.tile(capacity - room + size * np.arange(each), full)
            item += full * each
            count -= full * each
            if rest:
                open_bins[room], rooms[room] = rest, True
            else:
                open_bins.pop(room, None)
                rooms[room] = False
            left = room - size * each
            if left:
                open_bins.setdefault(left, []).extend(taken)
                rooms[left] = True
    return bins, offsets


def bin_bound(sizes: np.ndarray, counts: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs at least, by dual-feasible functions.

    Tried are the identity, for each threshold the function that lifts sizes above
    ``capacity - t`` to a whole bin and drops those below ``t``, and staircases of 2..STEPS steps.
    """
    if not len(sizes):
        return 0
    best = int(-(-int((sizes * counts).sum()) // capacity))
    for t in np.unique(np.minimum(sizes, capacity - sizes)):
        if 0 < t <= capacity // 2:
            lifted = np.where(sizes > capacity - t, capacity, np.where(sizes < t, 0, sizes))
            best = max(best, int(-(-int((lifted * counts).sum()) // capacity)))
    for k in range(1, STEPS):
        scaled = sizes * (k + 1)
        steps = np.where(scaled % capacity == 0, sizes * k, scaled // capacity * capacity)  # in units of 1/k
        best = max(best, int(-(-int((steps * counts).sum()) // (capacity * k))))
    return best


def _packer(capacity: int, base: int):
    """Packs a partition. ``give``: how many pieces it gives if it gives all bins up to this one, the emptiest first."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        lengths = table["length"].to_numpy()
        bins, offsets = best_fit_decreasing(lengths, capacity)
        fill = np.bincount(bins, weights=lengths).astype(np.int64)
        certified = len(fill) == bin_bound(*np.unique(lengths, return_counts=True), capacity)
        emptiest = np.argsort(fill, kind="stable")
        give = np.zeros(len(fill), np.int64)
        give[emptiest] = np.cumsum(np.bincount(bins)[emptiest])
        give[emptiest[1:] if certified else fill == capacity] = NEVER
        out = {"sequence_id": (base + key[0].as_py() << 32) + bins, "offset": offsets, "give": give[bins]}
        table = table.drop_columns(["part"])
        for name, column in out.items():
            table = table.append_column(name, pa.array(column))
        return table

    return run


def pack(pieces: DataFrame, scratch: Scratch, capacity: int = 2048) -> DataFrame:
    """``pieces`` with sequence_id and offset; no sequence exceeds ``capacity`` and none has a gap.

    Whole pieces are sequences of their own. Rows that are equal in every column are distinct
    pieces. An empty table gives an empty result.
    """
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    kept = scratch.keep(pieces.withColumn("uid", F.monotonically_increasing_id()), "pieces")
    out = kept.where(F.col("length") == capacity).select(*columns, (F.col("uid") + F.lit(1 << 62)).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    pool = kept.where(F.col("length") < capacity)
    # one row per size: at most `capacity` rows
    histogram = pool.groupBy("length").count().toPandas()
    bound = bin_bound(histogram["length"].to_numpy(np.int64), histogram["count"].to_numpy(np.int64), capacity)
    parts = max(1, -(-int(histogram["count"].sum()) // PART_PIECES))
    schema = PIECES + ", uid long, sequence_id long, offset long, give long"
    bins_of = lambda df: df.agg(F.count_distinct("sequence_id")).first()[0]
    settled_bins, now, now_bins, now_parts, round_ = 0, None, 0, parts, 0
    while True:
        dealt = pool.select(*columns, "uid", F.pmod(F.xxhash64("uid", F.lit(round_)), F.lit(parts)).alias("part"))
        packed = scratch.keep(dealt.groupBy("part").applyInArrow(_packer(capacity, round_ << 24), schema), f"round{round_}")
        bins = bins_of(packed)
        if now is None or bins < now_bins:  # otherwise the exchange has brought nothing, and the bins stay as they were
            now, now_bins, now_parts = packed, bins, parts
        if parts == 1 or settled_bins + now_bins <= bound:
            break
        parts //= 2
        given = F.col("give") <= max(1, PART_PIECES * parts // now_parts)
        pool = now.where(given)
        closed, opened_bins = now.where(~given), bins_of(pool)
        if not opened_bins:
            break
        out = out.unionByName(closed.select(*columns, "sequence_id", "offset"))
        settled_bins, now, now_bins, round_ = settled_bins + now_bins - opened_bins, pool, opened_bins, round_ + 1
    return out.unionByName(now.select(*columns, "sequence_id", "offset"))


def pack_documents(docs: DataFrame, path: str, *, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Packs all rows of ``docs``: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null text is empty (one piece: the end id). Only documents longer than ``capacity`` are
    cut. Repeated rows and null ids are packed like any other row; extra columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    return pack(token_pieces(docs, path, capacity, end_id, id_col, text_col), scratch, capacity)
