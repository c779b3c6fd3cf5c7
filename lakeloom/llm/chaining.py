"""Operator 4: substring dedup by collinear chaining of shared k-mer seeds.

1. Seeds are minimizers: of each ``WINDOW`` runs of ``K`` words the one with the least hash, so
   every stretch of ``K + WINDOW - 1`` equal words has a seed at the same place in each text.
2. Each seed's occurrences are joined to the earliest document that has it, not to each other,
   so a passage in many documents costs one match for each of them. Texts that are equal are
   represented by their first document.
3. The matches of two documents are chained: a chain goes forward in both, and its score is the
   words it covers less a gap cost. The best predecessor is found with a Fenwick tree over the
   positions in the earlier document.
4. Chains are aligned: each gap between anchors, and the ends, are aligned word by word in a
   band, and the passage kept if it is long and alike enough.
5. Seeds of one passage may have different earliest documents, each with a part that is too short.
   So every run of as many words as a passage has at least, whose seeds are all shared and which
   no passage covers yet, meets the earliest document that holds that whole run.

The result names passages of the later document and where they stand in the earlier one.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.llm import textvec
from lakeloom.llm.scratch import Scratch

K = 8  # words in a seed
WINDOW = 12  # runs of which the least is a seed
GAP = 40  # words between two anchors of a chain, at most
GAP_COST = 0.25  # per word of difference between the gaps in the two texts
LEAST_WORDS = 50  # of a passage
IDENTITY = 0.8  # share of aligned words that are equal
REACH = 32  # words that the ends of a passage may go on without a better score
MARGIN, STEP = 128, 64  # words around a chain that its alignment may use; windows begin at steps
NEAR = 40  # words beside a chain that are looked at first
ALIGN_ROWS = 500  # chains that are held as Python values at once


def minimizers(hashes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, word position in it, seed) of the minimizers of each document in a chunk."""
    runs = textvec.shingle_hashes(hashes, K)
    n = len(runs)
    counts = np.diff(rows)
    chosen = np.zeros(n, bool)
    if n >= WINDOW:
        windows = np.lib.stride_tricks.sliding_window_view(runs, WINDOW)
        at = np.arange(len(windows)) + windows.argmin(1)
        first = np.arange(len(windows))
        own = np.searchsorted(rows, first, "right") - 1
        whole = first + WINDOW - 1 + K - 1 < rows[own + 1]  # the window's runs lie within the document
        chosen[at[whole]] = True
    for d in np.flatnonzero((counts >= K) & (counts < K + WINDOW - 1)):  # shorter than a window: its least run
        a, b = rows[d], rows[d + 1] - K + 1
        chosen[a + runs[a:b].argmin()] = True
    place = np.flatnonzero(chosen)
    own = np.searchsorted(rows, place, "right") - 1
    return own, place - rows[own], runs[place]


def _seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0)
        data, offsets = textvec.string_buffers(batch.column(1))
        for first, last in textvec.chunks(offsets):
            part = data[offsets[first] : offsets[last]]
            starts, ends, rows = textvec.words(part, offsets[first : last + 1] - offsets[first])
            own, place, seed = minimizers(textvec.word_hashes(part, starts, ends, fold=True), rows)
            yield pa.RecordBatch.from_arrays([pa.array(seed.view(np.int64)), ids.take(pa.array(own + first)), pa.array(place.astype(np.int32))], names=["seed", "doc", "at"])


class _Fenwick:
    """Greatest (score, index) over the positions up to one, with point updates."""

    def __init__(self, n: int):
        self.best = [(-1e18, -1)] * (n + 1)

    def put(self, k: int, value: tuple[float, int]) -> None:
        k += 1
        while k < len(self.best):
            if value > self.best[k]:
                self.best[k] = value
            k += k & -k

    def most(self, k: int) -> tuple[float, int]:
        out = (-1e18, -1)
        k += 1
        while k > 0:
            if self.best[k] > out:
                out = self.best[k]
            k -= k & -k
        return out


def chain(later: np.ndarray, earlier: np.ndarray) -> list[list[int]]:
    """Chains of the matches (positions in both texts), each a list of indices in order.

    A match follows another that stands before it in both texts, by the same diagonal or at a
    gap cost; of all predecessors the tree gives the best by score less its distance. A link
    over more than ``GAP`` words in either text ends the chain.
    """
    order = np.lexsort((earlier, later))
    steps = np.diff(later[order])
    if (np.diff(earlier[order]) == steps).all() and (steps > 0).all():
        # one diagonal: the best predecessor is the one just before, so chains end at wide gaps only
        return [c.tolist() for c in np.split(order, np.flatnonzero(steps > GAP + K) + 1)]
    a, b = later[order].tolist(), earlier[order].tolist()
    ranks = {p: k for k, p in enumerate(sorted(set(b)))}
    tree = _Fenwick(len(ranks))
    score, before = [float(K)] * len(a), [-1] * len(a)
    waiting: deque[int] = deque()
    for i in range(len(a)):
        # matches at the same later position do not follow each other
        while waiting and a[waiting[0]] < a[i]:
            j = waiting.popleft()
            tree.put(ranks[b[j]], (score[j] + GAP_COST * (a[j] + b[j]), j))
        rank = ranks[b[i]] - 1
        if rank >= 0:
            _, j = tree.most(rank)
            if j >= 0 and a[i] - a[j] <= GAP + K and b[i] - b[j] <= GAP + K:
                gain = min(K, a[i] - a[j], b[i] - b[j]) - GAP_COST * abs((a[i] - a[j]) - (b[i] - b[j]))
                if score[j] + gain > K:
                    score[i], before[i] = score[j] + gain, j
        # the same diagonal a little earlier is always a candidate: a run of seeds is one chain
        for j in range(i - 1, max(-1, i - 6), -1):
            if a[i] - a[j] > GAP + K:
                break
            if a[j] < a[i] and a[i] - a[j] == b[i] - b[j] and score[j] + min(K, a[i] - a[j]) > score[i]:
                score[i], before[i] = score[j] + min(K, a[i] - a[j]), j
        waiting.append(i)
    out, used = [], set()
    for i in sorted(range(len(a)), key=lambda k: -score[k]):
        path = []
        while i >= 0 and i not in used:
            used.add(i)
            path.append(i)
            i = before[i]
        if path:
            out.append([int(order[k]) for k in path[::-1]])
    return out


CHAINS = "doc long, e_doc long, a0 int, a1 int, b0 int, b1 int, a_at array<int>, b_at array<int>"
PAIR = ("doc", "e_doc", "at", "e_at")


def _told_chains(doc: np.ndarray, e_doc: np.ndarray, later: np.ndarray, earlier: np.ndarray, opens: np.ndarray) -> pa.RecordBatch:
    """Chains given as stretches of matches, each from one place of ``opens`` to the next: word spans with their anchors."""
    ends = np.append(opens[1:], len(later)) - 1
    offsets = pa.array(np.append(opens, len(later)).astype(np.int32))
    spans = [x.astype(np.int32) for x in (later[opens], later[ends] + K, earlier[opens], earlier[ends] + K)]
    lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (later, earlier)]
    return pa.RecordBatch.from_arrays([pa.array(doc[opens]), pa.array(e_doc[opens]), *map(pa.array, spans), *lists], names=["doc", "e_doc", "a0", "a1", "b0", "b1", "a_at", "b_at"])


def _chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chains of each pair of documents, from matches in order of (doc, e_doc, at, e_at).

    Pairs whose matches are on one diagonal are cut at wide gaps, all of a batch at once; the others
    go through the tree one by one. A pair that goes on in the next batch waits for it.
    """

    def chained(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        doc, e_doc, later, earlier = rows
        if not len(doc):
            return
        new = np.ones(len(doc), bool)
        new[1:] = (np.diff(doc) != 0) | (np.diff(e_doc) != 0)
        steps, others = np.diff(later, prepend=0), np.diff(earlier, prepend=0)
        bent = ~new & ((steps != others) | (steps <= 0))
        pair = np.cumsum(new) - 1
        tree = np.zeros(pair[-1] + 1, bool)
        tree[pair[bent]] = True
        straight = ~tree[pair]
        if straight.any():
            opens = np.flatnonzero((new | (steps > GAP + K))[straight])
            yield _told_chains(doc[straight], e_doc[straight], later[straight], earlier[straight], opens)
        starts = np.append(np.flatnonzero(new), len(doc))
        places = [lo + np.array(path) for lo, hi in ((starts[p], starts[p + 1]) for p in np.flatnonzero(tree)) for path in chain(later[lo:hi], earlier[lo:hi])]
        if places:
            order = np.concatenate(places)
            opens = np.cumsum([0, *map(len, places[:-1])])
            yield _told_chains(doc[order], e_doc[order], later[order], earlier[order], opens)

    kept = [np.zeros(0, np.int64)] * 4
    for batch in batches:
        rows = [np.concatenate([k, batch.column(c).to_numpy().astype(np.int64)]) for k, c in zip(kept, PAIR, strict=True)]
        same = (rows[0] == rows[0][-1:]) & (rows[1] == rows[1][-1:])
        last = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0  # where the last pair starts
        yield from chained([r[:last] for r in rows])
        kept = [r[last:] for r in rows]
    yield from chained(kept)


def align(x: list[int], y: list[int]) -> int:
    """Words that a best alignment of two short stretches matches (longest common subsequence).

    A row of the table is one number: bit j is 0 where column j + 1 is greater than column j.
    """
    if not x or not y:
        return 0
    places: dict[int, int] = {}
    for j, w in enumerate(y):
        places[w] = places.get(w, 0) | 1 << j
    every = row = (1 << len(y)) - 1
    for w in x:
        equal = row & places.get(w, 0)
        row = (row + equal | row - equal) & every
    return len(y) - row.bit_count()


def extend(x: list[int], y: list[int]) -> tuple[int, int, int]:
    """How far two stretches agree from their start on: words of each, and equal words among them.

    Equal words score 1 and others -1, over edits of one word at a time; the best prefix counts.
    """
    return _extended(x, y)[:3]


def _extended(x: list[int], y: list[int]) -> tuple[int, int, int, int, int]:
    """What ``extend`` gives, and how far it has read in both."""
    i = j = same = score = 0
    best = (0, 0, 0, 0)
    while i < len(x) and j < len(y) and score > best[0] - 8 and i - best[1] < REACH:
        if x[i] == y[j]:
            step = (1, 1, 1)
        elif i + 1 < len(x) and x[i + 1] == y[j]:
            step = (1, 0, 0)
        elif j + 1 < len(y) and x[i] == y[j + 1]:
            step = (0, 1, 0)
        else:
            step = (1, 1, 0)
        i, j, same = i + step[0], j + step[1], same + step[2]
        score += 1 if step[2] else -1
        if score > best[0]:
            best = (score, i, j, same)
    return (*best[1:], i, j)


def _extend_from(x: np.ndarray, y: np.ndarray) -> tuple[int, int, int]:
    """``extend`` of two arrays; only if it does not end within ``NEAR`` words all of them become Python numbers."""
    *best, i, j = _extended(x[:NEAR].tolist(), y[:NEAR].tolist())
    if i + 1 >= NEAR or j + 1 >= NEAR:
        return extend(x.tolist(), y.tolist())
    return tuple(best)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The word hashes of the wanted windows of each document."""
    for batch in batches:
        ids, wanted = batch.column(0).to_pylist(), batch.column(2).to_pylist()
        data, offsets = textvec.string_buffers(batch.column(1))
        for first, last in textvec.chunks(offsets):
            part = data[offsets[first] : offsets[last]]
            starts, ends, rows = textvec.words(part, offsets[first : last + 1] - offsets[first])
            hashes = textvec.word_hashes(part, starts, ends, fold=True)
            out = [(ids[k], w["w0"], w["w1"], hashes[rows[k - first] : rows[k - first + 1]][w["w0"] : w["w1"]].tobytes()) for k in range(first, last) for w in wanted[k]]
            cols = list(zip(*out, strict=True)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["doc", "w0", "w1", "hashes"])


def _runs(least: int):
    """(run, doc, at, open) of the runs of ``least`` words whose seeds are all shared; open: in no passage."""
    inner = max(0, least - (K + WINDOW - 1) + 1)  # windows of seeds within a run

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, shared, spans = batch.column(0), batch.column(2), batch.column(3)
            data, offsets = textvec.string_buffers(batch.column(1))
            for first, last in textvec.chunks(offsets):
                part = data[offsets[first] : offsets[last]]
                starts, ends, rows = textvec.words(part, offsets[first : last + 1] - offsets[first])
                hashes = textvec.word_hashes(part, starts, ends, fold=True)
                seeds = textvec.shingle_hashes(hashes, K)
                out = [(np.zeros(0, np.int64),) * 4]
                for d in range(first, last):
                    a, n = rows[d - first], rows[d - first + 1] - rows[d - first] - least + 1
                    if n < 1:
                        continue
                    fine = np.ones(n, bool)
                    if inner:
                        known = np.zeros(n + least, bool)
                        at = shared[d].values.to_numpy()
                        known[at[at < len(known)]] = True
                        windows = np.lib.stride_tricks.sliding_window_view(seeds[a : a + n + least - K], WINDOW)
                        lacks = np.zeros(len(windows) + 1, np.int64)
                        np.cumsum(~known[np.arange(len(windows)) + windows.argmin(1)], out=lacks[1:])
                        fine = lacks[inner : inner + n] == lacks[:n]
                    place = np.flatnonzero(fine)
                    if not len(place):
                        continue
                    found = np.zeros(n, bool)
                    for s in spans[d].as_py() or ():
                        found[s["a"] : max(s["a"], s["b"] - least + 1)] = True
                    runs = textvec.range_hashes(hashes[a : a + n + least - 1], place, place + least)
                    out.append((runs.view(np.int64), np.full(len(place), d), place, ~found[place]))
                run, own, place, free = (np.concatenate(c) for c in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(run), ids.take(pa.array(own)), pa.array(place.astype(np.int32)), pa.array(free.astype(bool))], names=["run", "doc", "at", "open"])

    return run


def passage(x: np.ndarray, y: np.ndarray, a: list[int], b: list[int], identity: float = 0.0) -> tuple[int, int, int, int, int]:
    """The span around a chain's anchors in both stretches, and its equal words.

    Ends that would make it less alike than ``identity`` are left off.
    """
    # (word by word, Python's own numbers are read faster than an array's)
    same = K
    for a1, b1, a2, b2 in zip(a, b, a[1:], b[1:], strict=False):
        straight = a2 - a1 == b2 - b1 and a2 - a1 <= K
        same += a2 - a1 if straight else align(x[a1 + K : a2 + K].tolist(), y[b1 + K : b2 + K].tolist())
    front = _extend_from(x[: a[0]][::-1], y[: b[0]][::-1])
    back = _extend_from(x[a[-1] + K :], y[b[-1] + K :])
    none = (0, 0, 0)
    for f, g in sorted(((front, back), (front, none), (none, back), (none, none)), key=lambda e: -e[0][0] - e[1][0]):
        span = a[0] - f[0], a[-1] + K + g[0], b[0] - f[1], b[-1] + K + g[1], same + f[2] + g[2]
        if span[4] >= identity * max(span[1] - span[0], span[3] - span[2]):
            break
    return span


def _stretches(column: pa.Array) -> list[np.ndarray]:
    """The word hashes of each row of a binary column, as views of its buffer."""
    wide = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    at = np.frombuffer(column.buffers()[1], wide, column.offset + len(column) + 1)[column.offset :].tolist()
    data = column.buffers()[2]
    return [np.frombuffer(data, np.uint64, (hi - lo) // 8, lo) if hi > lo else np.zeros(0, np.uint64) for lo, hi in zip(at, at[1:], strict=False)]


def _shifted(column: pa.Array, by: np.ndarray) -> list[list[int]]:
    """The lists of a column, each less a number of its row."""
    at = column.offsets.to_numpy().astype(np.int64)
    values = (column.values.to_numpy()[at[0] : at[-1]] - np.repeat(by, np.diff(at))).tolist()
    at = (at - at[0]).tolist()
    return [values[lo:hi] for lo, hi in zip(at, at[1:], strict=False)]


def _aligned(least: int, identity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(k, ALIGN_ROWS) for b in batches for k in range(0, b.num_rows, ALIGN_ROWS)):
            out = []
            # (read from the buffers: a row as a dict of Python values costs as much as its alignment)
            doc, e_doc, aw0, bw0 = (batch.column(c).to_numpy() for c in ("doc", "e_doc", "aw0", "bw0"))
            rows = zip(doc.tolist(), e_doc.tolist(), aw0.tolist(), bw0.tolist(), _stretches(batch.column("x")), _stretches(batch.column("y")), _shifted(batch.column("a_at"), aw0), _shifted(batch.column("b_at"), bw0), strict=True)
            for d, e, at, e_at, x, y, a, b in rows:
                a0, a1, b0, b1, same = passage(x, y, a, b, identity)
                words = max(a1 - a0, b1 - b0)
                if min(a1 - a0, b1 - b0) >= least and same >= identity * words:
                    out.append((d, a0 + at, a1 + at, e, b0 + e_at, b1 + e_at, same / words))
            cols = list(zip(*out, strict=True)) if out else [[]] * 7
            kinds = (pa.int64(),) * 6 + (pa.float64(),)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["doc_id", "start_word", "end_word", "source_doc_id", "source_start", "source_end", "identity"])

    return run


def repeated_passages(docs: DataFrame, *, least_words: int = LEAST_WORDS, identity: float = IDENTITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start_word, end_word, source_doc_id, source_start, source_end, identity).

    One row per passage of at least ``least_words`` words of a document that stands in an earlier
    document too, with at least ``identity`` of its words. Words are ``[^\\x20\\x09-\\x0D]+`` with
    A-Z read as a-z; spans count words from 0. Documents with equal texts are whole passages of
    the first of them. Null, empty and short texts give no row; rows with a null id are left out;
    rows that share an id are one document whose texts are compared each (spans are of any of them).
    Extra columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "chaining")
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text")).where("doc is not null and text is not null")
    keys = rows.select("doc", F.xxhash64("text").alias("h1"), F.hash("text").alias("h2"))
    first = keys.groupBy("h1", "h2").agg(F.min("doc").alias("first"))
    # a document of several texts is none of them whole: its texts are met by their seeds
    several = keys.groupBy("doc").agg(*(f(h).alias(f"{f.__name__}_{h}") for h in ("h1", "h2") for f in (F.min, F.max))).where("min_h1 < max_h1 or min_h2 < max_h2").select("doc")
    copies = keys.join(first, ["h1", "h2"]).where("doc > first").select("doc", "first").distinct()
    copies = scratch.keep(copies.join(several, "doc", "left_anti"), "copies")

    # computed for each of the two uses: partial aggregation makes a common seed small on one side,
    # and the join may split its rows on the other
    seeds = rows.select("doc", "text").mapInArrow(textvec.frugal(_seeds), "seed long, doc long, at int")
    # the earliest document of each seed; seeds of one document alone meet nothing, and copies are
    # represented by their first document
    source = seeds.groupBy("seed").agg(F.min(F.struct("doc", "at")).alias("e"), F.max("doc").alias("last")).where("e.doc < last").select("seed", F.col("e.doc").alias("e_doc"), F.col("e.at").alias("e_at"))
    shared = seeds.join(source, "seed").select("doc", "at", "e_doc", "e_at")
    shared = scratch.keep(shared.join(copies.select("doc"), "doc", "left_anti"), "shared")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = shared.where("doc > e_doc").repartition(parts, "doc", "e_doc").sortWithinPartitions(*PAIR).select(*PAIR).mapInArrow(textvec.frugal(_chains), CHAINS)

    def window(low: str, high: str) -> tuple[Column, Column]:
        """Words around a chain, in steps of ``STEP`` so that chains at one passage share a window."""
        return (F.floor(F.greatest(F.col(low) - MARGIN, F.lit(0)) / STEP) * STEP).cast("int"), (F.ceil((F.col(high) + MARGIN) / STEP) * STEP).cast("int")

    def aligned(chains: DataFrame, name: str) -> DataFrame:
        (a0, a1), (b0, b1) = window("a0", "a1"), window("b0", "b1")
        chains = scratch.keep(chains.select("doc", "e_doc", "a_at", "b_at", a0.alias("aw0"), a1.alias("aw1"), b0.alias("bw0"), b1.alias("bw1")), f"{name}-chains")
        windows = chains.select("doc", F.struct(F.col("aw0").alias("w0"), F.col("aw1").alias("w1")).alias("w")).union(chains.select("e_doc", F.struct(F.col("bw0").alias("w0"), F.col("bw1").alias("w1")))).distinct()
        wanted = scratch.keep(windows.groupBy("doc").agg(F.collect_list("w").alias("wanted")), f"{name}-wanted")
        small = scratch.small(wanted, f"{name}-wanted")
        slices = scratch.keep(rows.join(small, "doc").select("doc", "text", "wanted").mapInArrow(textvec.frugal(_slices), "doc long, w0 int, w1 int, hashes binary"), f"{name}-slices")
        left = slices.select("doc", F.col("w0").alias("aw0"), F.col("w1").alias("aw1"), F.col("hashes").alias("x"))
        right = slices.select(F.col("doc").alias("e_doc"), F.col("w0").alias("bw0"), F.col("w1").alias("bw1"), F.col("hashes").alias("y"))
        both = chains.join(left, ["doc", "aw0", "aw1"]).join(right, ["e_doc", "bw0", "bw1"]).select("doc", "e_doc", "a_at", "b_at", "aw0", "bw0", "x", "y")
        passages = both.mapInArrow(textvec.frugal(_aligned(least_words, identity)), "doc_id long, start_word long, end_word long, source_doc_id long, source_start long, source_end long, identity double").distinct()
        passages = scratch.keep(passages, f"{name}-passages")
        scratch.drop(*(f"{name}-{t}" for t in ("chains", "wanted", "slices")))
        return passages

    passages = aligned(found, "first")
    own = shared.groupBy("doc").agg(F.collect_list("at").alias("shared")).where(F.size("shared") >= (least_words - K + 1) // WINDOW)
    spans = passages.groupBy("doc_id").agg(F.collect_set(F.struct(F.col("start_word").alias("a"), F.col("end_word").alias("b"))).alias("spans"))
    own = scratch.keep(own.join(spans, F.col("doc") == F.col("doc_id"), "left").select("doc", "shared", "spans"), "own")
    scratch.drop("shared")
    small = scratch.small(own, "own")
    # beyond that size texts are shuffled, then only those of documents in it
    named = scratch.small(scratch.keep(own.select("doc"), "own-ids", hashes=True), "own-ids")
    runs = scratch.keep(rows.join(named, "doc", "left_semi").join(small, "doc").select("doc", "text", "shared", "spans").mapInArrow(textvec.frugal(_runs(least_words)), "run long, doc long, at int, open boolean"), "runs")
    holder = runs.groupBy("run").agg(F.min(F.struct("doc", "at")).alias("e"), F.max("doc").alias("last")).where("e.doc < last").select("run", F.col("e.doc").alias("e_doc"), F.col("e.at").alias("e_at"))
    met = runs.where("open").join(holder, "run").where("doc > e_doc").select("doc", "e_doc", "at", (F.col("at") - F.col("e_at")).alias("off"))
    # runs that follow each other word by word on one diagonal are one chain
    place = F.row_number().over(Window.partitionBy("doc", "e_doc", "off").orderBy("at"))
    met = met.distinct().withColumn("island", F.col("at") - place).groupBy("doc", "e_doc", "off", "island").agg(F.min("at").alias("a0"), (F.max("at") + least_words).alias("a1"))
    b0, b1, tail = F.col("a0") - F.col("off"), F.col("a1") - F.col("off"), F.col("a1") - K
    steps = F.array_distinct(F.concat(F.sequence(F.col("a0"), F.greatest("a0", tail), F.lit(K)), F.array(F.greatest("a0", tail))))
    more = met.select("doc", "e_doc", "a0", "a1", b0.alias("b0"), b1.alias("b1"), steps.alias("a_at"), F.transform(steps, lambda p: p - F.col("off")).alias("b_at"))
    passages = passages.union(aligned(more, "more")).distinct()
    scratch.drop("own", "own-ids", "runs")
    # (a count that names both sides of the join is made after it, for the copies alone)
    words = F.when(F.col("doc") > F.col("first"), F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))).cast("long")
    whole = rows.join(scratch.small(copies, "copies"), "doc").select("doc", "first", words.alias("n")).where(F.col("n") >= least_words)
    zero = F.lit(0).cast("long")
    return passages.unionByName(whole.select(F.col("doc").alias("doc_id"), zero.alias("start_word"), F.col("n").alias("end_word"), F.col("first").alias("source_doc_id"), zero.alias("source_start"), F.col("n").alias("source_end"), F.lit(1.0).alias("identity")))
