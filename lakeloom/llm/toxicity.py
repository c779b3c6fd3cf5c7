"""Operator 7: toxicity by a Levenshtein automaton intersected with a lexicon trie.

The lexicon is learned from labelled documents: words, and stems shared by many words, that
stand in toxic documents with many different neighbours and hardly in clean ones. The automaton
accepts all words within one edit of a lexicon word and all words that begin with a stem; it is
the deterministic product of the edit automaton and the trie, run over all words of a batch at
once. Each hit is weighed by its context: hits near to each other add up, a hit within quotation
marks counts apart. A logistic regression on those context scores gives the document's score.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeloom.llm import textvec
from lakeloom.llm.scratch import Scratch

FIT_ROWS = 8_000  # labelled documents that the lexicon and the regression are fitted on, at most
MOST_TERMS = 200  # lexicon entries
LEAST_PREFIX, LONGEST_PREFIX = 3, 14
PRECISION = 0.85  # of an entry's documents that are toxic
FUZZY_FROM = 5  # letters from which a word may hold an edit
WINDOW = 10  # words on either side of a hit
HELD_CANDIDATES = 100_000  # beginnings that a task gathers before it hands them on
_OPEN, _CLOSE, _BOTH = "«“„‹", "»”›", '"'

_LETTER, _QUOTE_OPEN, _QUOTE_CLOSE, _QUOTE = 1, 2, 4, 8
_tables: list[np.ndarray] = []


def _tables_of_points() -> tuple[np.ndarray, np.ndarray]:
    """Lower case and kind of every code point."""
    if not _tables:
        lower, kind = np.arange(0x110000, dtype=np.uint32), np.zeros(0x110000, np.uint8)
        for p in range(0x110000):
            if (c := chr(p)).isalpha():
                kind[p] = _LETTER
                low = c.lower()
                if len(low) == 1:
                    lower[p] = ord(low)
        for marks, bit in ((_OPEN, _QUOTE_OPEN), (_CLOSE, _QUOTE_CLOSE), (_BOTH, _QUOTE)):
            for c in marks:
                kind[ord(c)] = bit
        _tables.extend((lower, kind))
    return _tables[0], _tables[1]


@dataclass
class Words:
    """The letter runs of a chunk of documents, over lower-case code points."""

    points: np.ndarray
    kinds: np.ndarray
    bounds: np.ndarray  # documents' offsets in points
    starts: np.ndarray
    ends: np.ndarray
    rows: np.ndarray  # first word of each document, with a last bound

    def text(self, k: int) -> str:
        return self.points[self.starts[k] : self.ends[k]].tobytes().decode("utf-32-le")


def letter_words(data: np.ndarray, offsets: np.ndarray) -> Words:
    lower, kind = _tables_of_points()
    raw = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    bounds = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets].astype(np.int64)
    kinds = kind[raw]
    inside = np.zeros(len(raw) + 2, bool)
    inside[1:-1] = kinds == _LETTER
    start, stop = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    edges = bounds[1:-1]
    edges = edges[(edges > 0) & (edges < len(raw))]
    start[edges] = inside[1:-1][edges]
    stop[edges - 1] = inside[1:-1][edges - 1]
    starts = np.flatnonzero(start)
    return Words(lower[raw], kinds, bounds, starts, np.flatnonzero(stop) + 1, np.searchsorted(starts, bounds))


EXACT, STEM, FUZZY = 1, 2, 3


@dataclass
class Automaton:
    """Deterministic product of the trie and the automaton of one edit; state 0 is dead, 1 the start."""

    classes: dict[int, int]
    moves: np.ndarray
    accepts: np.ndarray
    lookup: np.ndarray = field(init=False)

    def __post_init__(self):
        self.lookup = np.zeros(0x110000, np.uint8)
        for point, k in self.classes.items():
            self.lookup[point] = k

    def run(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(word, kind) of all accepted words."""
        state = np.ones(len(words.starts), np.int32)
        live = np.arange(len(state))
        at = words.starts.copy()
        while len(live):
            state[live] = self.moves[state[live], self.lookup[words.points[at]]]
            keep = state[live] > 0
            live, at = live[keep], at[keep] + 1
            more = (at < words.ends[live]) & (self.accepts[state[live]] != STEM)
            live, at = live[more], at[more]
        kind = self.accepts[state]
        hit = np.flatnonzero(kind)
        return hit, kind[hit]


def build_automaton(words: list[str], stems: list[str]) -> Automaton:
    trie: list[dict[str, int]] = [{}]
    ends: dict[int, tuple[int, int]] = {}
    for term, kind in [*((w, EXACT) for w in words), *((s, STEM) for s in stems)]:
        node = 0
        for c in term:
            if c not in trie[node]:
                trie.append({})
                trie[node][c] = len(trie) - 1
            node = trie[node][c]
        ends[node] = max(ends.get(node, (0, 0)), (kind, len(term)))
    alphabet = sorted({c for node in trie for c in node})
    classes = {ord(c): k + 1 for k, c in enumerate(alphabet)}

    def closed(pairs: set[tuple[int, int]]) -> frozenset[tuple[int, int]]:
        """Adds letters of the lexicon word that are left out, within one edit."""
        best = set(pairs)
        for node, edits in pairs:
            if edits == 0:
                best.update((child, 1) for child in trie[node].values())
        return frozenset((n, e) for n, e in best if e == 0 or (n, 0) not in best)

    def accept(pairs: frozenset[tuple[int, int]]) -> int:
        found = 0
        for node, edits in pairs:
            kind, length = ends.get(node, (0, 0))
            if kind and edits == 0:
                return kind if kind == STEM else max(found, EXACT) if found != FUZZY else EXACT
            if kind == EXACT and length >= FUZZY_FROM:
                found = FUZZY
        return found

    def step(pairs: frozenset[tuple[int, int]], c: str | None) -> frozenset[tuple[int, int]]:
        out: set[tuple[int, int]] = set()
        for node, edits in pairs:
            if c is not None and c in trie[node]:
                out.add((trie[node][c], edits))
            if edits == 0:
                out.add((node, 1))  # a letter too many
                out.update((child, 1) for child in trie[node].values())  # another letter
        return closed(out)

    start = closed({(0, 0)})
    number = {frozenset(): 0, start: 1}
    moves, todo = [[0] * (len(alphabet) + 1)], [start]
    for pairs in todo:
        row = []
        for c in [None, *alphabet]:
            to = step(pairs, c)
            if to not in number:
                number[to] = len(number)
                todo.append(to)
            row.append(number[to])
        moves.append(row)
    return Automaton(classes, np.array(moves, np.int32), np.array([accept(p) for p in number], np.uint8))


_CANDIDATE = {"term": pa.string(), "near": pa.int64(), "whole": pa.bool_(), "clean": pa.int64()}


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word beginnings with the neighbours they have in toxic documents, and in how many clean ones they are."""
    bad: set[tuple[str, int, bool]] = set()
    clean: Counter[str] = Counter()

    def found() -> pa.RecordBatch:
        rows = [*((t, n, w, 0) for t, n, w in bad), *((t, None, False, n) for t, n in clean.items())]
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
        bad.clear()
        clean.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _CANDIDATE.values(), strict=True)], names=list(_CANDIDATE))

    for batch in batches:
        toxic = batch.column(1).to_pylist()
        data, offsets = textvec.string_buffers(batch.column(0))
        for first, last in textvec.chunks(offsets):
            words = letter_words(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
            for row in range(first, last):
                own = [words.text(k) for k in range(words.rows[row - first], words.rows[row - first + 1])]
                if toxic[row]:
                    for before, word in zip(["", *own], own, strict=False):
                        near = zlib.crc32(before.encode())
                        bad.update((word[:k], near, k == len(word)) for k in range(LEAST_PREFIX, min(len(word), LONGEST_PREFIX) + 1))
                else:
                    clean.update({word[:k] for word in set(own) for k in range(LEAST_PREFIX, min(len(word), LONGEST_PREFIX) + 1)})
                if len(bad) + len(clean) > HELD_CANDIDATES:
                    yield found()
    yield found()


def choose_terms(found: list[tuple[str, int, int, int]], share: float, candidates: int) -> tuple[list[str], list[str]]:
    """(words, stems) among (beginning, toxic neighbours, of them as a whole word, clean documents).

    Kept are beginnings whose toxic support is beyond chance at this number of candidates. From
    the shortest kept one, the entry is lengthened while one continuation holds all its support.
    """
    odds = np.log(1 / max(min(share, 0.5), 1e-6))
    bar = np.log(max(candidates, 2)) + 3
    good = {t: (bad, whole) for t, bad, whole, clean in found if bad >= PRECISION * (bad + clean) and bad * odds * (bad / (bad + clean)) >= bar}
    roots = [t for t in good if not any(t[:k] in good for k in range(LEAST_PREFIX, len(t)))]
    words, stems = [], []
    for root in sorted(roots, key=lambda t: (-good[t][0], t))[:MOST_TERMS]:
        term = root
        while True:
            longer = [t for t in good if len(t) == len(term) + 1 and t.startswith(term) and good[t][0] >= 0.9 * good[term][0]]
            if not longer:
                break
            term = longer[0]
        (words if good[term][1] >= 0.9 * good[term][0] else stems).append(term if good[term][1] >= 0.9 * good[term][0] else root if len(root) > 4 else term)
    return sorted(words), sorted(stems)


FEATURES = 6


def context_features(words: Words, hits: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Per document: exact, edited and quoted hits, the densest window, hits a hundred words, any hit."""
    n = len(words.bounds) - 1
    out = np.zeros((n, FEATURES))
    if not len(hits):
        return out
    row = np.searchsorted(words.rows, hits, "right") - 1
    at = words.starts[hits]
    # quotation: within a pair of marks of the hit's own line
    quote = np.concatenate([[0], np.cumsum(words.kinds == _QUOTE)])
    depth = np.concatenate([[0], np.cumsum((words.kinds == _QUOTE_OPEN).astype(np.int64) - (words.kinds == _QUOTE_CLOSE))])
    breaks = np.unique(np.concatenate([np.flatnonzero(words.points == 10) + 1, words.bounds]))
    begin = breaks[np.searchsorted(breaks, at, "right") - 1]
    end = np.append(breaks, len(words.points))[np.searchsorted(breaks, at, "right")]
    quoted = (((quote[at] - quote[begin]) % 2 == 1) & (quote[end] > quote[at])) | ((depth[at] > depth[begin]) & (depth[end] < depth[at]))
    plain = ~quoted
    for k, chosen in enumerate((plain & (kinds != FUZZY), plain & (kinds == FUZZY), quoted)):
        out[:, k] = np.bincount(row[chosen], minlength=n)
    # other hits within the window and the document
    place, owner = hits[plain], row[plain]
    low = np.maximum(np.searchsorted(place, place - WINDOW), np.searchsorted(owner, owner))
    high = np.minimum(np.searchsorted(place, place + WINDOW, "right"), np.searchsorted(owner, owner, "right"))
    np.maximum.at(out[:, 3], owner, high - low)
    total = out[:, 0] + out[:, 1]
    out[:, 4] = 100 * total / np.maximum(np.diff(words.rows), 1)
    out[:, 5] = total > 0
    out[:, :5] = np.log1p(out[:, :5])
    return out


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights, the last one constant, by Newton's method."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-3
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (p - y) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _hits(words: Words, automaton: Automaton, spared: set[str]) -> tuple[np.ndarray, np.ndarray]:
    hits, kinds = automaton.run(words)
    drop = [k for k in np.flatnonzero(kinds == FUZZY) if words.text(hits[k]) in spared]
    return np.delete(hits, drop), np.delete(kinds, drop)


def _measure(model):
    """(label, features, edited words) of each labelled document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, _, spared = model.value
        for batch in batches:
            data, offsets = textvec.string_buffers(batch.column(1))
            x, terms = [], []
            for first, last in textvec.chunks(offsets):
                words = letter_words(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
                hits, kinds = _hits(words, automaton, spared)
                x += context_features(words, hits, kinds).tolist()
                own: list[set[str]] = [set() for _ in range(last - first)]
                for h in hits[kinds == FUZZY]:
                    own[int(np.searchsorted(words.rows, h, "right")) - 1].add(words.text(h))
                terms += map(sorted, own)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.float64())), pa.array(terms, pa.list_(pa.string()))], names=["toxic", "x", "edited"])

    return run


def _score(model):
    """The scores of a column of texts."""

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        automaton, weights, spared = model.value
        for column in columns:
            data, offsets = textvec.string_buffers(column)
            scores = np.zeros(len(column))
            for first, last in textvec.chunks(offsets):
                words = letter_words(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
                x = context_features(words, *_hits(words, automaton, spared))
                scores[first:last] = 1 / (1 + np.exp(-np.clip(x @ weights[:-1] + weights[-1], -30, 30)))
            yield pa.array(scores)

    task = textvec.frugal(run)

    def scored(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return task(columns)

    return F.arrow_udf(scored, "double")


def held_out(id_col: Column) -> Column:
    return F.pmod(F.crc32(id_col.cast("string")), F.lit(5)) == 0


def toxicity_scores(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", fit_rows: int = FIT_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``, as ``scored_documents`` gives them."""
    scored = scored_documents(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), labels, fit_rows=fit_rows)
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))


def scored_documents(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", fit_rows: int = FIT_ROWS, score_col: str = "toxicity") -> DataFrame:
    """Every row of ``docs`` as it is, with ``score_col``.

    The lexicon and the regression are fitted on at most ``fit_rows`` labelled documents, the
    first by the hash of their id among those not held out; all documents are scored, over whole
    texts. Null texts are empty and get the constant's score. Null labels are left out. Without a
    usable label of either kind every score is the share of toxic labels (0 without any).
    Repeated rows and null ids are scored each; extra columns stay, but one named ``score_col`` is
    replaced; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "toxicity")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # at most fit_rows ids, so small enough to broadcast at any input size
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    sample = scratch.keep(texts.where("text is not null").join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"]).select("text", "toxic"), "sample")
    count = sample.agg(F.count("*").alias("n"), F.sum("toxic").alias("bad")).first()
    share = (count.bad or 0) / count.n if count.n else 0.0
    words, stems, weights, spared = [], [], np.zeros(FEATURES + 1), set()
    if 0 < share < 1:
        terms = scratch.keep(sample.select("text", "toxic").repartition(8).mapInArrow(textvec.frugal(_candidates), "term string, near long, whole boolean, clean long").groupBy("term").agg(F.count_distinct("near").alias("bad"), F.count_distinct(F.when(F.col("whole"), F.col("near"))).alias("whole"), F.sum("clean").alias("clean")), "terms")
        found = terms.where(f"bad >= 3 and bad >= {PRECISION} * (bad + clean)").orderBy(F.desc("bad"), "term").limit(50 * MOST_TERMS).collect()
        words, stems = choose_terms([tuple(r) for r in found], share, terms.count())
        automaton = build_automaton(words, stems)

        def measured() -> tuple[list, Counter, Counter]:
            model = spark.sparkContext.broadcast((automaton, weights, spared))
            rows = sample.select("toxic", "text").mapInArrow(textvec.frugal(_measure(model)), "toxic int, x array<double>, edited array<string>").collect()
            bad, good = (Counter(t for r in rows if r.toxic == k for t in r.edited) for k in (1, 0))
            return rows, bad, good

        _, bad, good = measured()
        spared = {t for t in good if good[t] >= max(1, bad[t] * 0.2)}  # words in their own right, one edit from an entry
        rows, _, _ = measured()
        weights = fit_logistic(np.array([r.x for r in rows]), np.array([r.toxic for r in rows], float))
    else:
        automaton = build_automaton([], [])
        weights[-1] = np.log((share + 1e-9) / (1 - share + 1e-9))
    scratch.drop("sample", "terms")
    model = spark.sparkContext.broadcast((automaton, weights, spared))
    # only the texts go to Python; the other columns stay where they are
    return docs.select(*(F.col(c) for c in docs.columns if c.lower() != score_col.lower()), _score(model)(F.col(text_col).cast("string")).alias(score_col))
