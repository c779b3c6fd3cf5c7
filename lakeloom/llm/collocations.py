"""Phrase collocations, mined level by level: a phrase is counted only where both phrases one word shorter are frequent.

Level tables (lang, phrase, f) hold every frequent phrase of 1 to ``longest`` words with its exact
count. While they fit ``MOST_BYTES`` they are broadcast and counted in NumPy: texts are written once as
numbers of frequent words, a phrase becomes its place in the sorted level table, and a longer phrase
the pair of its two overlapping parts, so a count is over 64-bit keys that tell phrases apart exactly.
Each task adds up its keys before they are shuffled. Beyond that size the same level is counted by joins with the level
table. Phrases are then cut and scored from the level tables alone.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.llm.scratch import Scratch
from lakeloom.llm.textvec import frugal

LONGEST = 5  # words
LEAST = 100  # occurrences
TOP = 2_000
MOST_BYTES = 16 << 20  # of all level tables that a task holds
CHUNK = 2 << 20  # bytes of text that are split at a time
SLICE = 500  # rows of a batch that are Python objects at a time
HELD = 1 << 19  # distinct keys that a task holds before it hands them on
SALTS = 32

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ENDS = b".,;:!?\n\x0b\x0c\r"  # of pieces
BREAK = ENDS[:1]
_PLAIN = bytes.maketrans(ENDS + b"\t", BREAK * len(ENDS) + b" ")


def _retyped(array: pa.Array, kind: pa.DataType) -> pa.Array:
    """The same bytes as string or binary; nothing is checked, so any bytes pass."""
    return pa.Array.from_buffers(kind, len(array), array.buffers(), offset=array.offset)


def _words(parts: list[bytes]) -> pa.Array:
    """Words of plain text in order, with ``BREAK`` between pieces."""
    whole = b"".join(parts).replace(BREAK, b" " + BREAK + b" ").strip(b" ")
    one = pa.Array.from_buffers(pa.string(), 1, [None, pa.py_buffer(np.array([0, len(whole)], np.int32)), pa.py_buffer(whole)])
    words = pc.ascii_split_whitespace(one).flatten()
    return words if whole else words[:0]


def _chunks(texts: Iterable[bytes], carry: int) -> Iterator[tuple[int, pa.Array]]:
    """(carried, words) of all texts, some ``CHUNK`` bytes at a time.

    Where a text is cut, between two words, the last ``carry`` of them stand again before the next
    chunk, as ``carried`` says; so each run of carry + 1 words is in exactly one chunk.
    """
    parts: list[bytes] = []
    size = carried = 0
    for text in texts:
        plain = text.lower().translate(_PLAIN)
        at = 0
        while at < len(plain):
            end = len(plain)
            if size + end - at > CHUNK:
                found = (plain.find(x, at + max(CHUNK - size, 0)) for x in (b" ", BREAK))
                end = min(x if x >= 0 else end for x in found)
            parts.append(plain[at:end])
            size, at = size + end - at, end
            if size >= CHUNK:
                words = _words(parts)
                yield carried, words
                tail = _retyped(words[max(len(words) - carry, 0) :], pa.binary()).to_pylist() if at < len(plain) else []
                parts, size, carried = [w + b" " for w in tail], 0, len(tail)
        parts.append(BREAK)
    if parts:
        yield carried, _words(parts)


def _by_lang(batches: Iterable[pa.RecordBatch], carry: int) -> Iterator[tuple[str, int, pa.Array]]:
    for batch in (whole.slice(k, SLICE) for whole in batches for k in range(0, whole.num_rows, SLICE)):
        texts = defaultdict(list)
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            texts[lang].append(text)
        for lang, mine in texts.items():
            for carried, words in _chunks(mine, carry):
                yield lang, carried, words


class Sums:
    """Counts per language and key, added up in a bounded number of rows; ``full`` and ``told`` hand them on."""

    def __init__(self):
        self.found: dict[str, list[pa.Table]] = defaultdict(list)
        self.rows = 0

    def add(self, lang: str, keys: pa.Array, counts: pa.Array) -> None:
        self.found[lang].append(pa.table([keys, counts], ["key", "c"]))
        self.rows += len(keys)

    def _merged(self) -> dict[str, pa.Table]:
        return {lang: pa.concat_tables(parts).group_by("key", use_threads=False).aggregate([("c", "sum")]) for lang, parts in self.found.items()}

    def full(self) -> Iterator[pa.RecordBatch]:
        """Hands the sums on if they are too many."""
        if self.rows > 2 * HELD:
            merged = self._merged()
            self.found = defaultdict(list, {lang: [t.rename_columns(["key", "c"])] for lang, t in merged.items()})
            self.rows = sum(t.num_rows for t in merged.values())
            if self.rows > HELD:
                yield from self.told()

    def told(self) -> Iterator[pa.RecordBatch]:
        for lang, table in self._merged().items():
            keys, counts = (table.column(k).combine_chunks() for k in (0, 1))
            keys = _retyped(keys, pa.binary()) if keys.type == pa.string() else keys
            yield pa.record_batch([pa.array([lang] * len(keys), pa.string()), keys, counts], ["lang", "key", "c"])
        self.found.clear()
        self.rows = 0


def _count_words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, key, c) of single words."""
    sums = Sums()
    for lang, _, words in _by_lang(batches, 0):
        counts = pc.value_counts(words)
        word = pc.and_(pc.not_equal(counts.field(0), BREAK.decode()), pc.not_equal(counts.field(0), ""))
        sums.add(lang, counts.field(0).filter(word), counts.field(1).filter(word))
        yield from sums.full()
    yield from sums.told()


class Lexicon:
    """The frequent phrases of one language: words by number, and per longer level sorted keys of part pairs."""

    def __init__(self, levels: list[list[bytes]]):
        self.words = sorted(levels[0])
        self.listed = _retyped(pa.array(self.words, pa.binary()), pa.string())
        self.keys: list[np.ndarray] = []  # of levels 2, 3, ...
        number = {w: k for k, w in enumerate(self.words)}
        for phrases in levels[1:]:
            words = np.array([[number[w] for w in p.split(b" ")] for p in phrases], np.int64).reshape(len(phrases), len(self.keys) + 2)
            self.keys.append(np.sort(self._place(words[:, :-1]) * self.size(len(self.keys) + 1) + self._place(words[:, 1:])))

    def size(self, level: int) -> int:
        return len(self.words) if level == 1 else len(self.keys[level - 2])

    def _place(self, words: np.ndarray) -> np.ndarray:
        """Places of known phrases, given as rows of word numbers, in their level."""
        grams = [words[:, k] for k in range(words.shape[1])]
        for level in range(2, words.shape[1] + 1):
            grams = [np.searchsorted(self.keys[level - 2], a * self.size(level - 1) + b) for a, b in zip(grams, grams[1:], strict=False)]
        return grams[0]

    def numbers(self, words: pa.Array) -> np.ndarray:
        """Numbers of words, -1 for others."""
        return pc.index_in(words, value_set=self.listed).fill_null(-1).to_numpy(zero_copy_only=False)

    def pairs(self, words: np.ndarray) -> np.ndarray:
        """Keys of the phrases one word longer than the last level whose two parts both are in it; ``words`` has -1 for others."""
        at = np.flatnonzero(words >= 0)
        grams = words[at].astype(np.int64)
        for level in range(1, len(self.keys) + 2):
            next_to = np.flatnonzero(np.diff(at) == 1)
            keys = grams[next_to] * self.size(level) + grams[next_to + 1]
            if level > len(self.keys):
                return keys
            table = self.keys[level - 1]
            places = np.searchsorted(table, keys)
            known = np.flatnonzero(table[np.minimum(places, len(table) - 1)] == keys) if len(table) else np.empty(0, np.int64)
            at, grams = at[next_to[known]], places[known]
        raise AssertionError

    def phrases(self, keys: np.ndarray) -> list[bytes]:
        """Phrases of such keys."""

        def spelled(places: np.ndarray, level: int) -> list[np.ndarray]:
            if level == 1:
                return [places]
            a, b = np.divmod(self.keys[level - 2][places], self.size(level - 1))
            return [*spelled(a, level - 1), spelled(b, level - 1)[-1]]

        top = len(self.keys) + 1
        a, b = np.divmod(keys, self.size(top))
        columns = [*spelled(a, top), spelled(b, top)[-1]]
        return [b" ".join(self.words[k] for k in row) for row in zip(*(c.tolist() for c in columns), strict=True)]


_KNOWN: dict[str, dict[str, Lexicon]] = {}  # of this worker, by name of the broadcast


def _lexicons(name: str, levels) -> dict[str, Lexicon]:
    if name not in _KNOWN:
        _KNOWN.clear()
        by_lang: dict[str, list[list[bytes]]] = defaultdict(lambda: [[] for _ in levels.value])
        for k, table in enumerate(levels.value):
            for lang, phrases in table.items():
                by_lang[lang][k] = phrases.split(b"\n")
        _KNOWN[name] = {lang: Lexicon(mine) for lang, mine in by_lang.items()}
    return _KNOWN[name]


def _encoder(name: str, levels, carry: int):
    """(lang, carried, numbers) of each chunk of text: its words' numbers, runs of other words told as one -1."""

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _lexicons(name, levels)
        for lang, carried, words in _by_lang(batches, carry):
            if lang not in known:
                continue
            numbers = known[lang].numbers(words).astype(np.int32)
            told = numbers >= 0
            told[1:] |= numbers[:-1] >= 0
            told[: carried + 1] = True
            yield pa.record_batch([pa.array([lang]), pa.array([carried], pa.int32()), pa.array([numbers[told].tobytes()], pa.binary())], ["lang", "carried", "numbers"])

    return encode


def _counter(name: str, levels, k: int):
    """(lang, key, c) of phrases of ``k`` words whose parts are frequent, over chunks of word numbers."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, sums = _lexicons(name, levels), Sums()
        for batch in batches:
            for lang, carried, numbers in zip(*(batch.column(x).to_pylist() for x in range(3)), strict=True):
                keys, counts = np.unique(known[lang].pairs(np.frombuffer(numbers, np.int32)[max(carried - (k - 1), 0) :]), return_counts=True)
                sums.add(lang, pa.array(keys, pa.int64()), pa.array(counts, pa.int64()))
                yield from sums.full()
        yield from sums.told()

    return count


def _speller(name: str, levels):
    """(lang, phrase, f) of counted keys."""

    def spell(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _lexicons(name, levels)
        for batch in batches:
            langs, keys, counts = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            for lang in set(langs.tolist()):
                mine = np.flatnonzero(langs == lang)
                yield pa.record_batch([pa.array([lang] * len(mine), pa.string()), pa.array(known[lang].phrases(keys[mine]), pa.binary()), pa.array(counts[mine], pa.int64())], ["lang", "phrase", "f"])

    return spell


def _frequent(counted: DataFrame, least: int) -> DataFrame:
    return counted.groupBy("lang", "phrase").agg(F.sum("c").alias("f")).where(F.col("f") >= least)


def _joined(texts: DataFrame, before: DataFrame, k: int, least: int) -> DataFrame:
    """The level of ``k`` words by joins with the level before, for level tables of any size."""
    said = F.translate(F.col("text").cast("string"), UPPER, LOWER)
    pieces = texts.select("lang", F.explode(F.split(said, r"[.,;:!?\x0A-\x0D]")).alias("piece"))
    words = pieces.select("lang", F.filter(F.split("piece", r"[\x20\x09]"), lambda w: w != "").alias("w")).where(F.size("w") >= k)
    starts = words.select("lang", "w", F.explode(F.sequence(F.lit(1), F.size("w") - (k - 1))).alias("i"))
    said_as = lambda first, n: F.array_join(F.slice("w", F.col("i") + first, F.lit(n)), " ")
    runs = starts.select("lang", said_as(0, k).cast("binary").alias("phrase"), said_as(0, k - 1).alias("a"), said_as(1, k - 1).alias("b"))
    counted = runs.groupBy("lang", "phrase", "a", "b").agg(F.count("*").alias("c"))
    for part in ("a", "b"):
        counted = counted.join(before.select("lang", F.col("phrase").alias(part)), ["lang", part], "left_semi")
    return _frequent(counted, least)


def _told(level: DataFrame) -> dict[str, bytes]:
    """A level table for the broadcast, its size checked by the caller: phrases of each language, a line each."""
    out: dict[str, list[bytes]] = defaultdict(list)
    for batch in level.select("lang", F.col("phrase").cast("binary")).toArrow().to_batches():
        for lang, phrase in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            out[lang].append(phrase)
    return {lang: b"\n".join(mine) for lang, mine in out.items()}


def phrase_levels(texts: DataFrame, scratch: Scratch, longest: int = LONGEST, least: int = LEAST, most_bytes: int = MOST_BYTES) -> tuple[list[DataFrame], DataFrame]:
    """(level tables of (lang, phrase, f), (lang, n)) of (lang, text): frequent phrases, and how many words there are."""
    spark = texts.sparkSession
    texts = texts.select("lang", F.col("text").cast("binary").alias("text"))
    as_text = lambda df: df.withColumn("phrase", F.col("phrase").cast("string"))
    words = texts.mapInArrow(frugal(_count_words), "lang string, key binary, c long")
    all_words = F.when(F.col("f") < least, None).otherwise(F.col("phrase"))  # rare ones go on as one sum
    counted = words.groupBy("lang", F.col("key").alias("phrase")).agg(F.sum("c").alias("f")).groupBy("lang", all_words.alias("phrase")).agg(F.sum("f").alias("f"))
    first = scratch.keep(as_text(counted), "level-1")
    totals = first.groupBy("lang").agg(F.sum("f").alias("n"))
    levels, told, held, encoded = [first.where("phrase is not null")], [], 0, None
    for k in range(2, longest + 1):
        size = levels[-1].agg(F.coalesce(F.sum(F.octet_length("phrase") + 16), F.lit(0))).first()[0]
        held += size
        if not size:
            break
        if held <= most_bytes:
            told.append(_told(levels[-1]))
            shared = spark.sparkContext.broadcast(told)
            name = f"{scratch.root}/{k}"
            if encoded is None:
                encoded = scratch.keep(texts.mapInArrow(frugal(_encoder(name, shared, longest - 1)), "lang string, carried int, numbers binary"), "numbers", hashes=True)
            counted = encoded.mapInArrow(frugal(_counter(name, shared, k)), "lang string, key long, c long").groupBy("lang", "key").agg(F.sum("c").alias("f")).where(F.col("f") >= least)
            level = counted.mapInArrow(frugal(_speller(name, shared)), "lang string, phrase binary, f long")
        else:
            level = _joined(texts, levels[-1], k, least)
        levels.append(scratch.keep(as_text(level), f"level-{k}"))
    return levels, totals


def _cut(words: Column, first: Column | int, n: Column | int) -> Column:
    return F.array_join(F.slice(words, first, n), " ")


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, top: int = TOP, held_percent: int = 100, lang_col: str = "lang", text_col: str = "text", most_bytes: int = MOST_BYTES) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of each language by score, a, phrase.

    Words are runs without blanks and tabs in pieces between ``.,;:!?`` and line ends, A-Z lower-cased.
    Candidates are phrases of 2 to ``longest`` words that occur ``least`` times. The score is
    floor(1000 a n / (l r)) of the cut into two parts (which occur l and r times) where it is least,
    the first such cut on a tie. A candidate goes if a longer one holds its words and occurs at least
    ``held_percent`` percent as often; as each phrase between the two is as frequent as the longer,
    those one word longer tell.

    Null texts are empty, a null language is ``und``. Rows are not told apart, so repeated rows and
    ids count each. A table without words gives no rows. Other columns are left out.
    """
    scratch = Scratch(docs.sparkSession, "collocations")
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    levels, totals = phrase_levels(texts, scratch, longest, least, most_bytes)
    known = levels[0]
    for level in levels[1:]:
        known = known.unionByName(level)
    split = known.withColumn("w", F.split("phrase", " ")).where(F.size("w") > 1)
    cuts = split.select("lang", "phrase", "w", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("cut"))
    parts = cuts.select("lang", "phrase", "a", "cut", _cut(F.col("w"), F.lit(1), F.col("cut")).alias("left"), _cut(F.col("w"), F.col("cut") + 1, F.size("w") - F.col("cut")).alias("right"))
    for side, count in (("left", "l"), ("right", "r")):
        parts = parts.join(known.select("lang", F.col("phrase").alias(side), F.col("f").alias(count)), ["lang", side])
    wide = lambda c: F.col(c).cast("decimal(18,0)")
    scored = parts.join(totals, "lang").withColumn("over", wide("a") * wide("n") * F.lit(1000).cast("decimal(4,0)")).withColumn("under", wide("l") * wide("r"))
    lowest = scored.withColumn("score", F.expr("over div under")).groupBy("lang", "phrase").agg(F.max("a").alias("a"), F.max("n").alias("n"), F.min(F.struct("score", "cut", "l", "r")).alias("low"))
    inside = split.select("lang", F.col("f"), F.explode(F.array(_cut(F.col("w"), F.lit(1), F.size("w") - 1), _cut(F.col("w"), F.lit(2), F.size("w") - 1))).alias("phrase")).groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    left = lowest.join(inside, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("longer") < held_percent * F.col("a"), F.lit(True)))
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    flat = left.select("lang", "phrase", "a", "low.l", "low.r", "n", "low.score", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).alias("salt"))
    ahead = flat.withColumn("place", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*best))).where(F.col("place") <= top)
    ranked = ahead.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
