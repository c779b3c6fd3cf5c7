"""Operator 8: line dedup as an exact set-similarity join, native.

A line is the set of its words. Two lines match when their Jaccard similarity is at least
``percent`` in 100; a line that matches an earlier one (by document id, then place) is removed.

1. Words are ordered by rarity: they are counted over all documents in ``BUCKETS`` hash buckets,
   and a word's key is its bucket's place by count, then the other bits of its hash. A key holds
   all 64 bits of the hash, and the table of places has one size at any input.
2. Lines with equal sets (size, hash of the ordered keys, bitmap) are one class, which stands at
   its first place. The keys are written once, as far as the prefix goes.
3. Matching sets share one of the first ``n - ceil(percent * n / 100) + 1`` words of each (prefix
   filter), and of the smaller one a word of a shorter head. Pairs that do pass the length filter, the positional filter and a bitmap: every word
   flips one bit of 64 (of 128 in long lines), so sets differ in as many words at least as bits.
   All three act inside the join, the bitmap first.
4. The last words of a prefix and of its head meet only their first holder, a common word that in each
   of ``HEADS`` shares, found by partial aggregation. So a large group of variants costs a few
   pairs a member. Of a class's partners the likest by bitmap is verified on the whole sets.
5. Classes that are not matched then meet all earlier holders of their words: where a run of common
   words begins, by a common word only if it is the first that both hold. All these pairs are verified.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.scratch import Scratch

BUCKET_BITS = 16
LEAST_WORDS = 1
HOT = 1_000  # occurrences of a word's bucket, and HOT_TIMES the mean, from which the word meets its first holder first
HOT_TIMES = 8
HEADS = 4  # first holders of a common word, of as many shares of its holders
LONG = 88  # words from which a line has the second bitmap
LAST = 2**63 - 1


def plain(text: Column) -> Column:
    """Text whose white space is spaces and line feeds: those are cut much faster than by a pattern."""
    other = F.contains(text, F.lit("\t")) | F.contains(text, F.lit("\x0b")) | F.contains(text, F.lit("\x0c")) | F.contains(text, F.lit("\r"))
    return F.when(other, F.translate(text, "\t\x0b\x0c\r", "    ")).otherwise(text)


def line_words(line: Column) -> Column:
    """Distinct word hashes of a line of ``plain`` text."""
    return F.array_remove(F.array_distinct(F.transform(F.split(line, " "), lambda w: F.xxhash64(w))), F.xxhash64(F.lit("")))


def _bitmap(keys: Column, flips: Callable[[Column], Column]) -> Column:
    """For each key ``flips`` (0 or 1) at one of 64 bits, by exclusive or."""
    return F.aggregate(keys, F.lit(0).cast("bigint"), lambda all_, k: all_.bitwiseXOR(F.call_function("shiftleft", flips(k), k.bitwiseAND(63).cast("int"))))


def private_names(columns: list[str], *names: str) -> list[str]:
    """``names``, each with so many underscores before it that no column has it."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name in taken:
            name = f"_{name}"
        out.append(name)
    return out


class _Lines:
    """The lines of ``docs``: id, th (hash of the text), text."""

    def __init__(self, docs: DataFrame, scratch: Scratch, percent: int, least_words: int, id_col: str, text_col: str):
        self.scratch, self.percent = scratch, percent
        text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
        self.texts = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("id"), F.xxhash64(text).alias("th"), text.alias("text"))
        said = plain(F.col("text"))
        buckets = 1 << BUCKET_BITS
        bucket = lambda h: F.shiftrightunsigned(h, 64 - BUCKET_BITS)
        counted = self.texts.select(F.explode(F.split(F.replace(said, F.lit("\n"), F.lit(" ")), " ")).alias("w")).groupBy(bucket(F.xxhash64("w")).cast("int").alias("b")).agg(F.count("*").alias("k"))
        dense = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("b"), F.lit(0).cast("long").alias("k")).union(counted).groupBy("b").agg(F.sum("k").alias("k"))
        # one row of as many counts as buckets, and from it a constant of the plan: of fixed size
        counts = dense.agg(F.sort_array(F.collect_list(F.struct("b", "k"))).alias("all")).select(F.col("all.k").alias("k")).first().k
        order = sorted(range(buckets), key=counts.__getitem__)
        # what turns a hash's bucket, its first bits, into the bucket's place; the other bits stay
        turns = [0] * buckets
        for place, b in enumerate(order):
            turn = b ^ (place - buckets // 2) % buckets
            turns[b] = (turn - buckets if turn >= buckets // 2 else turn) << 64 - BUCKET_BITS
        common = max(HOT, HOT_TIMES * sum(counts) // buckets)
        self.hot_from = min((sum(k < common for k in counts) - buckets // 2) << 64 - BUCKET_BITS, LAST)
        of_bucket = F.split(F.lit(",".join(map(str, turns))), ",").cast("array<bigint>")
        # (never null, and said so: arrays without nulls are sorted as primitive values)
        key = lambda h: h.bitwiseXOR(F.coalesce(F.get(of_bucket, bucket(h)), F.lit(0).cast("bigint")))

        lines = self.texts.select("id", "th", F.posexplode(F.split(said, "\n")).alias("line", "words"))
        # (steps of a lambda are called one by one, so a word is hashed once, and only distinct ones get their keys;
        # the hashes are used twice, so that they stay a column of compiled code and are not drawn into the lambda)
        hashed = lines.select("id", "th", "line", line_words(F.col("words")).alias("h"))
        keyed = hashed.select("id", "th", "line", F.size("h").alias("n"), F.sort_array(F.transform("h", key)).alias("w"))
        n = F.col("n")
        prefix = F.slice("w", F.lit(1), n - F.ceil(n * percent / 100).cast("int") + 1)
        # (sets of a size that only equal sets can match need no prefix)
        partnered = (100 - percent) * n >= percent
        placed = keyed.select("id", "th", "line", n, F.xxhash64("w").alias("c"), _bitmap(F.col("w"), lambda k: F.lit(1).cast("bigint")).alias("bits"), F.when(n >= LONG, _bitmap(F.col("w"), lambda k: F.shiftright(k, 6).bitwiseAND(1))).otherwise(0).alias("more"), F.when(partnered, prefix).alias("p"))
        # a filter on n above would compute the keys twice
        kept = scratch.keep(placed, "placed", hashes=True).where(F.col("n") >= max(least_words, 1))
        classes = kept.groupBy("c", "n", "bits", "more").agg(F.min(F.struct("id", "line", "th")).alias("first"), F.first("p").alias("p"), F.count("*").alias("k"))
        self.classes = scratch.keep(classes, "classes", hashes=True)
        # the prefixes are with the classes now
        self.lines = scratch.keep(kept.drop("p"), "lines", hashes=True)
        scratch.drop("placed")

    def entries(self, classes: DataFrame, part: str = "all", prefix: bool = False, extra: tuple[str, ...] = ()) -> DataFrame:
        """Prefix words of every class, with the class's place and what the filters need.

        ``part``: "head" has those that a set at least as large must share, "tail" the rest, "ends" the
        last word of either (with no position, so that only the other filters act).
        ``before``: the word before it. ``prefix``: each carries them all, as p. ``extra``: columns of ``classes`` to carry.
        """
        head = F.col("n") - F.ceil(2 * self.percent * F.col("n") / (100 + self.percent)).cast("int") + 1
        first = F.greatest(head, F.lit(0)) if part == "tail" else F.lit(0)
        held = {"all": F.col("p"), "head": F.slice("p", F.lit(1), head), "tail": F.slice("p", first + 1, F.size("p")), "ends": F.array_distinct(F.array(F.get("p", head - 1), F.element_at("p", -1)))}[part]
        at = F.shiftleft(F.col("n").cast("long"), 32).bitwiseOR(first)
        spread = classes.where("p is not null").select(F.posexplode(held).alias("pos", "t"), F.col("first.id").alias("id"), F.col("first.line").alias("line"), "c", at.alias("at"), "bits", "more", "n", "p", *extra)
        # (hashes first, small numbers after them: such rows compress better)
        spread = spread.select("t", "c", "bits", "id", "line", (F.col("at") if part == "ends" else F.col("at") + F.col("pos")).alias("at"), "more", F.get("p", (first + F.col("pos") - 1).cast("int")).alias("before") if part != "ends" else F.lit(None).alias("before"), *["p"] * prefix, *extra)
        # (nothing is null; said here so that joins by unlike conditions read one shuffle)
        return spread.where("t is not null and c is not null and bits is not null and id is not null and line is not null and at is not null and more is not null")

    def sides(self) -> tuple[Column, Column, Column, Column]:
        """Of entries ``x`` and ``y``: their sizes, words they differ in at least, whether they pass the length, positional and bitmap filters."""
        at = {side: F.col(f"{side}.at") for side in "xy"}
        size = {side: F.shiftright(at[side], 32) for side in "xy"}
        pos = {side: at[side].bitwiseAND(0x7FFFFFFF) for side in "xy"}
        percent, both = self.percent, size["x"] + size["y"]
        ahead = F.least(*pos.values()) + F.least(*(size[side] - pos[side] for side in "xy"))
        one, two = (F.col(f"x.{c}").bitwiseXOR(F.col(f"y.{c}")) for c in ("bits", "more"))
        # the bitmap of all words is that of either half by exclusive or: two long lines compare the halves
        differ = F.when(F.least(*size.values()) >= LONG, F.bit_count(one.bitwiseXOR(two)) + F.bit_count(two)).otherwise(F.bit_count(one))
        # (first what hardly any pair passes, and what long lines pass as well: a bitmap of all words)
        near = (100 + percent) * F.bit_count(one) <= (100 - percent) * both
        alike = near & (100 * F.least(*size.values()) >= percent * F.greatest(*size.values())) & ((100 + percent) * ahead >= percent * both) & ((100 + percent) * differ <= (100 - percent) * both)
        return size["x"], size["y"], differ, alike

    def verified(self, pairs: DataFrame, name: str) -> DataFrame:
        """(c) of the later classes of the pairs (c, e) that match, by the whole sets of just these classes."""
        scratch = self.scratch
        named = scratch.keep(pairs.select("c").union(pairs.select("e")).distinct(), f"{name}-named", hashes=True)
        wanted = self.classes.select("c", "first").join(scratch.small(named, f"{name}-named"), "c").groupBy("first.id", "first.th").agg(F.collect_set(F.struct("first.line", "c")).alias("wanted"))
        wanted = scratch.small(scratch.keep(wanted, f"{name}-wanted"), f"{name}-wanted")
        told = lambda all_: F.transform("wanted", lambda x: F.struct(x["c"].alias("c"), F.get(all_, x["line"]).alias("words")))
        # (the inner array holds the lines, so that they are cut once a text and not once a line)
        found = self.texts.join(wanted, ["id", "th"]).select(F.explode(F.flatten(F.transform(F.array(F.split(plain(F.col("text")), "\n")), told))).alias("s"))
        # rows that repeat give a set twice; one shuffle by class makes them distinct and serves both joins
        sets = found.select("s.c", line_words(F.col("s.words")).alias("w")).dropDuplicates(["c"])
        right = sets.select(F.col("c").alias("e"), F.col("w").alias("v"))
        both = F.size(F.array_intersect("w", "v"))
        matched = pairs.join(sets, "c").join(right, "e").where(100 * both >= self.percent * (F.size("w") + F.size("v") - both)).select("c").distinct()
        matched = scratch.keep(matched, name)
        scratch.drop(f"{name}-named", f"{name}-wanted")
        return matched

    def removed(self) -> DataFrame:
        """(id, th, lines): for each document with removed lines, their numbers from 0."""
        scratch = self.scratch
        place = {side: F.struct(F.col(f"{side}.id"), F.col(f"{side}.line"), F.col(f"{side}.c")) for side in "xy"}
        later = place["x"] > place["y"]
        (x_size, y_size, differ, alike), same = self.sides(), F.col("x.t") == F.col("y.t")
        c, e = F.col("x.c"), F.col("y.c")
        # the order of partners: by the share of words that differ, then by hash
        score = F.shiftleft(F.floor(1000 * differ / (x_size + y_size)).cast("long"), 44)
        pair = c.alias("c"), e.alias("e"), score.bitwiseOR(e.bitwiseAND(2**44 - 1)).alias("score")
        # (keys ascend, so the last one tells whether a class has a common word)
        hot_classes = F.element_at("p", -1) >= self.hot_from
        hot = self.entries(self.classes.where(hot_classes)).where(F.col("t") >= self.hot_from)

        # a large group of variants shares the last words of heads and prefixes but for a few members: each of its members meets a first holder
        # (dealt by word before they are grouped, so that the first holders and the join read one shuffle)
        rare = self.entries(self.classes, "ends").where(F.col("t") < self.hot_from).select("t", "c", "bits", "id", "line", "at", "more").repartition("t")

        def led(of: DataFrame, *shares: Column) -> DataFrame:
            """Pairs of each holder of a word and its first holders, one in each share."""
            firsts = of.groupBy("t", *shares).agg(F.min(F.struct("id", "line", "c", "at", "bits", "more")).alias("e")).select("t", "e.*")
            return of.alias("x").join(firsts.alias("y"), same & alike & later).select(*pair)

        led_pairs = scratch.keep(led(rare).union(led(hot, F.pmod(F.hash("c"), F.lit(HEADS)))).groupBy("c").agg(F.min_by("e", "score").alias("e")), "led-pairs")
        settled = self.verified(led_pairs, "led")
        opened = self.classes.join(scratch.small(settled.withColumn("done", F.lit(True)), "led"), "c", "left").withColumn("open", F.col("done").isNull())
        # a pair that holds the same word just before meets there, at the same distance: it counts where a run of common words begins
        opens = ~F.coalesce(F.col("x.before") == F.col("y.before"), F.lit(False))
        # two sets share a word of the smaller one's head and the larger one's prefix, sets of one size a word of both heads
        heads, tails = (self.entries(opened, part, extra=("open",)).where(F.col("t") < self.hot_from) for part in ("head", "tail"))
        # (asked in terms of both sides, a filter on one would give its heads a shuffle of their own)
        asks = F.when(later, F.col("x.open")).otherwise(F.col("y.open"))
        met = heads.alias("x").join(heads.alias("y"), same & alike & (F.col("x.id") >= F.col("y.id")) & opens & later & asks).select(*pair[:2])
        met_tail = tails.alias("x").join(heads.alias("y"), same & alike & (x_size > y_size) & opens & asks).select(F.when(later, c).otherwise(e).alias("c"), F.when(later, e).otherwise(c).alias("e"))
        # common words: a pair meets at its first common word only, before which there is none to count
        common = self.entries(self.classes.where(hot_classes), prefix=True).where(F.col("t") >= self.hot_from)
        asked_hot = scratch.keep(self.entries(opened.where("open").where(hot_classes), prefix=True).where(F.col("t") >= self.hot_from), "asked-hot")
        left = F.least(*(F.shiftright(F.col(f"{side}.at"), 32) - F.col(f"{side}.at").bitwiseAND(0x7FFFFFFF) for side in "xy"))
        enough = (100 + self.percent) * left >= self.percent * (x_size + y_size)
        first_common = F.get(F.array_intersect("x.p", "y.p"), F.lit(0)) == F.col("x.t")
        late_hot = common.alias("y").join(scratch.small(asked_hot, "asked-hot").alias("x"), same & alike & enough & later & first_common).select(*pair[:2])
        late = scratch.keep(met.union(met_tail).union(late_hot).distinct().join(led_pairs, ["c", "e"], "left_anti"), "late-pairs")
        gone = scratch.keep(settled.union(self.verified(late, "late")).distinct().withColumn("gone", F.lit(True)), "gone", hashes=True)
        judged = self.classes.join(scratch.small(gone, "gone"), "c", "left").where("gone or k > 1").select("c", "n", "bits", "more", "first", "gone")
        judged = scratch.small(scratch.keep(judged, "judged"), "judged")
        lost = self.lines.join(judged, ["c", "n", "bits", "more"]).where(F.col("gone").isNotNull() | (F.struct("id", "line", "th") > F.col("first")))
        lost = scratch.keep(lost.groupBy("id", "th").agg(F.sort_array(F.collect_set("line")).alias("lines")), "lost")
        scratch.drop("lines", "classes", "led-pairs", "led", "asked-hot", "late-pairs", "late", "gone", "judged")
        return scratch.small(lost, "lost")


def dedup_lines(docs: DataFrame, *, percent: int = 80, least_words: int = LEAST_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with removed lines taken out of the text, and the columns n_lines, removed_lines (line numbers from 0).

    Lines are cut at line feeds; those of fewer than ``least_words`` distinct words (by default
    those without words) are kept and match nothing. Null texts stay null with no line. Null ids
    come last. The texts of rows that share an id are compared line number by line number, ties by
    hash. Rows that share id and text are one document to the order: they keep the same lines.
    Extra columns stay as they are, whatever their names; only n_lines and removed_lines of
    ``docs`` give way to the operator's. An empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "lines")
    lost = _Lines(docs, scratch, percent, least_words, id_col, text_col).removed()
    id_, th, lines = private_names(docs.columns, "_id", "_th", "_lost")
    lost = lost.select(F.col("id").alias(id_), F.col("th").alias(th), F.col("lines").alias(lines))
    raw = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keyed = docs.withColumn(id_, F.coalesce(F.col(id_col).cast("long"), F.lit(LAST))).withColumn(th, F.xxhash64(raw))
    kept = F.filter(F.split(raw, "\n"), lambda line, k: ~F.array_contains(lines, k))
    text = F.when(F.col(lines).isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n"))
    count = F.when(F.col(text_col).isNull(), 0).otherwise(F.octet_length(raw) - F.octet_length(F.replace(raw, F.lit("\n"))) + 1).cast("long")
    own = [text.alias(c) if c == text_col else F.col(c) for c in docs.columns if c.lower() not in ("n_lines", "removed_lines")]
    return keyed.join(lost, [id_, th], "left").select(*own, count.alias("n_lines"), F.coalesce(lines, F.array().cast("array<int>")).alias("removed_lines"))
