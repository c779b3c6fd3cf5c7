"""Operator 3: document fingerprints from closed syncmers, native.

A text is a sequence of word hashes. Of each run of ``K`` words the least hash is its minimal
inner substring; the run is a closed syncmer if that stands at its first or last place. Whether a
run is chosen depends on the run alone, so a passage has the same anchors wherever it stands.
A fingerprint holds all distinct anchors of the text in order of hash, each with its first word
position: equal texts have equal fingerprints, and the share of anchors that two of them hold in the
same order tells how much of them is alike in place. ``anchors`` and ``likeness`` by themselves can
also work on a sketch, the ``KEEP`` anchors with the least hashes, which only estimates that share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K = 4  # words in an anchor
KEEP = 128  # anchors in a sketch
RANGE_ROWS = 2_000  # documents in a range of neighbours,
MOST_RANGES = 1_000  # unless that makes more ranges than this; larger ranges spill


def anchors(text: Column, k: int = K, keep: int | None = KEEP) -> Column:
    """array<struct(hash, position)> of the distinct closed syncmers of a text in order of hash, at their first places: the least ``keep``, or all (None).

    A text of fewer than ``k`` words is one anchor, an empty one has none.
    """
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return F.transform(F.array(hashes), lambda h: _chosen(h, k, keep))[0]


def _chosen(h: Column, k: int, keep: int | None) -> Column:
    n = F.size(h)

    def run(j: Column) -> Column:
        edge = F.least(h[j], h[j + (k - 1)]) <= F.least(*(h[j + i] for i in range(1, k - 1)))
        # the hash of the run mixes its words in order
        return F.when(edge, F.struct(F.xxhash64(*(h[j + i] for i in range(k))).alias("hash"), j.alias("position")))

    found = F.filter(F.transform(F.sequence(F.lit(0), n - k), run), lambda a: a.isNotNull())
    short = F.when(n > 0, F.array(F.struct(F.aggregate(h, F.lit(0).cast("long"), lambda acc, x: F.xxhash64(acc, x)).alias("hash"), F.lit(0).alias("position")))).otherwise(F.array().cast("array<struct<hash:bigint,position:int>>"))
    ordered = F.sort_array(F.when(n >= k, found).otherwise(short))
    # equal hashes stand together, the first place first
    distinct = F.transform(F.array(ordered), lambda s: F.filter(s, lambda a, i: ~a["hash"].eqNullSafe(F.get(s, i - 1)["hash"])))[0]
    return distinct if keep is None else F.slice(distinct, 1, keep)


def as_text(chosen: Column) -> Column:
    """The fingerprint: ``hash:position`` in hexadecimal, in order of hash."""
    return F.array_join(F.transform(chosen, lambda a: F.concat(F.lpad(F.lower(F.hex(a["hash"])), 16, "0"), F.lit(":"), F.lower(F.hex(a["position"])))), ",")


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once."""
    return F.transform(F.array(value), body)[0]


def _longest_rise(places: Column) -> Column:
    """Length of the longest increasing subsequence; places that rise already, as those of equal parts do, are only counted."""
    rises = F.size(F.filter(places, lambda x, i: (i > 0) & (x <= F.get(places, i - 1)))) == 0
    # the least end of a rise of each length, in order; a place ends the rise that is one longer than all that end before it,
    # and how many do is found by halving
    steps = F.filter(F.array(*(F.lit(1 << k) for k in range(30, -1, -1))), lambda step: step <= F.size(places))

    def with_place(ends: Column, x: Column, halves: Column) -> Column:
        before = F.aggregate(halves, F.lit(0), lambda n, step: F.when(F.get(ends, n + step - 1) < x, n + step).otherwise(n))
        return _let(before, lambda n: F.concat(F.slice(ends, 1, n), F.array(x), F.slice(ends, n + 2, F.size(ends))))

    ends = _let(steps, lambda halves: F.aggregate(places, F.array().cast("array<bigint>"), lambda ends, x: with_place(ends, x, halves)))
    return F.when(rises, F.size(places)).otherwise(F.size(ends))


def likeness(a: Column, b: Column, keep: int | None = KEEP) -> Column:
    """Share of the anchors of both texts (of the least ``keep`` of them, unless None) that match in place; 1 for two texts without any.

    Anchors that both hold match in place if they stand in one order in both: of those in common the
    longest run that rises in both texts counts, so moved parts do not add up. For texts that keep
    their order this is the Jaccard similarity of all anchors, or an estimate of it from the least ones.
    """
    if keep is not None:
        return _let(F.element_at(F.slice(F.sort_array(F.array_union(a["hash"], b["hash"])), 1, keep), -1), lambda last: likeness(*(F.filter(x, lambda e: e["hash"] <= last) for x in (a, b)), None)) if keep else F.lit(1.0)

    def common(met: Column) -> Column:
        both = F.size(a) + F.size(b) - F.size(met)
        rise = _let(F.transform(F.sort_array(met), lambda at: at.bitwiseAND(0x7FFFFFFF)), _longest_rise)
        return F.when(both == 0, 1.0).otherwise(rise / both)

    # two lists in order of hash are merged: an anchor of both stands beside its twin; a match is both places in one number
    of = lambda x, side: F.transform(x, lambda e: F.struct(e["hash"].alias("hash"), F.lit(side).alias("side"), e["position"].cast("long").alias("at")))
    sides = F.concat(of(a, 0), of(b, 1))
    twin = lambda s, i: F.get(s, i + 1)
    met = _let(F.sort_array(sides), lambda s: F.filter(F.transform(s, lambda e, i: F.when(e["hash"] == twin(s, i)["hash"], F.shiftleft(e["at"], 32).bitwiseOR(twin(s, i)["at"]))), lambda m: m.isNotNull()))
    return _let(met, common)


def document_fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", others: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, text, anchors) of every row, with all its anchors; a null text is empty and has none."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), *others).withColumn("anchors", anchors(F.col("text"), keep=None))


def with_next(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, next_text) where next is by descending id, and the first follows the last.

    Ids are cut into ranges of about ``RANGE_ROWS`` rows; the first rows of a range also stand,
    as guests, at the end of the range before it, so each range finds its neighbours alone.
    Rows of one id follow each other by text; null ids come last. A table of one row is followed
    by itself.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    size = rows.agg(F.count("*").alias("n")).first().n
    parts = min(MOST_RANGES, max(1, -(-size // RANGE_ROWS)))
    cuts = sorted(set(rows.stat.approxQuantile("doc_id", [k / parts for k in range(1, parts)], 0.1 / parts))) if parts > 1 else []
    # range 0 has the greatest ids; a null id is in the last range
    bounds = F.array(*(F.lit(int(c)) for c in cuts)).cast("array<bigint>")
    place = F.when(F.col("doc_id").isNull(), len(cuts)).otherwise(F.size(F.filter(bounds, lambda c: F.col("doc_id") < c)))
    heads = {r.place: r.head for r in rows.groupBy(place.alias("place")).agg(F.max("doc_id").alias("head")).collect()}  # one row per range
    if not heads:
        return rows.withColumn("next_text", F.col("text"))
    order = sorted(heads)
    before = {p: order[k - 1] for k, p in enumerate(order)}
    by_place = range(len(cuts) + 1)
    head = F.get(F.array(*(F.lit(heads.get(p)).cast("long") for p in by_place)), place)
    host = F.get(F.array(*(F.lit(before.get(p)).cast("int") for p in by_place)), place)
    guest = F.when(F.col("doc_id").eqNullSafe(head), host)
    seats = F.array_compact(F.array(F.struct(place.alias("place"), F.lit(0).alias("guest")), F.when(guest.isNotNull(), F.struct(guest.alias("place"), F.lit(1).alias("guest")))))
    seated = rows.withColumn("seat", F.explode(seats)).select("doc_id", "text", "seat.place", "seat.guest")
    w = Window.partitionBy("place").orderBy("guest", F.desc_nulls_last("doc_id"), "text")
    return seated.withColumn("next_text", F.lead("text").over(w)).where("guest = 0").drop("place", "guest")


def fingerprint_report(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text's fingerprint, that of its edited text, and their likeness.

    The edited text has its last third replaced by as much of the next document's beginning.
    All anchors of each text count. Null texts are empty; equal texts have likeness 1, texts without common anchors 0. Extra
    columns are ignored; repeated rows stay; an empty table gives an empty result.
    """
    pairs = with_next(docs, id_col=id_col, text_col=text_col).withColumn("n_chars", F.char_length("text"))
    cut = F.floor(F.col("n_chars") / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars") - cut), F.substring("next_text", F.lit(1), cut))
    read = pairs.select("doc_id", "n_chars", edited.alias("edited"), anchors(F.col("text"), keep=None).alias("own"), anchors(F.col("next_text"), keep=None).alias("next"))
    read = read.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "own", "next", anchors(F.col("edited"), keep=None).alias("changed"))
    own, changed, following = (F.col(c) for c in ("own", "changed", "next"))
    return read.select("doc_id", F.col("n_chars").cast("long").alias("n_chars"), "edited_sha256", as_text(F.col("own")).alias("fingerprint"), as_text(F.col("changed")).alias("edited_fingerprint"), likeness(own, changed, None).alias("near_edited"), likeness(own, following, None).alias("near_next"))
