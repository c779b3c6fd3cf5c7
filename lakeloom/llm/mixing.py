"""Operator 6: mixing sources to target weights with hash-threshold histograms, native.

Sizes are summed by source and by a bucket of the document id's hash; the running sum finds the
bucket in which a source's budget ends, and only that bucket is split further, level by level.
A source's budget is then a threshold on the hash: the documents below it are taken, without a
sort. Thresholds are nested: a larger budget takes all that a smaller one takes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.llm.line_dedup import private_names
from lakeloom.llm.scratch import Scratch

WEIGHTS = (5.0, 2.0, 1.0)
LEVEL_BITS, LEVELS = 12, 5  # 60 bits of hash
WORD = r"[^\x20\x09-\x0D]+"


def shares(sizes: list[int], weights: list[float], budget: float, most: float) -> list[float]:
    """Targets by weight, none above ``most`` times its size; what is above is shared again."""
    targets, left = [0.0] * len(sizes), set(range(len(sizes)))
    while left:
        total = sum(weights[k] for k in left)
        full = {k for k in left if budget * weights[k] / total > most * sizes[k]}
        for k in full or left:
            targets[k] = most * sizes[k] if full else budget * weights[k] / total
        budget -= sum(targets[k] for k in full)
        left = left - full if full else set()
    return targets


@dataclass
class _Budget:
    source: str | None
    size: int
    target: float
    copies: int  # taken of every document
    need: float  # of the further copy
    prefix: int = 0  # hash bits above the open bucket; at the end the threshold
    extra: int = 0  # equal rows at the threshold that are taken too
    open: bool = True


def document_hash(id_col: Column, text_col: Column, seed: int) -> Column:
    """60 hash bits of an id and a text."""
    return F.shiftrightunsigned(F.xxhash64(id_col.cast("long"), text_col.cast("string"), F.lit(seed)), 64 - LEVEL_BITS * LEVELS)


def mix_sources(docs: DataFrame, *, share: float = 1.5, most: float = 2.0, weights: tuple[float, ...] = WEIGHTS, seed: int = 20, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) of every row of ``docs``; see ``mix_plan``."""
    sized, plan, scratch = mix_plan(docs, share=share, most=most, weights=weights, seed=seed, id_col=id_col, text_col=text_col, source_col=source_col)
    joined = _with_times(sized, plan, "source", "h", scratch)
    return joined.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))


def mixed_documents(docs: DataFrame, *, share: float = 1.5, most: float = 2.0, weights: tuple[float, ...] = WEIGHTS, seed: int = 20, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of ``docs`` that the mix takes, each as many times as it is taken; see ``mix_plan``."""
    _, plan, scratch = mix_plan(docs, share=share, most=most, weights=weights, seed=seed, id_col=id_col, text_col=text_col, source_col=source_col)
    names = private_names(docs.columns, *PLAN, "times", "h", "copy")
    *planned, times, h, copy = names
    hashed = docs.select(*docs.columns, document_hash(F.col(id_col), F.col(text_col), seed).alias(h))
    joined = _with_times(hashed, plan.toDF(*planned), source_col, h, scratch, names)
    return joined.withColumn(copy, F.explode(F.array_repeat(F.lit(True), F.col(times).cast("int")))).select(*docs.columns)


PLAN = ("s", "source_size", "target", "copies", "threshold", "extra")


def _with_times(rows: DataFrame, plan: DataFrame, source: str, h: str, scratch: Scratch, names: tuple[str, ...] | list[str] = (*PLAN, "times")) -> DataFrame:
    """Rows with their source's plan and how often each is taken.

    Where a budget ends among rows of one hash, that is equal ones, so many of them are taken as it
    takes; those rows alone are written and numbered, by the partition that they are in.
    """
    s, _, _, copies, threshold, extra, times = names[:7]
    joined = rows.join(F.broadcast(plan), F.col(source).cast("string").eqNullSafe(F.col(s)))
    plain = joined.withColumn(times, F.col(copies) + (F.col(h) < F.col(threshold)).cast("long"))
    if plan.where(F.col(extra) > 0).isEmpty():
        return plain
    split = (F.col(extra) > 0) & (F.col(h) == F.col(threshold))
    part, before = private_names([*plain.columns], "part", "before")
    edge = scratch.keep(plain.where(split).withColumn(part, F.spark_partition_id()), "edge")
    counts = edge.groupBy(s, part).agg(F.count("*").alias(before))
    ahead = counts.select(F.col(s).alias(f"{before}_s"), F.col(part).alias(f"{before}_part"), (F.sum(before).over(Window.partitionBy(s).orderBy(part)) - F.col(before)).alias(before))
    met = edge.join(ahead, F.col(s).eqNullSafe(F.col(f"{before}_s")) & (F.col(part) == F.col(f"{before}_part")))
    place = F.col(before) + F.row_number().over(Window.partitionBy(s, part).orderBy(h))
    numbered = met.withColumn(before, place).withColumn(times, F.col(copies) + (F.col(before) <= F.col(extra)).cast("long"))
    return plain.where(~split).unionByName(numbered.select(*plain.columns))


def mix_plan(docs: DataFrame, *, share: float, most: float, weights: tuple[float, ...], seed: int, id_col: str, text_col: str, source_col: str) -> tuple[DataFrame, DataFrame, Scratch]:
    """The documents' sizes and hashes, per source (s) its size, target, copies, threshold and extra, and their scratch tables.

    ``size`` counts words (a null text has none). Sources in code point order, null last, weigh
    ``weights`` in turn and share ``share`` times the total size; no target is above ``most``
    (a whole number) times its source's size. A source takes every document the whole number of
    times that fits its target, and once more those below its threshold; it misses its target by
    at most half of the document at the threshold. Rows are told apart by id and text, so rows that
    share an id, or have none, are taken or left each; of rows equal in both, so many are taken as
    come nearest to the target. Runs agree: how many of such rows are taken follows from ids and
    texts alone. An empty table gives an empty result; an empty source takes nothing. One row per
    source is kept on the driver.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mixing")
    sized = scratch.keep(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"), document_hash(F.col(id_col), F.col(text_col), seed).alias("h")), "sized")
    rows = sorted(sized.groupBy("source").agg(F.sum("size").alias("size")).collect(), key=lambda r: (r.source is None, r.source or ""))
    sizes = [r["size"] for r in rows]
    targets = shares(sizes, [weights[k % len(weights)] for k in range(len(rows))], share * sum(sizes), most)
    budgets = []
    for r, size, target in zip(rows, sizes, targets, strict=True):
        copies = int(target // size) if size else 0
        budgets.append(_Budget(r.source, size, target, copies, target - copies * size))
    for level in range(LEVELS):
        state = [(b.source, b.prefix, float(b.need)) for b in budgets if b.open and b.need > 0]
        if not state:
            break
        low = LEVEL_BITS * (LEVELS - 1 - level)
        known = spark.createDataFrame(state, "s string, prefix long, need double")
        within = sized.join(F.broadcast(known), F.col("source").eqNullSafe(F.col("s"))).where(F.shiftright("h", low + LEVEL_BITS) == F.col("prefix"))
        buckets = within.groupBy("s", "need", F.shiftright("h", low).alias("bucket")).agg(F.sum("size").alias("size"), F.min("h").alias("least"), F.max("h").alias("greatest"), F.count("*").alias("rows"))
        upto = F.sum("size").over(Window.partitionBy("s").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
        at = {r.s: r for r in buckets.withColumn("upto", upto).where((F.col("upto") > F.col("need")) & (F.col("upto") - F.col("size") <= F.col("need"))).collect()}
        for b in budgets:
            if not (b.open and b.need > 0):
                continue
            r = at[b.source]
            b.need -= r.upto - r["size"]
            b.prefix = r.bucket
            if r.least == r.greatest:  # a single hash is left, of rows of one size
                taken = round(b.need * r.rows / r["size"])
                b.prefix, b.extra, b.open = (r.least + 1, 0, False) if taken >= r.rows else (r.least, taken, False)
            elif b.need == 0:  # the budget ends where the bucket starts
                b.prefix, b.open = r.bucket << low, False
            elif level == LEVELS - 1:
                b.open = False
    plan = spark.createDataFrame([(b.source, b.size, float(b.target), b.copies, b.prefix if not b.open else 0, b.extra) for b in budgets], "s string, source_size long, target double, copies long, threshold long, extra long")
    return sized, plan, scratch
