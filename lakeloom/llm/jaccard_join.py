"""Operator 5: n-gram Jaccard join as a blocked sparse matrix product.

Rows of the sparse matrix are documents, columns are distinct n-grams. Two documents link when
``100 * |A & B| >= percent * |A | B|``. The product is never formed as a list of pairs:

1. Documents with equal sets are one class, so copies cost one matrix row.
2. Columns are ordered by how many classes hold them. A linked pair must share a column among
   the first ``n - ceil(percent * n / 100) + 1`` of either set in that order (the size-derived
   bound). To find those entries only the columns in the lowest part of the hash space are
   shuffled and counted, over all documents, twice as many as the prefix takes; they stand before all other columns, which only
   sets with too few low ones need. Entries that one class alone holds meet nothing and end here,
   and with them every document that has enough of them.
3. Columns with two or more classes tie their classes to the least one of them; the connected
   parts of these ties are the blocks outside of which every product is below the bound.
4. In each block (large ones are split into block pairs) overlap counts are accumulated column
   slice by column slice, pairs whose sizes cannot reach the bound are skipped, and a spanning
   forest of the linked pairs is returned, at most one edge per row and block.
5. The components of those edges are the result.

The column order only decides the work: any order gives the same links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.llm import textvec
from lakeloom.llm.graph import components
from lakeloom.llm.scratch import Scratch

COUNTED = 2  # times the prefix's share of a set: the share of the hash space whose columns are counted
PART_GRAMS = 1_000_000  # n-grams (8 MB) in one side of a block pair
WHOLE_GRAMS = 2_000_000  # a block up to this size is not split
SLICE_COLUMNS = 4096  # columns whose overlaps are accumulated at once
SEEN = 200_000  # classes a task remembers, to send copies once


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _class_of(grams: np.ndarray) -> int:
    """64 bits that equal sets share; used together with the set's size."""
    folded = grams.sum(dtype=np.uint64) ^ textvec.mix(np.bitwise_xor.reduce(textvec.mix(grams + np.uint64(0x9E3779B97F4A7C15)))[None])[0]
    return int(_signed(np.array([folded], np.uint64))[0])


def prefix_length(n: int, percent: int) -> int:
    """Entries of a set of ``n`` of which a linked set must hold at least one."""
    return n - -(-percent * n // 100) + 1


def _survey(width: int, fold: bool):
    """The set size and class of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            data, offsets = textvec.string_buffers(batch.column(1))
            n, c = np.zeros(len(ids), np.int32), np.zeros(len(ids), np.int64)
            for row, grams in textvec.document_shingles(data, offsets, width, fold):
                if len(grams):
                    n[row], c[row] = len(grams), _class_of(grams)
            yield pa.RecordBatch.from_arrays([ids, pa.array(n), pa.array(c)], names=["doc_id", "n", "c"])

    return run


def low_bound(percent: int) -> int:
    """Columns up to here are counted: so many that the rarest of a set's low ones make up its prefix."""
    return int(min(0.49, COUNTED * (100 - percent) / 100) * 2**64)


def _low_entries(width: int, fold: bool, percent: int):
    """(column, class, size) of each set's low columns, and of further ones where those are fewer than its prefix."""
    low = np.uint64(low_bound(percent))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            data, offsets = textvec.string_buffers(batch.column(0))
            columns, classes, sizes = [], [], []
            for _, grams in textvec.document_shingles(data, offsets, width, fold):
                if not len(grams) or (key := _class_of(grams)) in seen:
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(key)
                take = max(int(np.searchsorted(grams, low)), prefix_length(len(grams), percent))
                columns.append(grams[:take])
                classes.append(np.full(take, key, np.int64))
                sizes.append(np.full(take, len(grams), np.int32))
            if columns:
                yield pa.RecordBatch.from_arrays([pa.array(_signed(np.concatenate(columns))), pa.array(np.concatenate(classes)), pa.array(np.concatenate(sizes))], names=["g", "c", "n"])

    return run


def _sets(width: int, fold: bool):
    """The whole set of each candidate, as 8-byte values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = textvec.string_buffers(batch.column(0))
            out = [grams.tobytes() for _, grams in textvec.document_shingles(data, offsets, width, fold)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), *batch.columns[1:]], names=["grams", "block", "id", "parts"])

    return run


class _Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def _incidence(columns: np.ndarray, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    values = np.concatenate(sets)
    at = np.minimum(np.searchsorted(columns, values), len(columns) - 1)
    there = columns[at] == values
    return rows[there], at[there]


def _overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Overlap counts of every left with every right set, accumulated over slices of the shared columns."""
    out = np.zeros((len(left), len(right)), np.float32)
    shared = np.intersect1d(np.unique(np.concatenate(left)), np.unique(np.concatenate(right)), assume_unique=True)
    for k in range(0, len(shared), SLICE_COLUMNS):
        columns = shared[k : k + SLICE_COLUMNS]
        a, b = (np.zeros((len(side), len(columns)), np.float32) for side in (left, right))
        a[_incidence(columns, left)] = 1
        b[_incidence(columns, right)] = 1
        out += a @ b.T
    return out


def linked_forest(sets: list[np.ndarray], sides: np.ndarray, percent: int, step: int = 128) -> list[tuple[int, int]]:
    """A spanning forest of the linked pairs; with two sides only pairs across them count.

    Sets are taken in order of size, so blocks whose sizes cannot reach the bound are skipped,
    as are blocks that are connected already.
    """
    sizes = np.array([len(s) for s in sets])
    two = len(np.unique(sides)) > 1
    order = np.lexsort((np.arange(len(sets)), sizes))
    forest, edges = _Forest(len(sets)), []
    if two:
        groups = [order[sides[order] == side] for side in np.unique(sides)]
    else:
        groups = [order, order]
    cut = [[g[k : k + step] for k in range(0, len(g), step)] for g in groups]
    for i, a in enumerate(cut[0]):
        for b in cut[1] if two else cut[1][i:]:
            if 100 * sizes[a[-1]] < percent * sizes[b[0]] or 100 * sizes[b[-1]] < percent * sizes[a[0]]:
                continue
            if len({forest.find(x) for x in a} | {forest.find(x) for x in b}) == 1:
                continue
            both = _overlaps([sets[x] for x in a], [sets[x] for x in b])
            union = sizes[a][:, None] + sizes[b][None, :] - both
            for x, y in np.argwhere(100 * both >= percent * union):
                if a[x] != b[y] and forest.join(int(a[x]), int(b[y])):
                    edges.append((int(a[x]), int(b[y])))
    return edges


def _product(percent: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        ids = table["id"].to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in table["grams"].to_pylist()]
        edges = linked_forest(sets, table["part"].to_numpy(), percent)
        left, right = np.array(edges, np.int64).reshape(-1, 2).T
        return pa.table({"u": ids[left], "v": ids[right]})

    return run


def jaccard_components(docs: DataFrame, *, width: int = 5, percent: int = 80, fold: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs``.

    ``component_id`` is the least id reachable by links. Null or word-free texts have an empty
    set, link with nothing and are their own component. Texts of fewer than ``width`` words are
    one n-gram. Repeated rows each yield a row; rows that share an id but not their text are one
    vertex of the graph. A null id takes the component of its set's class, if that has an id.
    Extra columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "jaccard")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    survey = scratch.keep(docs.mapInArrow(textvec.frugal(_survey(width, fold)), "doc_id long, n int, c long"), "survey")
    classes = scratch.keep(survey.where("n > 0 and doc_id is not null").groupBy("c", "n").agg(F.min("doc_id").alias("id")), "classes")
    low = docs.select("text").mapInArrow(textvec.frugal(_low_entries(width, fold, percent)), "g long, c long, n int").repartition("g").distinct()
    held = low.withColumn("df", F.count("*").over(Window.partitionBy("g")))
    # unsigned order of the column: low ones (never negative) come before further ones
    late = (F.col("g") < 0) | (F.col("g") >= low_bound(percent))
    met = F.when(F.col("df") > 1, F.struct(late.alias("late"), F.when(late, 0).otherwise(F.col("df")).alias("df"), F.col("g")))
    alone = F.count_if((F.col("df") == 1) & ~late)
    per_class = held.groupBy("c", "n").agg(alone.alias("alone"), F.sort_array(F.collect_list(met)).alias("met"))
    need = F.col("n") - F.expr(f"cast(ceil({percent} * cast(n as long) / 100) as int)") + 1 - F.col("alone").cast("int")
    entries = scratch.keep(per_class.where(need > 0).select("c", "n", F.explode(F.slice("met", F.lit(1), need)).alias("m")).select("c", "n", F.col("m.g").alias("g")), "entries")
    columns = entries.groupBy("g").agg(F.min(F.struct("c", "n")).alias("low"), F.max(F.struct("c", "n")).alias("high")).where("low <> high").select("g", F.col("low.c").alias("lc"), F.col("low.n").alias("ln"))
    ties = entries.join(columns, "g").where("not (c = lc and n = ln)").select("c", "n", "lc", "ln").distinct()
    named = ties.join(classes, ["c", "n"]).select("lc", "ln", F.col("id").alias("u")).join(classes.select(F.col("c").alias("lc"), F.col("n").alias("ln"), F.col("id").alias("v")), ["lc", "ln"]).select("u", "v")
    block_of = components(named, scratch, "blocks")
    sizes = classes.groupBy(F.col("id").alias("u")).agg(F.max("n").alias("n"))
    grams = block_of.join(sizes, "u").groupBy("component").agg(F.sum("n").alias("grams"))
    parts = grams.select("component", F.when(F.col("grams") <= WHOLE_GRAMS, 1).otherwise(F.ceil(F.col("grams") / PART_GRAMS)).cast("int").alias("parts"))
    member = scratch.keep(block_of.join(parts, "component").select(F.col("u").alias("doc_id"), F.col("component").alias("block"), "parts"), "member")
    chosen = docs.join(scratch.small(member, "member"), "doc_id").select("text", "block", F.col("doc_id").alias("id"), "parts")
    sets = chosen.mapInArrow(textvec.frugal(_sets(width, fold)), "grams binary, block long, id long, parts int")
    own = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    dealt = sets.withColumn("part", own).withColumn("other", other).select("grams", "id", "part", "block", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"))
    edges = dealt.groupBy("block", "p", "q").applyInArrow(_product(percent), "u long, v long")
    linked = components(edges, scratch, "links")
    of_class = classes.join(linked.withColumnRenamed("u", "id"), "id", "left").select("c", "n", F.coalesce("component", "id").alias("component"))
    scratch.drop("entries", "member")
    return survey.join(of_class, ["c", "n"], "left").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"))
