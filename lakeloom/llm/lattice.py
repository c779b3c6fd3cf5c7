"""Operator 9: embedding near-duplicates by E8 lattice hashing.

Each table projects the unit vectors to ``BLOCKS`` times eight Gaussian directions and decodes
every eight coordinates to the nearest point of the E8 lattice; the points are the cell. A vector
is kept in its cell and also visits the cells that its second-nearest points name. Cosine in
double precision decides every pair that meets. A pair that meets in several cells is counted in
the first of them only, so no list of pairs is made: a cell returns link counts and a spanning
forest. Large cells are cut into blocks, and pairs of blocks are tasks of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.llm import textvec
from lakeloom.llm.graph import components
from lakeloom.llm.scratch import Scratch

TABLES = 5
BLOCKS = 1  # E8 points that make up a cell; two keep cells small for some 10**8 vectors and more
PROBES = 20  # neighbouring cells that a vector visits in each table
SCALE = 4.0  # lattice units per unit of the projected, variance-keeping space
BLOCK_ROWS = 1024  # rows of one side of a task in a large cell


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """Nearest E8 points, doubled to be integers: the better of D8 and D8 shifted by a half."""

    def nearest_d8(y: np.ndarray) -> np.ndarray:
        r = np.rint(y)
        odd = np.flatnonzero(r.sum(1).astype(np.int64) & 1)
        off = y[odd] - r[odd]
        worst = np.abs(off).argmax(1)
        at = np.arange(len(odd))
        r[odd, worst] += np.where(off[at, worst] >= 0, 1, -1)
        return r

    whole, half = nearest_d8(x), nearest_d8(x - 0.5) + 0.5
    better = ((x - half) ** 2).sum(1) < ((x - whole) ** 2).sum(1)
    return np.rint(2 * np.where(better[:, None], half, whole)).astype(np.int64)


def shortest_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8, doubled."""
    out = []
    for a in range(8):
        for b in range(a):
            for s in (2, -2):
                for t in (2, -2):
                    v = np.zeros(8, np.int64)
                    v[a], v[b] = s, t
                    out.append(v)
    for signs in range(256):
        v = np.array([-1 if signs >> k & 1 else 1 for k in range(8)], np.int64)
        if (v < 0).sum() % 2 == 0:
            out.append(v)
    return np.array(out)


def _cell_hash(points: np.ndarray, table: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        factors = textvec.mix(np.arange(1, points.shape[1] + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        return textvec.mix((points.astype(np.uint64) * factors).sum(1, dtype=np.uint64) + np.uint64(table)).view(np.int64)


def cells(vectors: np.ndarray, seed: int, tables: int, probes: int, scale: float) -> np.ndarray:
    """(rows, tables, 1 + probes) cell ids: the own cell, then the neighbours nearest to the vector."""
    dim = vectors.shape[1]
    short = shortest_vectors()
    out = np.empty((len(vectors), tables, 1 + probes), np.int64)
    for t in range(tables):
        directions = np.random.Generator(np.random.PCG64([seed, t, dim])).standard_normal((dim, 8 * BLOCKS))
        projected = vectors @ directions / np.sqrt(8.0) * scale
        points = np.concatenate([nearest_e8(projected[:, 8 * b : 8 * b + 8]) for b in range(BLOCKS)], axis=1)
        out[:, t, 0] = _cell_hash(points, t)
        # moving by a shortest vector v changes the squared distance by |v|^2 - 2 v.(x - point)
        rest = projected - points / 2
        gain = np.concatenate([rest[:, 8 * b : 8 * b + 8] @ (short.T / 2) for b in range(BLOCKS)], axis=1)
        best = np.argsort(-gain, axis=1, kind="stable")[:, :probes]
        for k in range(probes):
            moved = points.copy()
            for b in range(BLOCKS):
                own = best[:, k] // len(short) == b
                moved[own, 8 * b : 8 * b + 8] += short[best[own, k] % len(short)]
            out[:, t, 1 + k] = _cell_hash(moved, t)
    return out


def unit_rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rows that can link, and their unit vectors in double precision; a batch of the most common length."""
    lists = column.to_pylist()
    good, rows = [], []
    for k, v in enumerate(lists):
        if v and None not in v:
            x = np.array(v, np.float64)
            top = np.abs(x).max()
            if np.isfinite(x).all() and top > 0:
                x = x / top  # no overflow or underflow in the norm
                good.append(k)
                rows.append(x / np.sqrt(x @ x))
    return np.array(good, np.int64), rows


def _prepare(seed: int, tables: int, probes: int, scale: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good, rows = unit_rows(batch.column(1))
            ids, members = (batch.column(k).take(pa.array(good)) for k in (0, 2))
            sizes = np.array([len(r) for r in rows])
            for dim in np.unique(sizes):
                own = np.flatnonzero(sizes == dim)
                vectors = np.stack([rows[k] for k in own])
                found = cells(vectors, seed, tables, probes, scale)
                at = pa.array(own)
                yield pa.RecordBatch.from_arrays([ids.take(at), members.take(at), pa.array([v.tobytes() for v in vectors], pa.binary()), pa.array(found.reshape(len(own), -1).tolist(), pa.list_(pa.int64()))], names=["id", "members", "vector", "cells"])

    return run


def _meeting(seed: int, tables: int, probes: int, scale: float, threshold: float):
    """Counts and forest edges of one cell (or of a pair of its blocks)."""

    def owner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The cell in which each pair counts: in the first table where it meets, the lesser cell."""
        none = np.iinfo(np.int64).max
        out = np.full(len(a), none)
        for t in range(tables):
            ab = np.where((b[:, t, :1] == a[:, t]).any(1), b[:, t, 0], none)  # a is in or visits b's cell
            ba = np.where((a[:, t, :1] == b[:, t]).any(1), a[:, t, 0], none)
            out = np.where(out == none, np.minimum(ab, ba), out)
        return out

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        cell = key[0].as_py()
        ids = table["id"].to_numpy()
        home = table["home"].to_numpy(zero_copy_only=False)
        side = table["side"].to_numpy()
        n = len(ids)
        vectors = np.frombuffer(b"".join(table["vector"].to_pylist()), np.float64).reshape(n, -1)
        members = table["members"].to_numpy()
        every = np.zeros((n, tables, 1 + probes), np.int64)  # filled for rows that link
        filled = np.zeros(n, bool)
        links = np.zeros(n, np.int64)
        label = np.arange(n)
        two = len(np.unique(side)) > 1
        a_rows = np.flatnonzero(home)
        edges_a, edges_b = [], []
        for k in range(0, len(a_rows), 256):
            a = a_rows[k : k + 256]
            close = vectors[a] @ vectors.T >= threshold
            close &= ~home[None, :] | (np.arange(n)[None, :] > a[:, None])  # each pair once; visitors meet residents only
            if two:
                close &= side[a][:, None] != side[None, :]
            i, j = np.nonzero(close)
            i = a[i]
            for at in range(0, len(i), 50_000):
                x, y = i[at : at + 50_000], j[at : at + 50_000]
                bare = np.unique(np.concatenate([x, y]))
                bare = bare[~filled[bare]]
                if len(bare):
                    every[bare], filled[bare] = cells(vectors[bare], seed, tables, probes, scale), True
                mine = owner(every[x], every[y]) == cell
                x, y = x[mine], y[mine]
                np.add.at(links, x, members[y])
                np.add.at(links, y, members[x])
                # an edge to the least row met keeps the component; at most a few per row remain
                low = np.minimum(label[x], label[y])
                fresh = label[x] != label[y]
                edges_a.append(x[fresh])
                edges_b.append(y[fresh])
                np.minimum.at(label, x, low)
                np.minimum.at(label, y, low)
                if sum(map(len, edges_a)) > 4 * n:
                    edges_a, edges_b = ([e] for e in _forest(np.concatenate(edges_a), np.concatenate(edges_b), n))
        u, v = _forest(np.concatenate(edges_a), np.concatenate(edges_b), n) if edges_a else (np.zeros(0, np.int64),) * 2
        counted = np.flatnonzero(links)
        return pa.table({"u": np.concatenate([ids[counted], ids[u]]), "v": pa.array(np.concatenate([ids[counted], ids[v]])), "links": np.concatenate([links[counted], np.zeros(len(u), np.int64)])})

    return run


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each vertex to the least of its component."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            moved = np.flatnonzero(label != np.arange(n))
            return moved, label[moved]
        label = new


def embedding_links(vectors: DataFrame, *, threshold: float = 0.95, tables: int = TABLES, probes: int = PROBES, scale: float = SCALE, seed: int = 9, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row.

    Vectors that are null, empty, zero or hold a null or non-finite component link with nothing,
    as do vectors of different lengths with each other. Equal unit vectors are one class: they
    link without being compared, and the class enters the tables once. Repeated rows and rows that
    share an id count as vectors of their own; a row with a null id has no link.
    Extra columns are ignored; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "lattice")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("x"))
    # copies share a class by 96 bits of the vector; partial aggregation keeps a hot one small
    classed = rows.withColumn("c1", F.xxhash64("x")).withColumn("c2", F.hash("x"))
    grouped = classed.where("vec_id is not null and x is not null").groupBy("c1", "c2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("members"), F.first("x").alias("x"))
    classes = scratch.keep(grouped.withColumn("id", F.monotonically_increasing_id()), "classes")
    prepared = scratch.keep(classes.select("id", "x", "members").mapInArrow(_prepare(seed, tables, probes, scale), "id long, members long, vector binary, cells array<long>"), "prepared")
    seats = prepared.select("id", F.posexplode("cells").alias("k", "cell")).select("id", "cell", (F.col("k") % (1 + probes) == 0).alias("home"))
    # cells with a resident and at least two vectors; all others hold no pair
    parts = F.when(F.col("rows") <= 2 * BLOCK_ROWS, 1).otherwise(F.ceil(F.col("rows") / BLOCK_ROWS)).cast("int")
    busy = seats.groupBy("cell").agg(F.count_if("home").alias("homes"), F.count("*").alias("rows")).where("homes > 0 and rows > 1").select("cell", parts.alias("parts"))
    seated = seats.join(busy, "cell").withColumn("side", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    dealt = seated.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("id", "cell", "home", "side", F.least("side", "other").alias("p"), F.greatest("side", "other").alias("q"))
    held = dealt.join(prepared.select("id", "members", "vector"), "id")
    met = scratch.keep(held.groupBy("cell", "p", "q").applyInArrow(_meeting(seed, tables, probes, scale, threshold), "u long, v long, links long"), "met")
    links = met.where("u = v").groupBy(F.col("u").alias("id")).agg(F.sum("links").alias("links"))
    joined = components(met.where("u <> v"), scratch, "links").withColumnRenamed("u", "id")
    least = joined.join(classes.select("id", "rep"), "id").groupBy("component").agg(F.min("rep").alias("least"))
    valid = prepared.select("id", F.lit(True).alias("valid"))
    info = classes.select("id", "c1", "c2", "rep", "members").join(valid, "id", "left").join(links, "id", "left").join(joined, "id", "left").join(least, "component", "left")
    info = info.select("c1", "c2", "valid", (F.coalesce("links", F.lit(0)) + F.col("members") - 1).alias("links"), F.coalesce("least", "rep").alias("component"))
    out = classed.join(info, ["c1", "c2"], "left").withColumn("links_with", F.col("valid").isNotNull() & F.col("vec_id").isNotNull())
    component = F.when(F.col("links_with"), F.col("component")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.when(F.col("links_with"), F.col("links")).otherwise(0).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))
