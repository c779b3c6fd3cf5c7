"""Connected components over an edge table, by alternating star contractions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.scratch import Scratch


ONE_TASK_EDGES = 500_000  # a table of no more edges (8 MB, checked) is contracted in one task


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vertex, least vertex of its component) over the edges of one task."""
    parts = [np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()]) for b in batches if len(b)]
    if not parts:
        return
    vertices, at = np.unique(np.concatenate(parts, axis=1), return_inverse=True)
    left, right = at.reshape(2, -1)
    label = np.arange(len(vertices))
    while True:
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, label[left], low)
        np.minimum.at(new, label[right], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    yield pa.RecordBatch.from_arrays([pa.array(vertices), pa.array(vertices[label])], names=["u", "component"])


def _large_star(edges: DataFrame) -> DataFrame:
    """Each vertex hands its larger neighbours to the least of itself and its neighbours."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each vertex hands itself and its smaller neighbours to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(edges: DataFrame, scratch: Scratch, name: str, u: str = "u", v: str = "v") -> DataFrame:
    """(u, component) of every vertex with an edge; ``component`` is the least vertex reachable.

    A table of at most ``ONE_TASK_EDGES`` edges is contracted by one task; a larger one by stars,
    with the same result. Rounds grow with the logarithm of the longest path. Each round is written to the shared
    folder, joins and groups on vertices only, and never lists the pairs within a component.
    Edges from a vertex to itself and repeated edges change nothing; an empty table gives none.
    """
    now = scratch.keep(edges.select(F.col(u).alias("u"), F.col(v).alias("v")).where("u <> v").distinct(), f"{name}-0")
    if now.count() <= ONE_TASK_EDGES:
        return scratch.keep(now.coalesce(1).mapInArrow(_contract, "u long, component long"), f"{name}-done")
    step = 0
    while True:
        step += 1
        star = scratch.keep(_small_star(_large_star(now)), f"{name}-{step}")
        # a forest of stars is reached when no centre is itself attached to another vertex
        settled = star.select("v").distinct().join(star.select(F.col("u").alias("v")), "v", "left_semi").isEmpty() and star.groupBy("u").count().where("count > 1").isEmpty()
        scratch.drop(f"{name}-{step - 1}")
        now = star
        if settled:
            break
    return now.select("u", F.col("v").alias("component")).union(now.select(F.col("v").alias("u"), F.col("v").alias("component")).distinct())
