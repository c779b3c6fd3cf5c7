"""Merkle manifest of a table: leaf digests, ordered trees per group, one root, and a proof for each row.

A leaf is the SHA-256 of a row's fields. In each group leaves are ordered by id; every three
consecutive nodes become one until one, the subroot, is left; subroots, ordered by group, make the
root likewise. Ranks come from ranges, so a group of any size is dealt over many tasks. Then
blocks of 3 ** ``steps`` consecutive nodes are arrays that collapse by higher-order functions, and
block roots are the nodes of the next round. Proofs go the other way: what stands above a block is
told once per block, not once per leaf.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.llm.scratch import Scratch

FAN = 3  # nodes that become one
STEPS = 6  # levels that a block collapses: 729 nodes, some 100 KB
SIBLINGS = "array<struct<left:string,right:string>>"


def field(value: Column) -> Column:
    """A field's part of a leaf: ``-`` for null, else the bytes of its text, ``:`` and the text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*values: Column) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


def fold(leaf: Column, siblings: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(siblings, leaf, lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]), 256))


def proof_digest(siblings: Column) -> Column:
    """Digest of the siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(siblings, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def _whole(value: Column) -> Column:
    return F.floor(value).cast("int")


def _parents(nodes: Column) -> Column:
    runs = F.sequence(F.lit(0), _whole((F.size(nodes) - 1) / FAN))
    return F.transform(runs, lambda k: F.sha2(F.array_join(F.slice(nodes, k * FAN + 1, FAN), ""), 256))


def _levels(nodes: Column, n: Column, steps: int) -> Column:
    """The levels of a block, its nodes first; a block that is not its group's only one goes through all steps."""
    rounds = F.filter(F.array(*(F.lit(FAN**k) for k in range(steps))), lambda size: size < n)
    return F.aggregate(rounds, F.array(nodes), lambda done, _: F.concat(done, F.array(_parents(F.element_at(done, -1)))))


def _siblings(levels: Column, place: Column, steps: int) -> Column:
    """The others of each run that the node at ``place`` of a block is in, from its own level up."""

    def at(level: Column) -> Column:
        nodes, k = F.element_at(levels, level + 1), _whole(place / F.pow(F.lit(FAN), level))
        own = k % FAN
        return F.struct(F.array_join(F.slice(nodes, k - own + 1, own), "").alias("left"), F.array_join(F.slice(nodes, k + 2, FAN - 1 - own), "").alias("right"))

    return F.transform(F.slice(F.sequence(F.lit(0), F.lit(steps)), F.lit(1), F.size(levels) - 1), at)


def _ranked(nodes: DataFrame, order: list[str], scratch: Scratch, name: str) -> DataFrame:
    """Adds i, each row's place (from 0) in its group g by ``order``, and n, the rows of the group.

    Rows are dealt by range, so no group meets in one task; only counts per range and group are
    summed up. Rows that ``order`` does not tell apart are spread over ranges by a salt.
    """
    spark = nodes.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    salted = nodes.withColumn("salt", F.rand(7))
    dealt = scratch.keep(salted.repartitionByRange(parts, "g", *order, "salt").withColumn("part", F.spark_partition_id()), f"{name}-ranges")
    counts = dealt.groupBy("part", "g").agg(F.count("*").alias("c"))
    upto, whole = Window.partitionBy("g").orderBy("part"), Window.partitionBy("g")
    before = scratch.keep(counts.select("part", "g", (F.sum("c").over(upto) - F.col("c")).alias("before"), F.sum("c").over(whole).alias("n")), f"{name}-before")
    within = F.row_number().over(Window.partitionBy("part", "g").orderBy(*order, "salt"))
    placed = dealt.join(scratch.small(before, f"{name}-before"), ["part", "g"])
    return placed.withColumn("i", F.col("before") + within - 1).drop("part", "salt", "before")


def _grown(nodes: DataFrame, extra: list[str], steps: int, scratch: Scratch, name: str) -> tuple[list[DataFrame], DataFrame]:
    """(block tables from the leaves up, (g, h) of each group's last node) for nodes (g, i, n, h, extra)."""
    size, tables, ends = FAN**steps, [], None
    while True:
        row = F.struct("i", "h", *(extra if not tables else []))
        blocks = nodes.groupBy("g", F.floor(F.col("i") / size).alias("b")).agg(F.max("n").alias("n"), F.sort_array(F.collect_list(row)).alias("items"))
        tables.append(scratch.keep(blocks, f"{name}-blocks-{len(tables)}"))
        last = F.element_at(F.element_at(_levels(F.col("items.h"), F.col("n"), steps), -1), 1)
        ended = tables[-1].select("g", F.col("b").alias("i"), "n", last.alias("h"))
        roots = scratch.keep(ended, f"{name}-roots-{len(tables)}").withColumn("n", F.ceil(F.col("n") / size))
        done = roots.where("n = 1").select("g", "h")
        ends = done if ends is None else ends.unionByName(done)
        nodes = roots.where("n > 1")
        if nodes.isEmpty():
            return tables, ends


def _proven(tables: list[DataFrame], above: DataFrame, steps: int, scratch: Scratch, name: str) -> DataFrame:
    """(g, item, up, known of ``above``) of every leaf; ``above`` has g, up of a group's last node, and more."""
    size, known, ups = FAN**steps, [c for c in above.columns if c not in ("g", "up")], None
    for k in reversed(range(len(tables))):
        met = tables[k].where(F.col("n") <= size).join(above, "g")
        if ups is not None:
            met = met.unionByName(tables[k].where(F.col("n") > size).join(ups, ["g", "b"]))
        levelled = met.withColumn("levels", _levels(F.col("items.h"), F.col("n"), steps))
        spread = levelled.select("g", "up", "levels", *known, F.posexplode("items").alias("place", "item"))
        own = _siblings(F.col("levels"), F.col("place"), steps)
        leaves = spread.select("g", "item", F.concat(own, "up").alias("up"), *known)
        if k == 0:
            return leaves
        ups = scratch.keep(leaves.select("g", F.col("item.i").alias("b"), "up", *known), f"{name}-ups-{k}")


def merkle_manifest(docs: DataFrame, leaf: Column, id_col: str = "doc_id", group_col: str = "source", carry: dict[str, Column] | None = None, steps: int = STEPS) -> DataFrame:
    """(id, group, leaf, siblings, subroot, root, carried columns) of every row.

    ``siblings`` has (left, right) of each run on the way from the leaf through the subroot to the
    root, where the texts are the joined digests before and after the own node; a run of one has
    two empty texts. ``fold(leaf, siblings)`` is the root.

    Rows that share an id are ordered by their leaf, so equal rows stand side by side; null ids come
    first, and null groups are a group of their own, before all others. An empty table gives no
    rows. Columns other than those that ``leaf``, ``carry``, the id and the group name are left out,
    so their names do not matter.
    """
    scratch = Scratch(docs.sparkSession, "merkle")
    carried = list(carry or {})
    group = F.coalesce(F.concat(F.lit("="), F.col(group_col).cast("string")), F.lit("-"))  # "-" sorts before "="
    rows = docs.select(group.alias("g"), leaf.alias("h"), F.struct(F.col(id_col).alias("id"), F.col(group_col).alias("group"), *(c.alias(f"c{k}") for k, c in enumerate((carry or {}).values()))).alias("row"), F.col(id_col).alias("id"))
    leaves = _ranked(rows, ["id", "h"], scratch, "leaves")
    trees, subroots = _grown(leaves, ["row"], steps, scratch, "leaves")
    ends = _ranked(subroots.select(F.lit("").alias("g"), F.col("g").alias("row"), "h"), ["row"], scratch, "groups")
    tops, root = _grown(ends, ["row"], steps, scratch, "groups")
    last = root.select("g", F.lit(None).cast(SIBLINGS).alias("up"), F.col("h").alias("root")).withColumn("up", F.coalesce("up", F.array().cast(SIBLINGS)))
    above = _proven(tops, last, steps, scratch, "groups").select(F.col("item.row").alias("g"), "up", F.col("item.h").alias("subroot"), "root")
    proven = _proven(trees, scratch.keep(above, "above"), steps, scratch, "leaves")
    told = F.col("item.row")
    return proven.select(told["id"].alias(id_col), told["group"].alias(group_col), F.col("item.h").alias("leaf"), F.col("up").alias("siblings"), "subroot", "root", *(told[f"c{k}"].alias(c) for k, c in enumerate(carried)))


def document_leaf(text: Column) -> Column:
    return leaf_digest(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text)


def tamper_report(docs: DataFrame, steps: int = STEPS) -> DataFrame:
    """Proofs of all documents, each held against its text or, for every other id, one without line feeds.

    A row is tampered with where the CRC-32 of its id is even; a null id has none and stays.
    """
    changed = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    tampered = F.when(changed & F.col("text").contains("\n"), document_leaf(F.replace("text", F.lit("\n"), F.lit(""))))
    rows = merkle_manifest(docs, document_leaf(F.col("text")), carry={"tampered": tampered}, steps=steps)
    folded = rows.withColumn("folded_root", fold(F.coalesce("tampered", "leaf"), F.col("siblings")))
    return folded.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("siblings")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
