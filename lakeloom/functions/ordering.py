"""Orders over whole tables: seeded ones, since rows have none in Spark, and running totals by range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.sources.shared import fresh, written
from lakeloom.vocab import RATIOS, SPLITS

PREFIX = 3  # hexadecimal digits of the key by which ranks are counted: 4,096 buckets


def order_key(id_col: str | Column, seed: int) -> Column:
    ids = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.md5(F.concat(F.lit(f"{seed}:"), ids.cast("string")))


def running(df: DataFrame, by: list[str], order: list[str], upto: str = "place", total: str | None = None, weight: str | None = None) -> DataFrame:
    """Adds ``upto``, the sum of ``weight`` (or the number of rows) in a row's group up to the row by ``order``, and the group's ``total``.

    Rows are dealt by range of (group, order), so that no group meets in one task; sums per range and
    group are added up, and rows are summed within their range. Rows that ``order`` does not tell
    apart are spread by a salt and stand in any order. Nulls are a value like others and come first.
    """
    key, own, salt, part, ahead, whole = fresh([*df.columns, upto, total or upto], "_key", "_own", "_salt", "_part", "_ahead", "_whole")
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = df.select("*", F.struct(*(by or [F.lit(0).alias("all")])).alias(key), (F.col(weight) if weight else F.lit(1)).cast("long").alias(own), F.rand(7).alias(salt))
    dealt = written(keyed.repartitionByRange(parts, key, *order, salt).withColumn(part, F.spark_partition_id()), "ranges")
    sums = dealt.groupBy(part, key).agg(F.sum(own).alias(own))
    group = Window.partitionBy(key)
    before = sums.select(part, key, (F.sum(own).over(group.orderBy(part)) - F.col(own)).alias(ahead), F.sum(own).over(group).alias(whole))
    within = F.sum(own).over(Window.partitionBy(part, key).orderBy(*order, salt).rowsBetween(Window.unboundedPreceding, 0))
    out = dealt.join(before, [part, key]).select(*df.columns, (F.col(ahead) + within).alias(upto), F.col(whole).alias(total or whole))
    return out if total else out.drop(whole)


def with_rank(df: DataFrame, id_col: str, seed: int, name: str = "rank", most: int | None = None, by: str | None = None) -> DataFrame:
    """Adds each row's place (from 1) in the order of (key, id) over the whole table, or the rows of one ``by``; with ``most``, keeps that many.

    Rows are counted by the first digits of their key, which are uniform at any size; the running
    total over those few buckets is broadcast (unless there are as many for each ``by``) and rows are
    ranked within their bucket only, and with ``most`` only in buckets that hold such places.
    """
    group = [by] if by else []
    keyed = df.withColumn("_k", order_key(id_col, seed)).withColumn("_b", F.substring("_k", 1, PREFIX))
    counts = keyed.groupBy(*group, "_b").agg(F.count("*").alias("_n"))
    before = counts.select(*group, "_b", (F.sum("_n").over(Window.partitionBy(*group).orderBy("_b")) - F.col("_n")).alias("_before"))
    if most is not None:
        before = before.where(F.col("_before") < most)
    within = F.row_number().over(Window.partitionBy(*group, "_b").orderBy("_k", id_col))
    ranked = keyed.join(before if by else F.broadcast(before), [*group, "_b"]).withColumn(name, F.col("_before") + within).drop("_k", "_b", "_before")
    return ranked if most is None else ranked.where(F.col(name) <= most)


def exact_sample(df: DataFrame, id_col: str, n: int, seed: int) -> DataFrame:
    """Exactly ``n`` rows (or all): the first in the seeded order, whose last bucket alone is cut by rank."""
    (place,) = fresh(df.columns, "_place")
    return with_rank(df, id_col, seed, place, n).drop(place)


def random_split(df: DataFrame, id_col: str, seed: int, ratios: dict[str, float] = RATIOS, name: str = "random_split") -> DataFrame:
    """Adds a split drawn row by row: exact counts, the last split takes the remainder. Needs 3 rows."""
    n = df.count()
    if n < len(SPLITS):
        raise ValueError(f"{n} row(s) cannot fill {len(SPLITS)} splits")
    first = round(n * ratios[SPLITS[0]])
    second = first + round(n * ratios[SPLITS[1]])
    place = F.when(F.col("_rank") <= first, SPLITS[0]).when(F.col("_rank") <= second, SPLITS[1]).otherwise(SPLITS[2])
    return with_rank(df, id_col, seed, "_rank").withColumn(name, place).drop("_rank")
