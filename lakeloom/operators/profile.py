"""Profiles of submissions: chains, sizes, nulls, concentration, provenance."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.operators.labeling import percent
from lakeloom.operators.quantiles import counted_values, order_statistics, quantiles
from lakeloom.sources.shared import written
from lakeloom.vocab import TOKEN_BUDGET_BYTES


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))


def null_counts(df: DataFrame) -> DataFrame:
    """(column, nulls) of the columns that have nulls, in one pass."""
    row = df.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in df.columns))
    return row.unpivot([], df.columns, "column_name", "nulls").where("nulls > 0")


def null_zero_negative_audit(df: DataFrame) -> DataFrame:
    marks = [f(c) for c in ("cpu_time", "memory") for f in (lambda c: F.count_if(F.col(c).isNull()).alias(f"{c}_null"), lambda c: F.count_if(F.col(c) == 0).alias(f"{c}_zero"), lambda c: F.count_if(F.col(c) < 0).alias(f"{c}_negative"))]
    return df.groupBy("status").agg(F.count("*").alias("n"), *marks, F.count_if(F.col("code_size") < 0).alias("code_size_negative"))


def describe(df: DataFrame, column: str, percentiles: tuple[float, ...] = (0.25, 0.5, 0.75), digits: int = 4, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, stat, value): count, mean, sample deviation, least, percentiles (the median always), most."""
    points = sorted({0.5, *percentiles})
    names = [f"p{100 * p:g}" for p in points]
    stats = df.where(F.col(column).isNotNull()).groupBy(*by).agg(F.count(column).cast("double").alias("count"), F.avg(column).alias("mean"), F.stddev_samp(column).alias("std"), F.min(column).cast("double").alias("min"), F.max(column).cast("double").alias("max"))
    at = quantiles(df, column, tuple(points), by).select(F.col("quantiles"), *(F.col(c).alias(f"_at_{c}") for c in by))
    same = reduce(and_, (F.col(c).eqNullSafe(F.col(f"_at_{c}")) for c in by), F.lit(True))
    row = (stats.join(at, same) if by else stats.join(F.broadcast(at))).select(*by, "count", "mean", "std", "min", *(F.col("quantiles")[k].alias(n) for k, n in enumerate(names)), "max")
    return row.unpivot(list(by), [c for c in row.columns if c not in by], "stat", "value").withColumn("value", F.round("value", digits))


def group_sizes(df: DataFrame, group_col: str) -> DataFrame:
    return value_counts(df, group_col)


def concentration_share(df: DataFrame, group_col: str, tops: tuple[int, ...] = (10, 50, 100, 500, 1000)) -> DataFrame:
    """(k, share): rows in the k largest groups, as a share of all; only for k up to the number of groups.

    The running total is over distinct group sizes, of which there are few however many groups there are.
    """
    levels = group_sizes(df, group_col).groupBy("n").agg(F.count("*").alias("groups"))
    w = Window.orderBy(F.desc("n"))
    upto = levels.select("n", F.sum("groups").over(w).alias("upto"), F.sum(F.col("n") * F.col("groups")).over(w).alias("held"), "groups")
    total = levels.agg(F.sum(F.col("n") * F.col("groups")).alias("total"))
    wanted = df.sparkSession.createDataFrame([(k,) for k in tops], "k int")
    at = upto.join(F.broadcast(wanted), (F.col("k") <= F.col("upto")) & (F.col("k") > F.col("upto") - F.col("groups")))
    share = F.try_divide(F.col("held") - (F.col("upto") - F.col("k")) * F.col("n"), F.col("total"))
    return at.join(F.broadcast(total)).select("k", F.round(share, 6).alias("share"))


def truncation_profile(df: DataFrame, limit: int = TOKEN_BUDGET_BYTES) -> DataFrame:
    """Positive sizes over all rows (status ALL) and per verdict: n, median, p95, share above the limit.

    Sizes are counted once; both levels and all figures come from the counts.
    """
    counted = counted_values(df.where("code_size > 0"), "code_size", ("status",))
    level = F.explode(F.array(F.struct(F.lit(True).alias("whole"), F.lit("ALL").alias("status")), F.struct(F.lit(False).alias("whole"), "status")))
    both = written(counted.select(level.alias("level"), "value", "n").groupBy("level", "value").agg(F.sum("n").alias("n")), "sizes")
    sums = both.groupBy("level").agg(F.sum("n").alias("n"), (F.coalesce(F.sum(F.when(F.col("value") > limit, F.col("n"))), F.lit(0)) / F.sum("n")).alias("over_share"))
    at = order_statistics(both, (0.5, 0.95), ("level",))
    out = sums.join(at, "level")
    return out.select("level.status", "n", F.round(F.col("quantiles")[0], 4).alias("median"), F.round(F.col("quantiles")[1], 4).alias("p95"), F.round("over_share", 6).alias("over_share"))


def histogram(df: DataFrame, column: str, bins: int, low: float, high: float) -> DataFrame:
    """(bin, n) of ``bins`` equal bins; values above ``high`` count in the last, the upper edge belongs to it."""
    x = F.least(F.col(column).cast("double"), F.lit(float(high)))
    place = F.least(F.floor((x - low) / ((high - low) / bins)), F.lit(bins - 1)).cast("int")
    return df.where(F.col(column).isNotNull() & (F.col(column) >= low)).groupBy(place.alias("bin")).agg(F.count("*").alias("n"))


def chain_lengths(df: DataFrame) -> DataFrame:
    return df.groupBy("user_id", "problem_id").agg(F.count("*").alias("length"))


def chain_profile(df: DataFrame) -> DataFrame:
    many = F.col("length") > 1
    row = chain_lengths(df).agg(F.count("*").alias("pairs"), F.count_if(many).alias("multi"), F.coalesce(F.sum(F.when(many, F.col("length"))), F.lit(0)).alias("in_chains"), F.sum("length").alias("total"), F.max("length").alias("longest"))
    return row.select("pairs", "multi", percent(F.col("multi"), F.col("pairs")).alias("multi_pct"), "in_chains", percent(F.col("in_chains"), F.col("total")).alias("in_chains_pct"), "longest")


def chain_length_topk(df: DataFrame, k: int = 8) -> DataFrame:
    """The k most frequent chain lengths."""
    return chain_lengths(df).groupBy("length").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "length").limit(k)


def compiler_distribution(df: DataFrame, top: int = 10) -> DataFrame:
    """Compiler strings over all rows and among compile errors."""
    both = df.groupBy("original_language").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "Compile Error").alias("compile_errors"))
    return both.where("original_language is not null").orderBy(F.desc("n"), "original_language").limit(top)


def with_judge(df: DataFrame, problems: DataFrame) -> DataFrame:
    """Adds the judge of each problem; a problem list with a repeated id is an error."""
    from lakeloom.operators.audit import assert_unique

    assert_unique(problems, "id")
    return df.join(problems.select(F.col("id").alias("problem_id"), F.col("dataset").alias("judge")), "problem_id", "left")


def submitted_at(date: Column) -> Column:
    """Epoch seconds as a time; outside of years 1 to 9999 null."""
    return F.when(date.between(-62135596800, 253402300799), F.timestamp_seconds(date))


def provenance_by_year(df: DataFrame) -> DataFrame:
    return df.groupBy(F.year(submitted_at(F.col("date"))).alias("year")).agg(F.count("*").alias("n"))


def date_range(df: DataFrame) -> DataFrame:
    at = submitted_at(F.col("date"))
    return df.agg(F.date_format(F.min(at), "yyyy-MM-dd").alias("first_day"), F.date_format(F.max(at), "yyyy-MM-dd").alias("last_day"), F.count_if(at.isNull()).alias("undated"))
