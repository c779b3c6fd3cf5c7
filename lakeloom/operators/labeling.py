"""Mapping verdicts to classes, with what is discarded and why."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom import vocab

MANIFEST = ("submission_id", "problem_id", "user_id", "status", "date", "code_size", "original_language")


def unknown_verdicts(df: DataFrame, status_col: str = "status") -> DataFrame:
    """Distinct verdicts outside of the vocabulary."""
    known = vocab.dim_verdict(df.sparkSession).select(F.col("status").alias(status_col))
    return df.select(status_col).where(F.col(status_col).isNotNull()).distinct().join(F.broadcast(known), status_col, "left_anti")


def assert_known_verdicts(df: DataFrame, status_col: str = "status") -> None:
    """Raises UnknownVerdictError that names all unknown verdicts."""
    vocab.check_verdicts(r[0] for r in unknown_verdicts(df, status_col).collect())


def with_outcome(df: DataFrame) -> DataFrame:
    """Adds coarse_label, discard_reason and kept; unknown verdicts have nulls."""
    return df.join(F.broadcast(vocab.dim_verdict(df.sparkSession)), "status", "left")


def labeled_manifest(df: DataFrame) -> DataFrame:
    """The kept rows with their class; the filter on verdicts reaches the scan."""
    kept = [v for v, c, _ in vocab.VERDICTS if c]
    rows = df.where(F.col("status").isin(kept)).select(*MANIFEST)
    labels = vocab.dim_verdict(df.sparkSession).where("kept").select("status", "coarse_label")
    return rows.join(F.broadcast(labels), "status").select(*MANIFEST, "coarse_label")


def percent(part, total, digits: int = 2):
    """Half-even, as the reports round; null of nothing."""
    return F.bround(F.try_divide(100.0 * part, total), digits)


def verdict_distribution(df: DataFrame) -> DataFrame:
    counts = df.where("status is not null").groupBy("status").agg(F.count("*").alias("n"))
    total = df.agg(F.count("*").alias("total"))  # one row
    return counts.join(F.broadcast(total)).select("status", "n", percent(F.col("n"), F.col("total")).alias("pct"))


def discard_summary(df: DataFrame) -> DataFrame:
    """verdict, reason, count and percent of all rows, for discarded verdicts."""
    counts = df.groupBy("status").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    out = with_outcome(counts).where("not kept").join(F.broadcast(total))
    return out.select("status", "discard_reason", "n", percent(F.col("n"), F.col("total"), 4).alias("pct"))


def discard_by_reason(df: DataFrame) -> DataFrame:
    counts = df.groupBy("status").agg(F.count("*").alias("n"))
    return with_outcome(counts).where("not kept").groupBy("discard_reason").agg(F.sum("n").alias("n"), F.count("*").alias("verdicts"))


def candidate_pool(df: DataFrame) -> DataFrame:
    """tier, verdict, target classes, n, percent of all rows; verdicts without rows have 0."""
    counts = df.groupBy("status").agg(F.count("*").alias("n"))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    pool = vocab.dim_pool(df.sparkSession).join(counts, "status", "left").join(F.broadcast(total))
    n = F.coalesce("n", F.lit(0))
    return pool.select("ord", "tier", F.col("status").alias("verdict"), "target_classes", n.alias("n"), percent(n, F.col("total")).alias("pct_of_all"))


def pool_totals(df: DataFrame) -> DataFrame:
    kept = F.col("status").isin([v for v, c, _ in vocab.VERDICTS if c])
    row = df.agg(F.count("*").alias("total"), F.count_if(kept).alias("kept"))
    discarded = F.col("total") - F.col("kept")
    return row.select("total", "kept", percent(F.col("kept"), F.col("total")).alias("kept_pct"), discarded.alias("discarded"), percent(discarded, F.col("total")).alias("discarded_pct"))


def label_distribution(labeled: DataFrame) -> DataFrame:
    counts = labeled.groupBy("coarse_label").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(total)).select("coarse_label", vocab.ordinal(F.col("coarse_label"), vocab.COARSE).alias("coarse_id"), "n", F.try_divide("n", "total").alias("share"))


def language_status_matrix(df: DataFrame) -> DataFrame:
    """Counts of all languages, before any is dropped."""
    return df.groupBy("language", "status").agg(F.count("*").alias("n"))


def leaf_coverage(labeled: DataFrame) -> DataFrame:
    """Every leaf of the taxonomy, with the rows of its coarse class, and those that a label tells as the leaf (terminal leaves alone)."""
    counts = labeled.groupBy("coarse_label").agg(F.count("*").alias("class_rows"))
    leaves = vocab.dim_leaf(labeled.sparkSession).join(counts, "coarse_label", "left")
    rows = F.coalesce("class_rows", F.lit(0))
    return leaves.select("leaf_id", "leaf", "coarse_label", "coarse_id", "tier", "terminal", rows.alias("class_rows"), F.when(F.col("terminal"), rows).otherwise(0).alias("leaf_rows"))
