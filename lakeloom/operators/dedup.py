"""Exact duplicates by normalised content, and the audit and repair of splits that share them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom import vocab
from lakeloom.functions.content import content_hash, forward_slashes
from lakeloom.functions.ordering import running
from lakeloom.operators.splitting import assert_disjoint, cross_split_counts, in_mask, split_mask
from lakeloom.vocab import SPLITS

HASHES = "path string, sha256 string, bytes long, exists boolean"

__all__ = ["assert_no_cross_split_duplicates", "collision_forensics", "cross_split_counts", "dedup_report", "duplicate_groups", "exclude_minority_copies", "final_manifest", "hash_corpus", "label_consistency", "with_keep_split"]


def hash_corpus(wanted: DataFrame, files: DataFrame, path_col: str = "path") -> DataFrame:
    """(path, sha256, bytes, exists) of every wanted path; a missing file has nulls and exists = false.

    ``files`` has path and content; ``bytes`` is the size before normalisation.
    """
    paths = wanted.select(forward_slashes(F.col(path_col)).alias("path"))
    hashed = files.select(forward_slashes(F.col("path")).alias("path"), content_hash(F.col("content")).alias("sha256"), F.octet_length("content").cast("long").alias("bytes"))
    return paths.join(hashed, "path", "left").withColumn("exists", F.col("sha256").isNotNull())


def duplicate_groups(hashes: DataFrame) -> DataFrame:
    """(sha256, count, representative, place, path) of content that more than one file has, a row for each file.

    Files of a content are in order of their path, the first one being its representative. A content
    is rows, never one list, and its places come from ranges of paths, so it may have any number of files.
    """
    there = hashes.where("sha256 is not null").select("sha256", "path")
    many = there.groupBy("sha256").agg(F.count("*").alias("count"), F.min("path").alias("representative")).where("count > 1")
    return running(there.join(many, "sha256"), ["sha256"], ["path"], "place").select("sha256", "count", "representative", "place", "path")


def dedup_report(hashes: DataFrame) -> DataFrame:
    """One row of counts; all 0 without any file."""
    per = hashes.groupBy("sha256").agg(F.count("*").alias("n"))
    there, many = F.col("sha256").isNotNull(), F.col("sha256").isNotNull() & (F.col("n") > 1)
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    row = per.agg(zero(F.sum(F.when(there, F.col("n")))).alias("files_hashed"), zero(F.sum(F.when(~there, F.col("n")))).alias("files_missing"), F.count_if(there).alias("unique_hashes"), F.count_if(many).alias("duplicate_groups"), zero(F.sum(F.when(many, F.col("n")))).alias("files_in_duplicate_groups"))
    redundant = F.col("files_hashed") - F.col("unique_hashes")
    rate = F.when(F.col("files_hashed") > 0, F.bround((1 - F.try_divide("unique_hashes", "files_hashed")) * 100, 4)).otherwise(0.0)
    return row.withColumn("redundant_files", redundant).withColumn("duplicate_rate_pct", rate)


def assert_no_cross_split_duplicates(df: DataFrame, hash_col: str = "sha256", split_col: str = "split") -> None:
    assert_disjoint(df, hash_col, split_col)


def collision_forensics(df: DataFrame, hash_col: str = "sha256", split_col: str = "split") -> DataFrame:
    """(sha256, files, splits) of content in more than one split."""
    groups = df.where(F.col(hash_col).isNotNull()).groupBy(hash_col).agg(F.count("*").alias("files"), split_mask(split_col).alias("s"))
    splits = F.concat_ws(",", *(F.when(in_mask("s", x), F.lit(x)) for x in SPLITS))
    return groups.where(F.bit_count("s") > 1).select(hash_col, "files", splits.alias("splits"))


def label_consistency(df: DataFrame, label_col: str = "coarse_label", hash_col: str = "sha256") -> DataFrame:
    """How many shared contents have one label, and how many several."""
    groups = df.where(F.col(hash_col).isNotNull()).groupBy(hash_col).agg(F.count("*").alias("n"), F.min(label_col).alias("least"), F.max(label_col).alias("most")).where("n > 1")
    return groups.agg(F.count_if(F.col("least") == F.col("most")).alias("one_label"), F.count_if(F.col("least") < F.col("most")).alias("several_labels"))


def with_keep_split(df: DataFrame, hash_col: str = "sha256", split_col: str = "split") -> DataFrame:
    """Adds keep_split to rows whose content is in several splits: the one with most of its files, the earlier on a tie."""
    counts = df.where(F.col(hash_col).isNotNull() & F.col(split_col).isNotNull()).groupBy(hash_col, split_col).agg(F.count("*").alias("n"))
    place = vocab.ordinal(F.col(split_col), SPLITS)
    best = counts.groupBy(hash_col).agg(F.count("*").alias("_splits"), F.max(F.struct("n", (-place).alias("o"), split_col)).alias("_best")).where("_splits > 1")
    return df.join(best.select(hash_col, F.col(f"_best.{split_col}").alias("keep_split")), hash_col, "left")


def exclude_minority_copies(df: DataFrame, hash_col: str = "sha256", split_col: str = "split") -> DataFrame:
    """``df`` without the copies that stand outside of their content's keep_split."""
    kept = with_keep_split(df, hash_col, split_col).where(F.coalesce(F.col("keep_split") == F.col(split_col), F.lit(True)))
    return kept.select(*df.columns)


def final_manifest(sample: DataFrame, clean: DataFrame, hashes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(manifest with bytes, report): the rows that the exclusion kept, and the counts with the rows it dropped."""
    sizes = hashes.select(F.col("path").alias("rel_path"), "sha256", "bytes")
    manifest = clean.join(sizes, ["rel_path", "sha256"], "left")
    before, after = sample.agg(F.count("*").alias("b")), clean.agg(F.count("*").alias("a"))
    dropped = before.join(F.broadcast(after)).select((F.col("b") - F.col("a")).alias("rows_dropped_cross_split_dedup"))
    report = dedup_report(hashes).join(F.broadcast(dropped))
    return manifest, report
