"""The library's queries over the test tables, each a thin composition of operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakeloom import vocab
from lakeloom.functions.content import ARCHIVE_ROOT, archive_path, content_hash, strip_prefix
from lakeloom.functions.ordering import exact_sample, random_split, with_rank
from lakeloom.operators import audit, dedup, freeze, inference, labeling, probe, profile, sampling, splitting
from lakeloom.sources import archive, readers, tree
from lakeloom.sources.fixtures import corpus, submissions
from lakeloom.sources.shared import new_folder
from lakeloom.streaming import metadata
from lakeloom.vocab import SEED

Query = Callable[[SparkSession, str], DataFrame]

#: Quotas of the sample queries: small enough to bind at every scale of the test tables.
QUOTAS = {(s, c): {"train": 60, "val": 20, "test": 20}[s] for s in vocab.SPLITS for c in vocab.COARSE}


def _labeled(spark: SparkSession, sf_dir: str, skewed: bool = True) -> DataFrame:
    return labeling.labeled_manifest(submissions(spark, sf_dir, skewed))


def _split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.group_split(_labeled(spark, sf_dir))


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The file corpus with group split and content hash."""
    hashed = corpus(spark, sf_dir).withColumn("sha256", content_hash(F.col("content"))).drop("content")
    return splitting.group_split(hashed)


def _hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = corpus(spark, sf_dir).select(F.col("submission_id").alias("path"), "content")
    return dedup.hash_corpus(files.select("path"), files)


def language_status_matrix(spark, sf_dir):
    return labeling.language_status_matrix(submissions(spark, sf_dir))


def unknown_verdicts(spark, sf_dir):
    planted = F.when(F.col("submission_id").cast("long") % 1000 == 7, F.lower("status")).otherwise(F.col("status"))
    return labeling.unknown_verdicts(submissions(spark, sf_dir).withColumn("status", planted))


def null_counts(spark, sf_dir):
    return profile.null_counts(submissions(spark, sf_dir))


def group_size_describe(spark, sf_dir):
    return profile.describe(profile.group_sizes(submissions(spark, sf_dir, True), "problem_id"), "n", (0.05, 0.25, 0.5, 0.75, 0.95))


def code_size_histogram(spark, sf_dir):
    return profile.histogram(submissions(spark, sf_dir), "code_size", 80, 0, 8000)


def code_size_describe(spark, sf_dir):
    """Figures of the code sizes of each verdict and language."""
    return profile.describe(submissions(spark, sf_dir).where("code_size > 0"), "code_size", (0.01, 0.5, 0.99), by=("status", "language"))


def group_size_histogram(spark, sf_dir):
    return profile.histogram(profile.group_sizes(submissions(spark, sf_dir, True), "problem_id"), "n", 60, 0, 600)


def provenance_by_judge(spark, sf_dir):
    problems = submissions(spark, sf_dir).select(F.col("problem_id").alias("id")).distinct().withColumn("dataset", F.when(F.substring("id", 6, 1) < "5", "AIZU").otherwise("AtCoder"))
    return profile.value_counts(profile.with_judge(submissions(spark, sf_dir), problems), "judge")


def random_split_query(spark, sf_dir):
    return random_split(submissions(spark, sf_dir).select("submission_id"), "submission_id", SEED)


def group_split_lpt(spark, sf_dir):
    return _split(spark, sf_dir).groupBy("problem_id", "split").agg(F.count("*").alias("n"))


def split_summary(spark, sf_dir):
    return splitting.split_summary(_split(spark, sf_dir), "coarse_label", vocab.COARSE)


def split_class_composition(spark, sf_dir):
    return splitting.split_composition(_split(spark, sf_dir))


def problem_overlap_group(spark, sf_dir):
    return splitting.cross_split_counts(_split(spark, sf_dir), "problem_id")


def problem_overlap_random(spark, sf_dir):
    return splitting.cross_split_counts(random_split(_labeled(spark, sf_dir), "submission_id", SEED, name="split"), "problem_id")


def chain_straddle(spark, sf_dir):
    rows = labeling.labeled_manifest(submissions(spark, sf_dir))
    return splitting.chain_straddle(random_split(splitting.group_split(rows), "submission_id", SEED))


def quota_table(spark, sf_dir):
    """Quotas of a tenth of each class."""
    totals = sampling.measured_totals(_labeled(spark, sf_dir, False), 0.1)
    return sampling.quota_table(spark, sampling.resolve_quotas(totals))


def round_robin_sample(spark, sf_dir):
    sample, _ = sampling.draw_sample(_split(spark, sf_dir), QUOTAS)
    return sample.select("submission_id", "problem_id", "split", "coarse_label")


def sampling_report(spark, sf_dir):
    return sampling.draw_sample(_split(spark, sf_dir), QUOTAS)[1]


def round_robin_coverage(spark, sf_dir):
    """Groups reached by round robin and by a plain seeded draw of as many rows per class."""
    rows, most = _labeled(spark, sf_dir), 100
    turn = sampling.round_robin(rows, ["coarse_label"], "problem_id", "submission_id", most)
    ranked = with_rank(rows, "submission_id", SEED)
    window = F.row_number().over(Window.partitionBy("coarse_label").orderBy("rank"))
    naive = ranked.withColumn("pos", window).where(F.col("pos") <= most)
    count = lambda df, name: df.groupBy("coarse_label").agg(F.count_distinct("problem_id").alias(name))
    return count(turn, "round_robin_groups").join(count(naive, "naive_groups"), "coarse_label")


def archive_paths(spark, sf_dir):
    return sampling.archive_paths(_labeled(spark, sf_dir, False)).select("submission_id", "archive_path", strip_prefix(F.col("archive_path"), "Project_CodeNet/data/").alias("rel_path"))


def content_hashes(spark, sf_dir):
    return _hashes(spark, sf_dir)


def duplicate_groups(spark, sf_dir):
    return dedup.duplicate_groups(_hashes(spark, sf_dir))


def label_consistency(spark, sf_dir):
    return dedup.label_consistency(_files(spark, sf_dir))


def plurality_exclusion(spark, sf_dir):
    return dedup.exclude_minority_copies(_files(spark, sf_dir)).select("submission_id", "split", "sha256")


def final_report(spark, sf_dir):
    files = _files(spark, sf_dir).withColumn("rel_path", F.col("submission_id"))
    return dedup.final_manifest(files, dedup.exclude_minority_copies(files), _hashes(spark, sf_dir))[1]


def path_reconciliation(spark, sf_dir):
    files = corpus(spark, sf_dir).select("submission_id")
    number = F.col("submission_id").cast("long")
    return audit.reconciliation(files.where(number % 7 != 0), files.where(number % 11 != 0), "submission_id")


def byte_check(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    manifest = docs.select(F.col("doc_id").alias("id"), F.col("n_chars").alias("code_size"))
    files = docs.select(F.col("doc_id").alias("id"), F.octet_length("text").alias("length"))
    return audit.byte_check(manifest, files, "id")


def worst_byte_diffs(spark, sf_dir):
    return audit.worst_byte_diffs(byte_check(spark, sf_dir), "id")


def exact_n_sample(spark, sf_dir):
    return exact_sample(submissions(spark, sf_dir), "submission_id", 500, SEED).select("submission_id", "status")


def metadata_csv(spark, sf_dir):
    """Submissions written as CSV files of two column orders and read back by name."""
    folder = new_folder(spark, "metadata")
    rows = submissions(spark, sf_dir).withColumn("filename_ext", F.lit("cpp"))
    for accepted, columns in ((True, list(readers.METADATA)), (False, [*reversed(readers.METADATA)])):
        rows.where((F.col("status") == "Accepted") == accepted).select(*columns).write.mode("append").option("header", True).csv(folder)
    return readers.read_metadata(spark, folder, "*.csv")


def report_csv(spark, sf_dir):
    """A report written as CSV and read back as a dimension table."""
    folder = new_folder(spark, "report")
    readers.write_report(submissions(spark, sf_dir).groupBy("status").agg(F.count("*").alias("n")), folder)
    return readers.read_dimension(spark, folder, {"status": "string", "n": "bigint"})


def path_lines(spark, sf_dir):
    """A list of paths written as text and read back."""
    folder = new_folder(spark, "paths")
    readers.write_lines(corpus(spark, sf_dir).select(F.concat("submission_id", F.lit(".cpp")).alias("path")), "path", folder)
    return readers.read_lines(spark, folder)


def incremental_metadata(spark, sf_dir):
    """Submissions that come in as CSV files in two parts, read by a run after each; the second reads new files only."""
    folder, target, checkpoint = (new_folder(spark, name) for name in ("incoming", "landed", "stream"))
    rows = submissions(spark, sf_dir).withColumn("filename_ext", F.lit("cpp"))
    for accepted, columns in ((True, list(readers.METADATA)), (False, [*reversed(readers.METADATA)])):
        rows.where((F.col("status") == "Accepted") == accepted).select(*columns).write.mode("append").option("header", True).csv(folder)
        metadata.append_new_metadata(spark, folder, target, checkpoint, "*.csv")
    return metadata.landed_metadata(spark, target)


def _archived(spark: SparkSession, sf_dir: str) -> str:
    """A folder of archives that hold the corpus."""
    folder = new_folder(spark, "archives")
    files = corpus(spark, sf_dir)
    archive.write_archives(files.select(archive_path(F.col("problem_id"), F.col("submission_id")).alias("name"), "content"), folder)
    return folder


def archive_members(spark, sf_dir):
    """Members of archives whose names start with a prefix, listed without unpacking any."""
    wanted = F.col("name").startswith(f"{ARCHIVE_ROOT}/src1")
    return archive.read_members(spark, _archived(spark, sf_dir), content=False, where=wanted).select("name", "size", "regular")


def extracted_tree(spark, sf_dir):
    """Archives unpacked into a file tree, which is listed, read back and hashed."""
    members = archive.read_members(spark, _archived(spark, sf_dir)).where("regular")
    folder = new_folder(spark, "tree")
    tree.write_tree(members.withColumn("path", strip_prefix(F.col("name"), f"{ARCHIVE_ROOT}/")), folder)
    return tree.read_tree(spark, folder, "*.cpp").select("path", "length", content_hash(F.col("content")).alias("sha256"))


def artifact_digests(spark, sf_dir):
    return freeze.content_digests(_split(spark, sf_dir), ("split",))


def guarded_manifest(spark, sf_dir):
    """What guards count while the labelled manifest is written, in the one job that writes it."""
    guards = audit.Guards().no_nulls("submission_id", "problem_id", "user_id").values("coarse_label", vocab.COARSE)
    readers.write_parquet(guards.watch(_labeled(spark, sf_dir, False)), new_folder(spark, "manifest"))
    return spark.createDataFrame(sorted(guards.verify().items()), "metric string, n long")


def encoding_survey(spark, sf_dir):
    return probe.encoding_survey(corpus(spark, sf_dir))


def encoding_mix(spark, sf_dir):
    """Encodings of all files, where every fifth one ends in Shift-JIS bytes and every fifth in bytes of no encoding."""
    files = corpus(spark, sf_dir)
    kind, plain = F.col("submission_id").cast("long") % 5, F.regexp_replace(F.decode("content", "UTF-8"), r"[^\x00-\x7F]", "")
    ends = lambda tail: F.concat(F.encode(plain, "UTF-8"), F.lit(tail))
    mixed = F.when(kind == 0, ends("日本語".encode("shift_jis"))).when(kind == 1, ends(b"\x80\xff")).otherwise(F.col("content"))
    return probe.encoding_counts(files.select(mixed.alias("content")))


def stderr_classes(spark, sf_dir):
    """What would be said of each file by a compiler that fails on all but every fifth, told by its end, with a linker's message for some."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kind = F.col("doc_id") % 5
    said = F.concat(F.coalesce("text", F.lit("")), F.when(kind == 1, f": {probe.LINKER_MARKS[0]} to main").when(kind == 2, f"\n{probe.LINKER_MARKS[1]} 1 exit status").otherwise(""))
    probed = docs.select("doc_id", F.when(kind == 0, "COMPILED_CLEAN").otherwise("FAILED").alias("outcome"), said.alias("stderr"))
    return probe.classified(probed).select("doc_id", "outcome", "classification", "stderr_tail")


def frozen_config(spark, sf_dir):
    """The record of the split manifest, written as JSON, copied and read back: rows of each split, and the digest."""
    final = _split(spark, sf_dir)
    counts = {r["split"]: r["rows"] for r in splitting.split_summary(final).collect()}
    folder = new_folder(spark, "config")
    readers.write_config(freeze.freeze_config(final, row_counts=counts, findings={}), f"{folder}/first.json")
    readers.copy_file(spark, f"{folder}/first.json", f"{folder}/copy.json")
    told = spark.read.option("multiLine", True).json(f"{folder}/copy.json")
    return told.select("split.seed", "taxonomy_version", *(F.col(f"row_counts.{s}").alias(f"{s}_rows") for s in vocab.SPLITS), F.col("artifact_digest.value").alias("digest"))


def compile_probe(spark, sf_dir):
    n = corpus(spark, sf_dir).where("coarse_label = 'COMPILE_ERROR'").count()
    return probe.compile_probe(corpus(spark, sf_dir), min(n, probe.PILOT_ROWS))


def predict_distribution(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.col("text").alias("code"))
    told = inference.predict(docs, inference.build_predictor({"type": "dummy", "seed": SEED}), "doc_id").select("doc_id", "prediction.*")
    each = [F.round(F.col("probabilities")[k]["probability"], 9).alias(f"p_{label}") for k, label in enumerate(vocab.SERVING_CLASSES)]
    return told.select("doc_id", "predicted_class", F.round("confidence", 9).alias("confidence"), *each, "model_name", "is_placeholder")


def clean_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: split the file corpus by group, sample by quota, drop copies that cross splits."""
    sample, _ = sampling.draw_sample(_files(spark, sf_dir), QUOTAS)
    return dedup.exclude_minority_copies(sample).select("submission_id", "problem_id", "coarse_label", "split", "sha256")


def _over(operator: Callable[..., DataFrame], source: Callable[[SparkSession, str], DataFrame], *args) -> Query:
    return lambda spark, sf_dir: operator(source(spark, sf_dir), *args)


QUERIES: dict[str, Query] = {
    "verdict_distribution": _over(labeling.verdict_distribution, submissions),
    "language_status_matrix": language_status_matrix,
    "candidate_pool": _over(labeling.candidate_pool, submissions),
    "pool_totals": _over(labeling.pool_totals, submissions),
    "discard_summary": _over(labeling.discard_summary, submissions),
    "discard_by_reason": _over(labeling.discard_by_reason, submissions),
    "unknown_verdicts": unknown_verdicts,
    "labeled_manifest": _over(labeling.labeled_manifest, submissions),
    "label_distribution": lambda spark, sf_dir: labeling.label_distribution(_labeled(spark, sf_dir, False)),
    "null_counts": null_counts,
    "null_zero_negative_audit": _over(profile.null_zero_negative_audit, submissions),
    "compiler_distribution": _over(profile.compiler_distribution, submissions),
    "provenance_by_year": _over(profile.provenance_by_year, submissions),
    "provenance_by_judge": provenance_by_judge,
    "date_range": _over(profile.date_range, submissions),
    "group_size_describe": group_size_describe,
    "code_size_describe": code_size_describe,
    "concentration_share": lambda spark, sf_dir: profile.concentration_share(submissions(spark, sf_dir, True), "problem_id"),
    "code_size_truncation": _over(profile.truncation_profile, submissions),
    "code_size_histogram": code_size_histogram,
    "group_size_histogram": group_size_histogram,
    "chain_profile": lambda spark, sf_dir: profile.chain_profile(_labeled(spark, sf_dir, False)),
    "chain_length_topk": lambda spark, sf_dir: profile.chain_length_topk(_labeled(spark, sf_dir, False)),
    "random_split": random_split_query,
    "group_split_lpt": group_split_lpt,
    "split_summary": split_summary,
    "split_class_composition": split_class_composition,
    "problem_overlap_group": problem_overlap_group,
    "problem_overlap_random": problem_overlap_random,
    "chain_straddle": chain_straddle,
    "quota_table": quota_table,
    "round_robin_sample": round_robin_sample,
    "sampling_report": sampling_report,
    "round_robin_coverage": round_robin_coverage,
    "archive_paths": archive_paths,
    "content_hashes": content_hashes,
    "duplicate_groups": duplicate_groups,
    "dedup_report": _over(dedup.dedup_report, _hashes),
    "cross_split_overlap": lambda spark, sf_dir: dedup.cross_split_counts(_files(spark, sf_dir), "sha256"),
    "collision_forensics": _over(dedup.collision_forensics, _files),
    "label_consistency": label_consistency,
    "plurality_exclusion": plurality_exclusion,
    "final_report": final_report,
    "path_reconciliation": path_reconciliation,
    "byte_check": byte_check,
    "byte_check_summary": lambda spark, sf_dir: audit.byte_check_summary(byte_check(spark, sf_dir)),
    "worst_byte_diffs": worst_byte_diffs,
    "taxonomy_leaf_dim": lambda spark, sf_dir: labeling.leaf_coverage(_labeled(spark, sf_dir, False)),
    "exact_n_sample": exact_n_sample,
    "metadata_csv": metadata_csv,
    "report_csv": report_csv,
    "path_lines": path_lines,
    "incremental_metadata": incremental_metadata,
    "archive_members": archive_members,
    "extracted_tree": extracted_tree,
    "artifact_digests": artifact_digests,
    "guarded_manifest": guarded_manifest,
    "encoding_survey": encoding_survey,
    "encoding_mix": encoding_mix,
    "stderr_classes": stderr_classes,
    "frozen_config": frozen_config,
    "compile_probe": compile_probe,
    "predict_distribution": predict_distribution,
    "clean_corpus": clean_corpus,
}
