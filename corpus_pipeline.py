"""Corpus pipeline over ``documents``: toxicity, line dedup, near-duplicate documents, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and
read again as the next stage's ``docs``. All but the last return the columns of ``docs``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.llm.jaccard_join import jaccard_components
from lakeloom.llm.line_dedup import dedup_lines, private_names
from lakeloom.llm.mixing import mixed_documents
from lakeloom.llm.packing import pack_documents
from lakeloom.llm.scratch import Scratch
from lakeloom.llm.toxicity import scored_documents

TOXIC_FROM = 0.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is below ``TOXIC_FROM``."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    (score,) = private_names(docs.columns, "_toxicity")
    return scored_documents(docs, labels, score_col=score).where(F.col(score) < TOXIC_FROM).select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that match earlier ones; documents of such lines alone go."""
    deduped = dedup_lines(docs)
    emptied = (F.size("removed_lines") > 0) & (F.trim("text") == "")
    return deduped.where(~F.coalesce(emptied, F.lit(False))).withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near-duplicates, and all that are near to none.

    Rows without an id come after all others, those of one text under one number. Of rows that
    share id and text (two hashes, of 64 and 32 bits) one stays; other texts of one id stay or go
    together. Texts without words stay.
    """
    scratch = Scratch(spark, "near-copies")
    id_, h1, h2 = private_names(docs.columns, "_id", "_h1", "_h2")
    text = F.coalesce("text", F.lit(""))
    numbered = F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(text).bitwiseAND(2**61 - 1) + 2**62)
    keyed = docs.select(*docs.columns, numbered.alias(id_), F.xxhash64(text).alias(h1), F.hash(text).alias(h2))
    dropped = jaccard_components(keyed, id_col=id_).where("n_shingles > 0 and component_id <> doc_id").select(F.col("doc_id").alias(id_))
    left = keyed.join(dropped, id_, "left_anti")
    repeated = scratch.keep(keyed.where(text.rlike(r"[^\x20\x09-\x0D]")).groupBy(id_, h1, h2).count().where("count > 1").drop("count"), "repeated")
    if not repeated.isEmpty():
        told = scratch.small(repeated, "repeated")
        left = left.join(told, [id_, h1, h2], "left_anti").unionByName(left.join(told, [id_, h1, h2], "left_semi").dropDuplicates([id_, h1, h2]))
    return left.select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequence and place."""
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("ngram_jaccard_join", keep_one_of_near_copies),
    ("mixing", mix),
    ("best_fit_packing", pack),
]

#: Tokenizing, a fitted classifier and connected components are beyond SQL; tests hold line dedup and near-copies
#: against brute force, and the other stages to what they promise.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``; a stage's table goes when the next one is written."""
    scratch = Scratch(spark, "pipeline")
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
        if before:
            scratch.drop(before)
        before = name
    return docs
