"""Views that give the test tables the shape of submissions and of a file corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COMPILERS = ("C++ (GCC 9.2.1)", "C++14 (GCC 5.4.1)", "C++17 (Clang 10)")


def submissions(spark: SparkSession, sf_dir: str, skewed: bool = False) -> DataFrame:
    """``events`` as submissions; ``skewed`` gives groups of 1, 3, 5 ... rows."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    m = F.col("event_id") % 100
    status = (
        F.when(m < 54, "Accepted").when(m < 80, "Wrong Answer").when(m < 86, "Compile Error").when(m < 91, "Runtime Error").when(m == 91, "Time Limit Exceeded").when(m == 92, "Memory Limit Exceeded")
        .when(m == 93, "Output Limit Exceeded").when(m == 94, "Query Limit Exceeded").when(m == 95, "WA: Presentation Error").when(m == 96, "Judge Not Available").when(m == 97, "Internal error").otherwise("Judge System Error")
    )
    problem = F.concat(F.lit("g"), F.lpad(F.floor(F.sqrt("event_id")).cast("string"), 4, "0")) if skewed else F.concat(F.lit("p"), F.lpad(F.get_json_object("props", "$.k"), 5, "0"))
    compiled = F.col("status") != "Compile Error"
    rows = e.select("event_id", F.col("event_id").cast("string").alias("submission_id"), problem.alias("problem_id"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("user_id"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("date"), F.when(F.col("event_id") % 10 == 9, "Python").otherwise("C++").alias("language"), F.get(F.array(*map(F.lit, COMPILERS)), (F.col("user_id") % 3).cast("int")).alias("original_language"), status.alias("status"), F.floor(F.col("value") * 10).cast("int").alias("code_size"))
    return rows.withColumn("cpu_time", F.when(compiled, F.col("event_id") % 1000 - 1)).withColumn("memory", F.when(compiled, F.col("event_id") * 7 % 4096)).drop("event_id")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as labelled source files."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    label = F.get(F.array(F.lit("ERROR_FREE"), F.lit("COMPILE_ERROR"), F.lit("RUNTIME_ERROR"), F.lit("LOGICAL")), (F.col("doc_id") % 4).cast("int"))
    return d.select(F.col("doc_id").cast("string").alias("submission_id"), F.col("source").alias("problem_id"), label.alias("coarse_label"), F.octet_length("text").alias("code_size"), F.encode("text", "UTF-8").alias("content"))
