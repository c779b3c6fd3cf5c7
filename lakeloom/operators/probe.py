"""Probes of file content: encodings, and recompiling a sample."""

from __future__ import annotations

import subprocess
import tempfile
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeloom.functions.content import encoding_of, has_high_byte
from lakeloom.functions.ordering import exact_sample
from lakeloom.operators.labeling import percent
from lakeloom.vocab import SEED

# What a linker's message holds, and the probe's size and reserve.
LINKER_MARKS = ("undefined reference", "collect2: error: ld returned")
PILOT_ROWS, TIMEOUT_S, RESERVE, TAIL = 500, 15, 30_000, 300
RESULT = "submission_id string, problem_id string, outcome string, stderr string"


def encoding_survey(files: DataFrame, n: int = 2_000, seed: int = SEED, id_col: str = "submission_id") -> DataFrame:
    """(encoding, n, high_byte) over a seeded sample of exactly ``n`` files."""
    return encoding_counts(exact_sample(files, id_col, n, seed))


def encoding_counts(files: DataFrame) -> DataFrame:
    """(encoding, n, high_byte) over all files."""
    told = files.select(encoding_of(F.col("content")).alias("encoding"), has_high_byte(F.col("content")).alias("high"))
    return told.groupBy("encoding").agg(F.count("*").alias("n"), F.count_if("high").alias("high_byte"))


def classify_stderr(stderr: Column) -> Column:
    a, b = (stderr.contains(m) for m in LINKER_MARKS)
    return F.when(a | b, "LINKER").otherwise("OTHER")


def classified(probed: DataFrame) -> DataFrame:
    """Adds the classification of failures, null for other outcomes, and the last 300 characters of what the compiler said."""
    failed = F.when(F.col("outcome") == "FAILED", classify_stderr(F.col("stderr")))
    return probed.withColumn("classification", failed).withColumn("stderr_tail", F.right("stderr", F.lit(TAIL)))


def _compile(command: tuple[str, ...], timeout: float):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with tempfile.TemporaryDirectory(prefix="probe_") as folder:
            source, target = Path(folder, "a.cpp"), Path(folder, "a.out")
            for frame in frames:
                rows = []
                for row in frame.itertuples():
                    outcome, said = "SOURCE_MISSING", ""
                    if row.content is not None:
                        source.write_bytes(bytes(row.content))
                        try:
                            done = subprocess.run([*command, str(source), "-o", str(target)], capture_output=True, text=True, errors="replace", timeout=timeout)
                            outcome, said = ("FAILED" if done.returncode else "COMPILED_CLEAN"), done.stderr
                        except subprocess.TimeoutExpired:
                            outcome = "TIMEOUT"
                        target.unlink(missing_ok=True)
                    rows.append((row.submission_id, row.problem_id, outcome, said))
                yield pd.DataFrame(rows, columns=["submission_id", "problem_id", "outcome", "stderr"])

    return run


def compile_probe(files: DataFrame, n: int = PILOT_ROWS, seed: int = SEED, timeout: float = TIMEOUT_S, command: tuple[str, ...] = ("g++", "-std=gnu++17")) -> DataFrame:
    """Compiles (never runs) exactly ``n`` compile errors: outcome, classification of failures, end of stderr.

    ``files`` has submission_id, problem_id, coarse_label and content (null: the source is missing).
    Raises ValueError if there are fewer than ``n``.
    """
    errors = files.where("coarse_label = 'COMPILE_ERROR'").select("submission_id", "problem_id", "content")
    if (have := errors.count()) < n:
        raise ValueError(f"only {have} compile errors; {n} are needed")
    probed = exact_sample(errors, "submission_id", n, seed).repartition(32).mapInPandas(_compile(command, timeout), RESULT)
    return classified(probed).select("submission_id", "problem_id", "outcome", "classification", "stderr_tail")


def probe_summary(report: DataFrame, sampled: int = PILOT_ROWS, reserve: int = RESERVE) -> DataFrame:
    """Failures, linker failures, their rates, and the projection on the reserve."""
    row = report.agg(F.count_if(F.col("outcome") == "FAILED").alias("failed"), F.count_if(F.col("classification") == "LINKER").alias("linker"))
    return row.select("failed", "linker", percent(F.col("linker"), F.col("failed")).alias("pct_of_failed"), percent(F.col("linker"), F.lit(sampled)).alias("pct_of_sample"), F.floor(F.lit(reserve) * F.col("linker") / sampled).cast("long").alias("projected"))
