"""Sources and sinks."""

from __future__ import annotations

import csv
import json
from functools import reduce
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.sources.files import opened
from lakeloom.sources.tree import list_tree, read_tree, write_tree

__all__ = ["METADATA", "copy_file", "list_tree", "load_config", "metadata_files", "read_dimension", "read_files", "read_lines", "read_metadata", "read_tree", "write_config", "write_lines", "write_parquet", "write_report", "write_tree"]

# The columns and types of the data format.
METADATA = {
    "submission_id": "string",
    "problem_id": "string",
    "user_id": "string",
    "date": "bigint",
    "language": "string",
    "original_language": "string",
    "filename_ext": "string",
    "status": "string",
    "cpu_time": "bigint",
    "memory": "bigint",
    "code_size": "bigint",
}


def metadata_files(spark: SparkSession, headers: dict[str, list[str]]) -> DataFrame:
    """Metadata of files given by their header line: named projection, pinned types, as many scans as headers.

    A header that does not name all columns is a KeyError.
    """
    if bare := sorted(p for line, paths in headers.items() if not set(METADATA) <= set(next(csv.reader([line]), ())) for p in paths):
        raise KeyError(f"{len(bare)} file(s) lack columns of {list(METADATA)}: {bare[:5]}")
    read = spark.read.option("header", True).option("nullValue", "")
    parts = []
    for line, paths in sorted(headers.items()):
        raw = read.schema(", ".join(f"`{c}` string" for c in next(csv.reader([line])))).csv(sorted(paths))
        parts.append(raw.select(*(F.col(f"`{c}`").cast(t).alias(c) for c, t in METADATA.items())))
    return reduce(DataFrame.unionByName, parts)


def read_metadata(spark: SparkSession, folder: str, pattern: str = "p[0-9]*.csv") -> DataFrame:
    """The per-problem CSV files of a folder; each file may order its columns its own way.

    Executors list the files and read their first lines; files of one header are read together.
    """
    headers: dict[str, list[str]] = {}
    for row in list_tree(spark, folder, pattern, "path string, length long, head string").where("length > 0").collect():
        headers.setdefault(row["head"], []).append(f"{folder.rstrip('/')}/{row['path']}")
    if not headers:
        raise FileNotFoundError(f"no {pattern} in {folder}")
    return metadata_files(spark, headers)


def read_dimension(spark: SparkSession, path: str, columns: dict[str, str]) -> DataFrame:
    raw = spark.read.option("header", True).csv(path)
    return raw.select(*(F.col(c).cast(t).alias(c) for c, t in columns.items()))


def read_files(spark: SparkSession, folder: str, pattern: str = "*.cpp") -> DataFrame:
    """(path relative to the folder, length, content) of all files below it, empty ones too."""
    return read_tree(spark, folder, pattern)


def read_lines(spark: SparkSession, path: str, name: str = "archive_path") -> DataFrame:
    """Distinct non-empty lines of a text file."""
    return spark.read.text(path).where("value <> ''").select(F.col("value").alias(name)).distinct()


def load_config(path: str | Path) -> dict[str, Any]:
    """A YAML file at a local path or URI; FileNotFoundError if there is none."""
    import yaml

    system, place = opened(str(path))
    if not system.get_file_info(place).is_file:
        raise FileNotFoundError(f"no config at {path}")
    with system.open_input_stream(place, compression=None) as stream:
        return yaml.safe_load(stream.read().decode("utf-8"))


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)


def write_report(df: DataFrame, path: str) -> None:
    """A small table as one CSV file with a header."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_lines(df: DataFrame, column: str, path: str) -> None:
    df.select(F.col(column).cast("string")).write.mode("overwrite").text(path)


def write_config(config: dict[str, Any], path: str | Path) -> None:
    """A JSON file at a local path or URI."""
    system, place = opened(str(path))
    system.create_dir(place.rpartition("/")[0] or ".")
    with system.open_output_stream(place, compression=None) as stream:
        stream.write(json.dumps(config, indent=2).encode("utf-8"))


def copy_file(spark: SparkSession, src: str, dst: str) -> None:
    """One file from and to any file system that Spark reaches."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    conf = spark._jsc.hadoopConfiguration()
    a, b = hadoop.Path(src), hadoop.Path(dst)
    hadoop.FileUtil.copy(a.getFileSystem(conf), a, b.getFileSystem(conf), b, False, True, conf)
