"""Metadata files that come in over time: each is read once, whatever fails in between."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lakeloom.sources.files import first_line, opened
from lakeloom.sources.readers import METADATA, metadata_files

FOUND = "path string, modificationTime timestamp, length long, content binary"
FILES_A_BATCH = 500


def _heads(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        paths = batch.column(0).to_pylist()
        yield pa.record_batch([pa.array(paths, pa.string()), pa.array([first_line(*opened(p)) for p in paths], pa.string())], ["path", "head"])


def append_new_metadata(spark: SparkSession, folder: str, target: str, checkpoint: str, pattern: str = "p[0-9]*.csv", files_a_batch: int = FILES_A_BATCH) -> int:
    """Adds the files that no earlier run has read to the Parquet table at ``target``; the number of batches.

    A file stream remembers what it has read. Every batch is a folder of its own, written over if it
    is run again, so a file lands once even if a run breaks off after writing. Only names of new files
    pass through the driver; their contents are not read to find them.
    """
    batches = 0

    def land(batch: DataFrame, number: int) -> None:
        nonlocal batches
        headers: dict[str, list[str]] = {}
        for row in batch.mapInArrow(_heads, "path string, head string").collect():
            if row["head"]:
                headers.setdefault(row["head"], []).append(row["path"])
        if headers:
            rows = metadata_files(batch.sparkSession, headers)
            rows.write.mode("overwrite").option("compression", "zstd").parquet(f"{target.rstrip('/')}/batch={number}")
        batches += 1

    found = spark.readStream.format("binaryFile").schema(FOUND).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_a_batch).load(folder).where("length > 0").select("path")
    query = found.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return batches


def landed_metadata(spark: SparkSession, target: str) -> DataFrame:
    """All rows that have landed."""
    schema = ", ".join(f"{c} {t}" for c, t in METADATA.items())
    return spark.read.schema(f"{schema}, batch long").parquet(target).select(*METADATA)
