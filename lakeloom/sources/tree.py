"""File trees: listed and read by executors folder by folder, and written with a commit."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from fnmatch import fnmatchcase

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from lakeloom.sources.attempts import HIDDEN, AttemptWriter
from lakeloom.sources.files import below, children, first_line, inside, opened

LISTED = "path string, length long"
MOST_PARTS = 4_096  # partitions that a tree's first folders are dealt to, times ``shares``
SHARES = 2  # tasks that share a folder: each lists it and reads its share
BATCH_BYTES, BATCH_ROWS = 16 << 20, 4_096


class Part(InputPartition):
    """The files of some folders (the tree's own, where a name is empty) whose hash is of one share."""

    def __init__(self, folders: list[str], share: int):
        super().__init__((folders, share))


class TreeReader(DataSourceReader):
    """Columns path (relative), length, content and head (the first line); files are opened for the last two only."""

    def __init__(self, options: dict[str, str], schema: StructType):
        self.uri, self.pattern = options["path"], options.get("pattern", "*")
        self.shares = int(options.get("shares", SHARES))
        self.schema = to_arrow_schema(schema)

    def partitions(self) -> list[InputPartition]:
        """The driver sees the names in the tree's first folder, no others."""
        system, root = opened(self.uri)
        folders = ["", *(i.base_name for i in children(system, root) if not i.is_file and not i.base_name.startswith(HIDDEN))]
        parts = min(len(folders), MOST_PARTS)
        return [Part(folders[k::parts], share) for k in range(parts) for share in range(self.shares)]

    def _found(self, partition: InputPartition) -> Iterator[tuple]:
        system, root = opened(self.uri)
        folders, share = partition.value
        for folder in folders:
            found = below(system, f"{root}/{folder}") if folder else (i for i in children(system, root) if i.is_file)
            for info in found:
                path = info.path[len(root) + 1 :]
                if fnmatchcase(info.base_name, self.pattern) and zlib.crc32(path.encode("utf-8", "surrogateescape")) % self.shares == share:
                    yield system, info, path

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        names, rows, size = self.schema.names, [], 0
        for system, info, path in self._found(partition):
            row = {"path": path, "length": info.size}
            if "content" in names:
                with system.open_input_stream(info.path, compression=None) as stream:
                    row["content"] = stream.read()
            if "head" in names:
                row["head"] = first_line(system, info.path)
            rows.append(row)
            size += len(row.get("content", b""))
            if size >= BATCH_BYTES or len(rows) >= BATCH_ROWS:
                yield self._batch(rows)
                rows, size = [], 0
        if rows:
            yield self._batch(rows)

    def _batch(self, rows: list[dict]) -> pa.RecordBatch:
        return pa.record_batch([pa.array([r[f.name] for r in rows], f.type) for f in self.schema], schema=self.schema)


class TreeWriter(AttemptWriter):
    """A file for each row of (path, content)."""

    def put(self, system, folder: str, batches: Iterator[pa.RecordBatch]) -> tuple[int, int]:
        files = size = 0
        made, written = set(), set()
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                path = inside(path or "")
                if path in written:
                    raise ValueError(f"{path!r} is written twice")
                written.add(path)
                target = f"{folder}/{path}"
                if (parent := target.rpartition("/")[0]) not in made:
                    system.create_dir(parent)
                    made.add(parent)
                with system.open_output_stream(target, compression=None) as stream:
                    stream.write(content or b"")
                files, size = files + 1, size + len(content or b"")
        return files, size


class TreeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "filetree"

    def schema(self) -> str:
        return f"{LISTED}, content binary"

    def reader(self, schema: StructType) -> DataSourceReader:
        return TreeReader(dict(self.options), schema)

    def writer(self, schema: StructType, overwrite: bool) -> AttemptWriter:
        return TreeWriter(self.options["path"])


def list_tree(spark: SparkSession, folder: str, pattern: str = "*", columns: str = LISTED) -> DataFrame:
    """Files below a folder, empty ones too, by base name; the columns asked for decide whether they are opened."""
    spark.dataSource.register(TreeSource)
    return spark.read.format("filetree").schema(columns).option("pattern", pattern).load(folder)


def read_tree(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path relative to the folder, length, content) of all files below it."""
    return list_tree(spark, folder, pattern, f"{LISTED}, content binary")


def write_tree(files: DataFrame, folder: str, path_col: str = "path", content_col: str = "content") -> None:
    """Each row's content as a file below a folder that driver and executors share; null is an empty file.

    Tasks write into attempt folders. When all have ended the driver moves those that count into
    place, replacing files of earlier jobs; until then, and if a task fails for good, the folder has
    none of the new files. Two rows of one path, or a path that leaves the folder, fail the job.
    """
    files.sparkSession.dataSource.register(TreeSource)
    rows = files.select(F.col(path_col).cast("string").alias("path"), F.col(content_col).cast("binary").alias("content"))
    rows.write.format("filetree").mode("append").save(folder)
