"""Gzip-compressed tar archives: members as rows, with predicates on names pushed down, and archives as a sink.

A gzip stream can only be read forward, so an archive is one input partition; several archives
are read side by side. Reading ends at the last wanted member where their names are known.
"""

from __future__ import annotations

import io
import tarfile
import time
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringContains, StringEndsWith, StringStartsWith
from pyspark.sql.types import StructType

from lakeloom.functions.content import strip_prefix
from lakeloom.sources.attempts import AttemptWriter
from lakeloom.sources.files import children, opened

LISTED = "name string, size long, regular boolean, scanned long, bytes_seen long"
SCHEMA = f"{LISTED}, content binary"
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
ENDING = ".tar.gz"


class _Archive(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)


class TarReader(DataSourceReader):
    """Members that pass the pushed predicates; content is read only if the schema has it.

    With ``wanted`` names, or names pushed down as ``=`` or ``IN``, each is given once, at its first
    place, and an archive is read no further than to the last of them.
    """

    def __init__(self, options: dict[str, str], schema: StructType):
        self.paths = [p for p in options["path"].split(",") if p]
        self.wanted = frozenset(x for x in options.get("wanted", "").split("\n") if x) if "wanted" in options else None
        self.most = int(options.get("mostfound", 0) or 0)
        self.columns = schema.fieldNames()
        self.tests: list[tuple[str, str]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if getattr(f, "attribute", None) != ("name",):
                yield f
            elif isinstance(f, EqualTo | In):
                names = frozenset(f.value if isinstance(f, In) else [f.value])
                self.wanted = names if self.wanted is None else self.wanted & names
            elif isinstance(f, StringStartsWith | StringEndsWith | StringContains):
                self.tests.append((type(f).__name__, f.value))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        """An archive each; of a folder, those in it."""
        out = []
        for uri in self.paths:
            system, path = opened(uri)
            if system.get_file_info(path).is_file:
                out.append(uri)
            else:
                out += [f"{uri.rstrip('/')}/{i.base_name}" for i in children(system, path) if i.is_file and i.base_name.endswith(ENDING)]
        return [_Archive(p) for p in out]

    def _passes(self, name: str) -> bool:
        test: dict[str, Callable[[str], bool]] = {"StringStartsWith": name.startswith, "StringEndsWith": name.endswith, "StringContains": name.__contains__}
        return all(test[kind](value) for kind, value in self.tests)

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        found: set[str] = set()
        scanned = seen = 0
        goal = self.most or (len(self.wanted) if self.wanted is not None else -1)
        if not goal:
            return
        system, path = opened(partition.value)
        with system.open_input_stream(path, compression=None) as stream, tarfile.open(fileobj=stream, mode="r|gz") as tar:
            for member in tar:
                scanned += 1
                seen += member.size
                if self.wanted is not None and (member.name not in self.wanted or member.name in found) or not self._passes(member.name):
                    continue
                row = {"name": member.name, "size": member.size, "regular": member.isfile(), "scanned": scanned, "bytes_seen": seen}
                if "content" in self.columns:
                    row["content"] = tar.extractfile(member).read() if member.isfile() else None
                yield tuple(row[c] for c in self.columns)
                if member.isfile() or self.most:
                    found.add(member.name)
                if len(found) == goal:
                    return


class TarWriter(AttemptWriter):
    """An archive for each task, with a member for each row of (name, content); numbered when the job commits."""

    def put(self, system, folder: str, batches: Iterator[pa.RecordBatch]) -> tuple[int, int]:
        files = size = 0
        with system.open_output_stream(f"{folder}/archive{ENDING}", compression=None) as stream, tarfile.open(fileobj=stream, mode="w|gz", compresslevel=3) as tar:
            for batch in batches:
                for name, content in zip(batch.column("name").to_pylist(), batch.column("content").to_pylist(), strict=True):
                    member = tarfile.TarInfo(name)
                    member.size = len(content or b"")
                    tar.addfile(member, io.BytesIO(content or b""))
                    files, size = files + 1, size + member.size
        return files, size

    def staged_name(self, attempt: int, name: str) -> str:
        return f"part-{self.job[-8:]}-{attempt:05d}{ENDING}"


class TarSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "targz"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return TarReader(dict(self.options), schema)

    def writer(self, schema: StructType, overwrite: bool) -> AttemptWriter:
        return TarWriter(self.options["path"])


def read_members(spark: SparkSession, path: str, wanted: list[str] | None = None, most_found: int = 0, content: bool = True, where: Column | None = None) -> DataFrame:
    """Members of an archive, or of all in a folder, with how many were scanned and how many bytes seen up to each.

    ``where`` is a condition on ``name``, whose comparisons are pushed down to the reader; without
    ``content`` no member is unpacked. ``wanted`` holds the names to read (a list that one task can
    hold); ``most_found`` ends the pass early.

    Spark keeps the pushed predicates with the loaded relation, where a later plan of the same frame
    would meet them. So each call loads one of its own, and names are handed on through an expression
    that is not pushed: conditions that callers add are applied by Spark.
    """
    spark.dataSource.register(TarSource)
    if spark.conf.get(PUSHDOWN, "false") != "true":
        spark.conf.set(PUSHDOWN, "true")
    reader = spark.read.format("targz").schema(SCHEMA if content else LISTED).option("mostFound", most_found)
    if wanted is not None:
        reader = reader.option("wanted", "\n".join(wanted))
    loaded = reader.load(path)
    told = loaded if where is None else loaded.where(where)
    return told.select(F.concat("name", F.lit("")).alias("name"), *loaded.columns[1:])


def write_archives(members: DataFrame, folder: str) -> None:
    """(name, content) rows as archives in a folder, one a partition, all there or none."""
    members.sparkSession.dataSource.register(TarSource)
    members.select(F.col("name").cast("string").alias("name"), F.col("content").cast("binary").alias("content")).write.format("targz").mode("append").save(folder)


def extraction(spark: SparkSession, path: str, wanted: list[str], prefix: str) -> tuple[DataFrame, DataFrame]:
    """(files, report): wanted regular members by path without ``prefix``; counts, with the shortfall.

    A name counts once: each archive gives it once, and the report counts different names.
    """
    members = read_members(spark, path, wanted)
    files = members.where("regular").select(strip_prefix(F.col("name"), prefix).alias("path"), F.col("size").alias("length"), "content")
    goal = len(set(wanted))
    listed = read_members(spark, path, wanted, content=False).groupBy("name").agg(F.max("regular").alias("regular"), F.max("scanned").alias("scanned"), F.max(F.when(F.col("regular"), F.col("size"))).alias("size"))
    got = F.count_if("regular")
    report = listed.agg(F.lit(goal).cast("long").alias("wanted"), got.alias("extracted"), (F.lit(goal) - got).alias("shortfall"), F.count_if(~F.col("regular")).alias("not_regular"), F.coalesce(F.max("scanned"), F.lit(0)).alias("members_scanned"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes_written"))
    return files, report


def dry_run(spark: SparkSession, path: str, wanted: list[str], archive_bytes: int, fraction: float = 0.01) -> DataFrame:
    """A timed pass that ends at ``fraction`` of the wanted members, with both projections for a full pass.

    The pass runs here. ``reached`` says whether the archive held as many wanted members.
    """
    goal = max(1, int(len(set(wanted)) * fraction))
    began = time.perf_counter()
    seen = read_members(spark, path, wanted, goal).agg(F.count("*").alias("found"), F.max("scanned").alias("members"), F.max("bytes_seen").alias("bytes")).first()
    took = time.perf_counter() - began
    row = (goal, seen.found, seen.found >= goal, seen.members or 0, seen.bytes or 0, took, (seen.members or 0) / took, took / fraction, archive_bytes * took / seen.bytes if seen.bytes else None)
    return spark.createDataFrame([row], "target long, found long, reached boolean, members_scanned long, bytes_seen long, elapsed_s double, members_per_s double, linear_projection_s double, rate_projection_s double")
