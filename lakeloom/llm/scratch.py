"""Tables written to the shared folder, to cut lineage so that a lost executor costs one stage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_BYTES = 12 << 20  # of a written table, up to which it is broadcast
#: Settings of a write: shuffle files go when it has ended, and Python workers are given batches of some bytes, not rows.
WRITES = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; executors must share it, so nothing stands in for it on a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if spark.sparkContext.master.startswith("local["):  # one machine: a folder of the session's own
        folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/.scratch"
        spark.conf.set("spark.checkpoint.dir", folder)
        return folder
    raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")


class Scratch:
    """Writes intermediate tables under one folder of its own; the JVM deletes the folder at its end."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark).rstrip('/')}/lakeloom/{name}-{uuid.uuid4().hex}"
        self.fs_path = spark._jvm.org.apache.hadoop.fs.Path
        path = self.fs_path(self.root)
        self.fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        self.fs.deleteOnExit(path)

    def keep(self, df: DataFrame, name: str, partition_by: str | None = None, hashes: bool = False) -> DataFrame:
        """Write ``df`` once and read it back: later users neither recompute it nor depend on executors' disks.

        The shuffle files of the write go when it has ended. ``hashes``: dictionaries of its values would not pay.
        """
        before = {k: self.spark.conf.get(k, None) for k in WRITES}
        for k, v in WRITES.items():
            self.spark.conf.set(k, v)
        try:
            writer = df.write.mode("overwrite")
            if hashes:
                writer = writer.option("parquet.enable.dictionary", "false")
            if partition_by:
                writer = writer.partitionBy(partition_by)
            writer.parquet(f"{self.root}/{name}")
        finally:
            for k, v in before.items():
                self.spark.conf.set(k, v) if v else self.spark.conf.unset(k)
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def size(self, name: str) -> int:
        """Bytes of a kept table."""
        return self.fs.getContentSummary(self.fs_path(f"{self.root}/{name}")).getLength()

    def small(self, df: DataFrame, name: str, most: int = BROADCAST_BYTES) -> DataFrame:
        """``df``, made from the kept table ``name``, to be broadcast if that table has at most ``most`` bytes."""
        return F.broadcast(df) if self.size(name) <= most else df

    def drop(self, *names: str) -> None:
        for name in names:
            self.fs.delete(self.fs_path(f"{self.root}/{name}"), True)
