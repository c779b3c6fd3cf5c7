"""Folders and written tables that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; on one machine, if it is unset, one below the warehouse."""
    if folder := spark.conf.get(SETTING, None):
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError(f"{SETTING} must name a folder that driver and executors share")
    spark.conf.set(SETTING, f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/.scratch")
    return spark.conf.get(SETTING)


def new_folder(spark: SparkSession, name: str) -> str:
    """A new name below the shared folder; what is written there goes when the JVM ends."""
    folder = f"{shared_folder(spark)}/lakeloom/{name}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return folder


def written(df: DataFrame, name: str) -> DataFrame:
    """``df``, written once: what reads it neither computes it again nor needs the executors that did."""
    folder = new_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def fresh(columns: list[str], *names: str) -> list[str]:
    """Names like ``names`` that no column has, whatever its case."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
