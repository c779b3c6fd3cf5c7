"""Session defaults."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "lakeloom", **conf: str) -> SparkSession:
    """A session with adaptive execution, ANSI arithmetic and UTC times; ``conf`` wins over these."""
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    return SparkSession.builder.appName(name).config(map=base | conf).getOrCreate()
