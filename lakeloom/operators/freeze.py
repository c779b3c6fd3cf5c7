"""The record of a run: seeds, counts, findings and a digest of the result."""

from __future__ import annotations

from datetime import UTC, datetime
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, MapType, StructType, TimestampType, VariantType

from lakeloom import vocab

LANES = 4  # of 64 bits in a row's hash
DIGEST = "sha256 over the number of rows and the sums, modulo 2^64, of the four 64-bit lanes of their sha256"


def _cell(column: str, kind: DataType) -> Column:
    """A value as text that tells it from null and from its neighbours, whatever the session's time zone."""
    value = F.col(f"`{column}`")
    if isinstance(kind, BinaryType):
        value = F.hex(value)
    elif isinstance(kind, TimestampType):
        value = F.unix_micros(value)
    elif isinstance(kind, StructType | ArrayType | MapType | VariantType):
        value = F.to_json(value)
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def content_digests(df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, rows, digest): a digest of each group's rows as a multiset, which no file layout, partition or row order changes.

    Lanes of the row hashes are summed up, so a task holds a few numbers a group, and sums of parts
    add up to the sum of the whole; a row that is there twice counts twice.
    """
    row = F.sha2(F.concat(*(_cell(f.name, f.dataType) for f in sorted(df.schema, key=lambda f: f.name) if f.name not in by), F.lit("")), 256)
    lanes = [F.conv(F.substring("_row", 16 * k + 1, 16), 16, 10).cast("decimal(28,0)") for k in range(LANES)]
    sums = df.select(*by, row.alias("_row")).groupBy(*by).agg(F.count("*").alias("rows"), *(F.sum(lane).alias(f"_{k}") for k, lane in enumerate(lanes)))
    wrapped = [(F.coalesce(F.col(f"_{k}"), F.lit(0).cast("decimal(38,0)")) % F.lit(str(2**64)).cast("decimal(20,0)")).cast("decimal(20,0)").cast("string") for k in range(LANES)]
    return sums.select(*by, "rows", F.sha2(F.concat_ws(":", F.col("rows").cast("string"), *wrapped), 256).alias("digest"))


def content_digest(df: DataFrame) -> str:
    """The digest of a whole table."""
    return content_digests(df).first()["digest"]


def freeze_config(final: DataFrame, *, seed: int = vocab.SEED, row_counts: dict[str, int], findings: dict[str, Any], now: datetime | None = None) -> dict[str, Any]:
    """Everything needed to draw the corpus again and to check it; counts and findings are measured, not literals."""
    return {
        "generated_at_utc": (now or datetime.now(UTC)).isoformat(),
        "taxonomy_version": vocab.TAXONOMY_VERSION,
        "split": {"method": "group_split", "seed": seed, "ratios": vocab.RATIOS},
        "comparison_split": {"method": "random_split", "seed": seed, "note": "leaks on purpose; shows what group splits avoid"},
        "sampling": {"method": "round robin over groups", "seed": seed, "class_totals": vocab.CLASS_TOTALS},
        "dedup": {"method": "sha256 of normalised bytes"},
        "row_counts": row_counts,
        "findings": findings,
        "artifact_digest": {"algorithm": DIGEST, "value": content_digest(final)},
    }
