"""Exact quantiles by order statistics: values are counted, ranked by range, and only those at wanted places are kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeloom.functions.ordering import running


def counted_values(df: DataFrame, column: str, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, value, n): how often each group has each value, nulls aside; partial counts are made before the shuffle."""
    return df.where(F.col(column).isNotNull()).groupBy(*by, F.col(column).alias("value")).agg(F.count("*").alias("n"))


def order_statistics(counted: DataFrame, points: tuple[float, ...], by: tuple[str, ...] = ()) -> DataFrame:
    """(by, quantiles) of a table (by, value, n), one entry a point, between two values by their distance.

    Counts are summed up by range of (group, value), so neither a group of any size nor its distinct
    values meet in one task or buffer; per point at most two values of a group go on.
    """
    if bad := [p for p in points if not 0 <= p <= 1]:
        raise ValueError(f"points are from 0 to 1, not {bad}")
    if not points:
        raise ValueError("no points")
    placed = running(counted.select(*by, "value", "n"), list(by), ["value"], "_upto", "_all", "n")
    at = [F.lit(float(p)) * (F.col("_all") - 1) for p in points]
    here = lambda place: (place >= F.col("_upto") - F.col("n")) & (place < F.col("_upto"))
    ends = [end for a in at for end in (F.floor(a), F.ceil(a))]
    wanted = here(ends[0])
    for end in ends[1:]:
        wanted = wanted | here(end)
    held = lambda end, name: F.max(F.when(here(end), F.col("value").cast("double"))).alias(name)
    found = placed.where(wanted).groupBy(*by).agg(F.max("_all").alias("_all"), *(held(end, f"_{k}") for k, end in enumerate(ends)))

    def between(k: int) -> Column:
        low, high = F.col(f"_{2 * k}"), F.col(f"_{2 * k + 1}")
        return F.when(low == high, low).otherwise((ends[2 * k + 1] - at[k]) * low + (at[k] - ends[2 * k]) * high)

    return found.select(*by, F.array(*(between(k) for k in range(len(points)))).alias("quantiles"))


def quantiles(df: DataFrame, column: str, points: tuple[float, ...], by: tuple[str, ...] = ()) -> DataFrame:
    """(by, quantiles) of a numeric column; groups without a value have no row."""
    return order_statistics(counted_values(df, column, by), points, by)
