"""Guards: observed on a plan that runs anyway, or eager ones that run a job; they raise when the data break a promise."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def require_columns(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise KeyError(f"missing columns: {missing}")


def assert_unique(df: DataFrame, *keys: str) -> None:
    if not df.groupBy(*keys).count().where("count > 1").isEmpty():
        raise AssertionError(f"{keys} is not unique")


def assert_no_nulls(df: DataFrame, *names: str) -> None:
    row = df.agg(*(F.count_if(F.col(n).isNull()).alias(n) for n in names)).first()
    bad = {n: row[n] for n in names if row[n]}
    if bad:
        raise AssertionError(f"nulls found: {bad}")


def assert_count(df: DataFrame, expected: int) -> None:
    if (n := df.count()) != expected:
        raise AssertionError(f"{n} rows, expected {expected}")


def assert_distribution(df: DataFrame, column: str, expected: dict[str, int]) -> None:
    found = {r[column]: r["count"] for r in df.groupBy(column).count().limit(len(expected) + 1).collect()}
    if found != expected:
        raise AssertionError(f"{column}: {found}, expected {expected}")


class Guards:
    """Promises on the rows of a plan, counted while it runs: no job or pass of their own.

    ``watch(df)`` gives the rows to write; once they are written, ``metrics()`` has what was counted
    and ``verify()`` raises one AssertionError that names every broken promise. ``rows`` is always
    counted. What needs rows of a key together (uniqueness, splits that share a key) cannot be observed.
    """

    def __init__(self, name: str = "guards"):
        self.name = name
        self._counts: dict[str, Column] = {"rows": F.count(F.lit(1))}
        self._promised: dict[str, int] = {}
        self._observed: Observation | None = None

    def count(self, metric: str, condition: Column, promised: int | None = None) -> Guards:
        """Counts the rows that meet a condition; ``promised`` is how many there have to be."""
        if metric in self._counts:
            raise ValueError(f"{metric} is counted already")
        self._counts[metric] = F.count_if(condition)
        if promised is not None:
            self._promised[metric] = promised
        return self

    def rows(self, promised: int) -> Guards:
        self._promised["rows"] = promised
        return self

    def no_nulls(self, *names: str) -> Guards:
        for n in names:
            self.count(f"{n}_null", F.col(n).isNull(), 0)
        return self

    def values(self, column: str, allowed: Mapping[Any, int | None] | tuple) -> Guards:
        """A column holds no other values than ``allowed`` (nulls aside), each as often as promised where a number is given."""
        promised = dict(allowed) if isinstance(allowed, Mapping) else dict.fromkeys(allowed)
        for value, n in promised.items():
            self.count(f"{column}={value}", F.col(column) == value, n)
        return self.count(f"{column}_other", ~F.col(column).isin(list(promised)), 0)

    def watch(self, df: DataFrame) -> DataFrame:
        self._observed = Observation(self.name)
        return df.observe(self._observed, *(c.alias(m) for m, c in self._counts.items()))

    def metrics(self) -> dict[str, int]:
        """The counts; waits for the watched plan to run."""
        if self._observed is None:
            raise ValueError("no rows are watched")
        return dict(self._observed.get)

    def verify(self) -> dict[str, int]:
        found = self.metrics()
        if broken := {m: found[m] for m in self._counts if found[m] != self._promised.get(m, found[m])}:
            raise AssertionError("; ".join(f"{m} is {n}, promised {self._promised[m]}" for m, n in broken.items()))
        return found


def reconciliation(wanted: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """Keys on one side only: (key, side) with side ``missing`` or ``extra``."""
    a, b = wanted.select(key).distinct(), present.select(key).distinct()
    missing = a.join(b, key, "left_anti").withColumn("side", F.lit("missing"))
    return missing.unionByName(b.join(a, key, "left_anti").withColumn("side", F.lit("extra")))


def byte_check(manifest: DataFrame, files: DataFrame, key: str, size_col: str = "code_size", length_col: str = "length") -> DataFrame:
    """Per manifest row its size on disk less the recorded one."""
    return manifest.select(key, size_col).join(files.select(key, length_col), key, "left").withColumn("diff", F.col(length_col) - F.col(size_col))


def byte_check_summary(checked: DataFrame) -> DataFrame:
    d = F.col("diff")
    return checked.agg(F.count("diff").alias("compared"), F.avg((d == 0).cast("double")).alias("equal_share"), F.min("diff").alias("least"), F.max("diff").alias("most"))


def worst_byte_diffs(checked: DataFrame, key: str, n: int = 5) -> DataFrame:
    return checked.where("diff is not null").orderBy(F.desc(F.abs("diff")), key).limit(n)
