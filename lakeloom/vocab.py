"""Frozen vocabularies and the small dimension tables made of them."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Names, order and numbers of the label contract.
TAXONOMY_VERSION = "1.0"
COARSE = ("ERROR_FREE", "COMPILE_ERROR", "RUNTIME_ERROR", "LOGICAL")
LEAVES = (  # leaf, parent, tier
    ("ERROR_FREE", "ERROR_FREE", 1),
    ("SYNTAX", "COMPILE_ERROR", 2),
    ("SEMANTIC", "COMPILE_ERROR", 2),
    ("LINKER", "COMPILE_ERROR", 2),
    ("SIGSEGV", "RUNTIME_ERROR", 3),
    ("SIGFPE", "RUNTIME_ERROR", 3),
    ("SIGABRT", "RUNTIME_ERROR", 3),
    ("NZEC", "RUNTIME_ERROR", 3),
    ("LOGICAL", "LOGICAL", 1),
)
VERDICTS = (  # verdict, coarse class, discard reason
    ("Accepted", "ERROR_FREE", None),
    ("Wrong Answer", "LOGICAL", None),
    ("Compile Error", "COMPILE_ERROR", None),
    ("Runtime Error", "RUNTIME_ERROR", None),
    ("Time Limit Exceeded", None, "EFFICIENCY_CONSTRAINT"),
    ("Memory Limit Exceeded", None, "EFFICIENCY_CONSTRAINT"),
    ("Output Limit Exceeded", None, "EFFICIENCY_CONSTRAINT"),
    ("Query Limit Exceeded", None, "EFFICIENCY_CONSTRAINT"),
    ("WA: Presentation Error", None, "OUTPUT_FORMAT"),
    ("Judge Not Available", None, "JUDGE_INFRASTRUCTURE"),
    ("Internal error", None, "JUDGE_INFRASTRUCTURE"),
    ("Judge System Error", None, "JUDGE_INFRASTRUCTURE"),
)
POOL_TIERS = (  # verdict, tier and target classes of the candidate pool report
    ("Accepted", "Tier 1", "ERROR-FREE"),
    ("Wrong Answer", "Tier 1", "LOGICAL"),
    ("Compile Error", "Tier 2", "SYNTAX / SEMANTIC / LINKER"),
    ("Runtime Error", "Tier 3", "SIGSEGV / SIGFPE / SIGABRT / NZEC"),
)
SPLITS = ("train", "val", "test")
RATIOS = {"train": 0.6, "val": 0.2, "test": 0.2}
CLASS_TOTALS = {"ERROR_FREE": 10_000, "COMPILE_ERROR": 30_000, "RUNTIME_ERROR": 25_000, "LOGICAL": 10_000}
SERVING_CLASSES = ("clean", "compilation_error", "runtime_error", "time_limit_exceeded", "memory_limit_exceeded", "wrong_answer")
SEED = 42
TOKEN_BUDGET_BYTES = 1792  # int(512 * 3.5)


class UnknownVerdictError(ValueError):
    """A verdict outside of the vocabulary."""


_OUTCOME = {verdict: (coarse, reason) for verdict, coarse, reason in VERDICTS}
_LEAF = {leaf: (k, parent, tier) for k, (leaf, parent, tier) in enumerate(LEAVES)}


def classify(verdict: str) -> str:
    """The coarse class of a kept verdict or the reason that a known one is discarded; exact match only."""
    if verdict not in _OUTCOME:
        raise UnknownVerdictError(f"unknown verdict: {verdict!r}")
    return next(x for x in _OUTCOME[verdict] if x)


def is_kept(verdict: str) -> bool:
    return classify(verdict) in COARSE


def coarse_class_of(verdict: str) -> str:
    outcome = classify(verdict)
    if outcome not in COARSE:
        raise ValueError(f"{verdict!r} is discarded: {outcome}")
    return outcome


def check_verdicts(verdicts: Iterable[str]) -> None:
    """Raises with all unknown verdicts, sorted, and their number."""
    unknown = sorted(set(verdicts) - _OUTCOME.keys())
    if unknown:
        raise UnknownVerdictError(f"{len(unknown)} unknown verdict(s): {unknown}")


def coarse_id(name: str) -> int:
    if name not in COARSE:
        raise ValueError(f"unknown coarse class: {name!r}")
    return COARSE.index(name)


def _leaf(name: str) -> tuple[int, str, int]:
    if name not in _LEAF:
        raise ValueError(f"unknown leaf class: {name!r}")
    return _LEAF[name]


def leaf_id(name: str) -> int:
    return _leaf(name)[0]


def to_coarse(name: str) -> str:
    return _leaf(name)[1]


def is_terminal(name: str) -> bool:
    """A leaf that is its own parent."""
    return _leaf(name)[1] == name


def leaves_for_tier(tier: int) -> tuple[str, ...]:
    """Leaves that labels up to a tier can name."""
    if tier not in (1, 2, 3):
        raise ValueError(f"tier must be 1, 2 or 3, not {tier!r}")
    return tuple(leaf for leaf, _, t in LEAVES if t <= tier)


def dim_verdict(spark: SparkSession) -> DataFrame:
    rows = [(v, c, r, c is not None) for v, c, r in VERDICTS]
    return spark.createDataFrame(rows, "status string, coarse_label string, discard_reason string, kept boolean")


def dim_leaf(spark: SparkSession) -> DataFrame:
    rows = [(k, leaf, parent, COARSE.index(parent), tier, leaf == parent) for k, (leaf, parent, tier) in enumerate(LEAVES)]
    return spark.createDataFrame(rows, "leaf_id int, leaf string, coarse_label string, coarse_id int, tier int, terminal boolean")


def dim_pool(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, *row) for k, row in enumerate(POOL_TIERS)], "ord int, status string, tier string, target_classes string")


def ordinal(name: Column, values: tuple[str, ...]) -> Column:
    """Place of a name in a declared order, as an integer to sort by; null if it has none."""
    place = F.array_position(F.array(*map(F.lit, values)), name).cast("int")
    return F.when(place > 0, place - 1)
