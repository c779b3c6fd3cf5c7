"""Batch prediction through a pluggable predictor."""

from __future__ import annotations

from typing import Any, Protocol, runtime_checkable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeloom.vocab import SERVING_CLASSES

MOST_CHARS = 50_000


@runtime_checkable
class Predictor(Protocol):
    """Gives a distribution over the serving classes as a column."""

    name: str
    is_placeholder: bool

    def probabilities(self, row_id: Column, code: Column) -> Column:
        """array<double> with sum 1, in the order of the serving classes."""
        ...


class RandomPredictor:
    """A placeholder: scores follow from the seed and the row's id, so they do not depend on partitions."""

    name = "dummy-random-v1"
    is_placeholder = True

    def __init__(self, seed: int | None = None):
        self.seed = 0 if seed is None else seed

    def probabilities(self, row_id: Column, code: Column) -> Column:
        drawn = lambda k: F.conv(F.substring(F.md5(F.concat(F.lit(f"{self.seed}:"), row_id.cast("string"), F.lit(f":{k}"))), 1, 8), 16, 10).cast("long")
        scores = F.array(*((drawn(k) % 1_000_003 + 1).cast("double") for k in range(len(SERVING_CLASSES))))
        total = F.aggregate(scores, F.lit(0.0), lambda a, x: a + x)
        return F.transform(scores, lambda x: x / total)


def build_predictor(config: dict[str, Any]) -> Predictor:
    kind = config.get("type", "dummy")
    if kind == "dummy":
        return RandomPredictor(config.get("seed"))
    raise ValueError(f"unknown predictor type: {kind!r}; there is 'dummy'")


def valid_request(code: Column) -> Column:
    return F.coalesce(F.char_length(code).between(1, MOST_CHARS), F.lit(False))


def assert_valid_requests(df: DataFrame, code_col: str = "code") -> None:
    if bad := df.where(~valid_request(F.col(code_col))).count():
        raise ValueError(f"{bad} request(s) have no code or more than {MOST_CHARS} characters")


def predict(df: DataFrame, predictor: Predictor, id_col: str, code_col: str = "code") -> DataFrame:
    """(id, prediction) of the valid requests; the first of equal probabilities wins."""
    rows = df.where(valid_request(F.col(code_col))).select(id_col, predictor.probabilities(F.col(id_col), F.col(code_col)).alias("p"))
    labels = F.array(*map(F.lit, SERVING_CLASSES))
    winner = F.array_position("p", F.array_max("p")).cast("int")
    listed = F.zip_with(labels, F.col("p"), lambda label, p: F.struct(label.alias("label"), p.alias("probability")))
    return rows.select(id_col, F.struct(F.get(labels, winner - 1).alias("predicted_class"), F.array_max("p").alias("confidence"), listed.alias("probabilities"), F.lit(predictor.name).alias("model_name"), F.lit(predictor.is_placeholder).alias("is_placeholder")).alias("prediction"))


def health(predictor: Predictor) -> dict[str, Any]:
    return {"status": "ok", "model_name": predictor.name, "num_classes": len(SERVING_CLASSES)}
