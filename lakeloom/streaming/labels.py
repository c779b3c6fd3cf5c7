"""Row-wise operators on streams: labelling and prediction hold no state and run unchanged."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.operators.inference import Predictor, predict
from lakeloom.operators.labeling import labeled_manifest, with_outcome


def label_stream(stream: DataFrame) -> DataFrame:
    """Kept submissions of a stream with their class."""
    return labeled_manifest(stream)


def verdicts_by_window(stream: DataFrame, time_col: str, window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Counts of outcomes by event time; rows later than ``late`` are left out and state is dropped then."""
    timed = with_outcome(stream).withWatermark(time_col, late)
    outcome = F.coalesce("coarse_label", "discard_reason", F.lit("UNKNOWN"))
    return timed.groupBy(F.window(time_col, window).alias("w"), outcome.alias("outcome")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "outcome", "n")


def predict_stream(stream: DataFrame, predictor: Predictor, id_col: str, code_col: str = "code") -> DataFrame:
    return predict(stream, predictor, id_col, code_col)
