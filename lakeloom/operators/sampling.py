"""Quota sampling that takes from all groups in turn."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakeloom import vocab
from lakeloom.functions.content import ARCHIVE_ROOT, archive_path
from lakeloom.functions.ordering import order_key
from lakeloom.operators.audit import require_columns
from lakeloom.vocab import CLASS_TOTALS, COARSE, RATIOS, SEED, SPLITS


def resolve_quotas(class_totals: dict[str, int] = CLASS_TOTALS, ratios: dict[str, float] = RATIOS) -> dict[tuple[str, str], int]:
    """(split, class) -> rows: rounded half-even, the last split takes what is left."""
    if set(class_totals) != set(COARSE) or set(ratios) != set(SPLITS):
        raise ValueError("quotas need every class and every split")
    out = {}
    for label, total in class_totals.items():
        if total <= 0:
            raise ValueError(f"{label}: total must be positive, not {total}")
        parts = [round(total * ratios[s]) for s in SPLITS[:-1]]
        for split, n in zip(SPLITS, [*parts, total - sum(parts)], strict=True):
            if n <= 0:
                raise ValueError(f"{label}, {split}: quota must be positive, not {n}")
            out[split, label] = n
    return out


def measured_totals(df: DataFrame, share: float, label_col: str = "coarse_label") -> dict[str, int]:
    """Class -> a share of the rows that the class has, at least one; rows of other labels are left out."""
    counts = df.where(F.col(label_col).isin(list(COARSE))).groupBy(label_col).agg(F.count("*").alias("n"))
    return {r[0]: max(1, round(r["n"] * share)) for r in counts.collect()}


def quota_table(spark, quotas: dict[tuple[str, str], int]) -> DataFrame:
    rows = [(s, c, n) for (s, c), n in sorted(quotas.items(), key=lambda q: (SPLITS.index(q[0][0]), COARSE.index(q[0][1]) if q[0][1] in COARSE else 0, q[0][1]))]
    return spark.createDataFrame(rows, "split string, coarse_label string, requested int")


def round_robin(df: DataFrame, cell_cols: list[str], group_col: str, id_col: str, most: int, seed: int = SEED) -> DataFrame:
    """Adds ``pos``, each row's place in its cell when all groups give a row in turn; keeps pos <= ``most``.

    The literal bound lets Spark trim each input partition before rows of a cell meet.
    """
    keyed = df.withColumn("_k", order_key(id_col, seed))
    turn = Window.partitionBy(*cell_cols, group_col).orderBy("_k", id_col)
    rounds = keyed.withColumn("_round", F.row_number().over(turn)).where(F.col("_round") <= most)
    place = Window.partitionBy(*cell_cols).orderBy("_round", "_k", id_col)
    return rounds.withColumn("pos", F.row_number().over(place)).where(F.col("pos") <= most).drop("_k", "_round")


def draw_sample(df: DataFrame, quotas: dict[tuple[str, str], int], seed: int = SEED, *, group_col: str = "problem_id", id_col: str = "submission_id", split_col: str = "split", label_col: str = "coarse_label") -> tuple[DataFrame, DataFrame]:
    """(sample, report): each cell's quota, taken from its groups in turn.

    A larger quota of a cell keeps the rows of a smaller one and leaves other cells alone.
    """
    require_columns(df, group_col, id_col, split_col, label_col)
    table = quota_table(df.sparkSession, quotas).select(F.col("split").alias(split_col), F.col("coarse_label").alias(label_col), "requested")
    drawn = round_robin(df, [split_col, label_col], group_col, id_col, max(quotas.values()), seed)
    sample = drawn.join(F.broadcast(table), [split_col, label_col]).where("pos <= requested").select(*df.columns)
    return sample, sampling_report(df, sample, table, group_col, split_col, label_col)


def sampling_report(df: DataFrame, sample: DataFrame, quotas: DataFrame, group_col: str = "problem_id", split_col: str = "split", label_col: str = "coarse_label") -> DataFrame:
    """Per cell, empty ones too: requested, available, taken, shortfall, problems, max_per_problem."""
    cell = [split_col, label_col]
    available = df.groupBy(*cell).agg(F.count("*").alias("available"))
    per_group = sample.groupBy(*cell, group_col).agg(F.count("*").alias("n"))
    taken = per_group.groupBy(*cell).agg(F.sum("n").alias("taken"), F.count(group_col).alias("problems"), F.max("n").alias("max_per_problem"))
    out = quotas.join(available, cell, "left").join(taken, cell, "left").na.fill(0, ["available", "taken", "problems", "max_per_problem"])
    return out.select(*cell, "requested", "available", "taken", F.greatest(F.col("requested") - F.col("taken"), F.lit(0)).alias("shortfall"), "problems", "max_per_problem").orderBy(vocab.ordinal(F.col(split_col), SPLITS), vocab.ordinal(F.col(label_col), COARSE))


def archive_paths(df: DataFrame, *, problem_col: str = "problem_id", submission_col: str = "submission_id", root: str = ARCHIVE_ROOT) -> DataFrame:
    """Adds ``archive_path``."""
    return df.withColumn("archive_path", archive_path(F.col(problem_col), F.col(submission_col), root))
