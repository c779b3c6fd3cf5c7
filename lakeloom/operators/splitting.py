"""Splits by group, with greedy balance, and the audit that no group crosses them."""

from __future__ import annotations

import hashlib
import math
from fractions import Fraction
from itertools import combinations
from math import ceil, floor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeloom import vocab
from lakeloom.functions.ordering import random_split, with_rank
from lakeloom.operators.labeling import percent
from lakeloom.sources.shared import fresh, written
from lakeloom.vocab import RATIOS, SEED, SPLITS

SMALL_TABLE = 200_000  # groups whose splits are broadcast

__all__ = ["allocate_groups", "assert_disjoint", "chain_straddle", "check_ratios", "cross_split_counts", "group_split", "group_splits", "in_mask", "random_split", "size_class_runs", "split_composition", "split_mask", "split_summary"]


def check_ratios(ratios: dict[str, float]) -> None:
    if set(ratios) != set(SPLITS) or any(r <= 0 for r in ratios.values()) or not math.isclose(sum(ratios.values()), 1.0, rel_tol=1e-5, abs_tol=1e-8):
        raise ValueError(f"ratios need {SPLITS}, all positive, with sum 1: {ratios}")


class Balance:
    """What each split still lacks, and the turns in which groups of one size fill it.

    A group goes to the split that lacks most, the earlier one on a tie. While groups have one size
    that order has a closed form: first the neediest split alone, from where it meets the next one
    both in turn, and so on; so a size class is a few runs of turns, however many groups it has.
    """

    def __init__(self, total: int, ratios: dict[str, float]):
        self.lack = [Fraction(total * ratios[s]) for s in SPLITS]
        self.filled: set[str] = set()

    def _first(self, k: int, size: int = 0) -> tuple[Fraction, int]:
        return self.lack[k] - size, -k

    def _picks_before(self, k: int, other: int, size: int) -> int:
        """How often split ``k`` is picked until ``other`` comes first."""
        gap = (self.lack[k] - self.lack[other]) / size
        return max(0, floor(gap) + 1 if k < other else ceil(gap))

    def runs(self, size: int, groups: int) -> list[tuple[int, list[str]]]:
        """(groups, turns) of a size class, in order: that many groups go to the splits of ``turns`` in turn."""
        out = []
        needy = sorted(range(len(SPLITS)), key=self._first, reverse=True)
        for active in range(1, len(needy) + 1):
            if not groups:
                break
            turns = sorted(needy[:active], key=self._first, reverse=True)
            n = groups if active == len(needy) else min(groups, sum(self._picks_before(k, needy[active], size) for k in turns))
            for place, k in enumerate(turns):
                self.lack[k] -= size * ((n - place + active - 1) // active if n > place else 0)
            if n:
                out.append((n, [SPLITS[k] for k in turns]))
                self.filled.update(SPLITS[k] for k in turns[:n])
            groups -= n
        return out


def size_class_runs(classes: dict[int, int], ratios: dict[str, float] = RATIOS) -> list[tuple[int, int, int, list[str]]]:
    """(size, groups before in the class, groups, turns) for (size -> number of groups), largest size first.

    Of N rows there are at most sqrt(2 N) sizes, and at most three runs each.
    """
    check_ratios(ratios)
    if (groups := sum(classes.values())) < len(SPLITS):
        raise ValueError(f"{groups} group(s) cannot fill {len(SPLITS)} splits")
    if bad := sorted(n for n in classes if n <= 0):
        raise ValueError(f"{sum(classes[n] for n in bad)} group(s) have no rows, but {bad[:5]}")
    balance, out = Balance(sum(n * m for n, m in classes.items()), ratios), []
    for size in sorted(classes, reverse=True):
        before = 0
        for n, turns in balance.runs(size, classes[size]):
            out.append((size, before, n, turns))
            before += n
    if len(balance.filled) < len(SPLITS):
        raise ValueError("a split is empty; there are too few groups or one is too large")
    return out


def allocate_groups(sizes: dict[str, int], ratios: dict[str, float] = RATIOS, seed: int = SEED) -> dict[str, str]:
    """Group -> split for sizes in memory; within a size class groups follow the seeded key, then their name."""
    if bad := sorted(g for g, n in sizes.items() if n <= 0):
        raise ValueError(f"{len(bad)} group(s) have no rows: {bad[:5]}")
    members: dict[int, list[str]] = {}
    for group in sorted(sizes, key=lambda g: (hashlib.md5(f"{seed}:{g}".encode()).hexdigest(), g)):
        members.setdefault(sizes[group], []).append(group)
    runs = size_class_runs({n: len(m) for n, m in members.items()}, ratios)
    return {members[size][before + k]: turns[k % len(turns)] for size, before, n, turns in runs for k in range(n)}


def group_splits(df: DataFrame, group_col: str = "problem_id", ratios: dict[str, float] = RATIOS, seed: int = SEED, name: str = "split") -> DataFrame:
    """(group, split) of all groups; only the number of groups of each size reaches the driver.

    Runs of turns are worked out per size class; a group finds its own by its rank in its class, which
    is counted by the first digits of the seeded key, as classes may be large.
    """
    n, place, turns, before, groups = fresh([group_col, name, "_n", "_before"], "_rows", "_place", "_turns", "_ahead", "_groups")
    sizes = written(df.where(F.col(group_col).isNotNull()).groupBy(group_col).agg(F.count("*").alias(n)), "groups")
    classes = {r[0]: r[1] for r in sizes.groupBy(n).agg(F.count("*")).collect()}
    ranked = with_rank(sizes, group_col, seed, place, by=n)
    runs = df.sparkSession.createDataFrame(size_class_runs(classes, ratios), f"`{n}` long, `{before}` long, `{groups}` long, `{turns}` array<string>")
    mine = (F.col(place) > F.col(before)) & (F.col(place) <= F.col(before) + F.col(groups))
    turn = F.pmod(F.col(place) - 1 - F.col(before), F.size(turns)).cast("int")
    out = ranked.join(runs, n).where(mine).select(group_col, F.get(turns, turn).alias(name))
    return F.broadcast(out) if sum(classes.values()) <= SMALL_TABLE else out


def group_split(df: DataFrame, group_col: str = "problem_id", ratios: dict[str, float] = RATIOS, seed: int = SEED, name: str = "split") -> DataFrame:
    """Adds a split that is the same for all rows of a group; a null group has a null split."""
    return df.join(group_splits(df, group_col, ratios, seed, name), group_col, "left")


def split_mask(split_col: str) -> Column:
    """The splits of a group as bits, an aggregate of constant state; 0 for none. Other names than those of the splits are an error."""
    bit = F.when(F.col(split_col).isNull(), None)
    for k, split in enumerate(SPLITS):
        bit = bit.when(F.col(split_col) == split, 1 << k)
    unknown = F.raise_error(F.concat(F.lit("no split: "), F.col(split_col).cast("string"))).cast("int")
    return F.coalesce(F.bit_or(bit.otherwise(unknown)), F.lit(0))


def in_mask(mask: str, split: str) -> Column:
    return F.col(mask).bitwiseAND(1 << SPLITS.index(split)) > 0


def cross_split_counts(df: DataFrame, key_col: str, split_col: str = "split") -> DataFrame:
    """(pair, n): keys in both splits of each pair, nulls aside; always one row per pair, in order."""
    seen = df.where(F.col(key_col).isNotNull() & F.col(split_col).isNotNull()).groupBy(key_col).agg(split_mask(split_col).alias("s"))
    pairs = list(combinations(SPLITS, 2))
    row = seen.agg(*(F.count_if(in_mask("s", a) & in_mask("s", b)).alias(f"{a}&{b}") for a, b in pairs))
    return row.unpivot([], row.columns, "pair", "n")


def assert_disjoint(df: DataFrame, key_col: str, split_col: str = "split") -> None:
    """Raises and names the pairs of splits that share a key."""
    shared = {r.pair: r.n for r in cross_split_counts(df, key_col, split_col).collect() if r.n}
    if shared:
        raise AssertionError(f"{key_col} is in more than one split: {shared}")


def split_summary(df: DataFrame, label_col: str | None = None, labels: tuple[str, ...] | None = None, split_col: str = "split") -> DataFrame:
    """Rows and percent per split in their order, absent ones with 0, and a column per label."""
    if label_col and labels is None:
        labels = tuple(sorted(r[0] for r in df.select(label_col).where(F.col(label_col).isNotNull()).distinct().collect()))
    counts = df.where(F.col(split_col).isNotNull()).groupBy(split_col).agg(F.count("*").alias("rows"), *(F.count_if(F.col(label_col) == x).alias(x) for x in labels or ()))
    order = df.sparkSession.createDataFrame(list(enumerate(SPLITS)), f"ord int, {split_col} string")
    total = counts.agg(F.sum("rows").alias("_total"))
    out = order.join(counts, split_col, "left").join(F.broadcast(total))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return out.select("ord", split_col, zero("rows").alias("rows"), F.coalesce(percent(zero("rows"), F.col("_total")), F.lit(0.0)).alias("pct"), *(zero(x).alias(x) for x in labels or ())).orderBy("ord")


def split_composition(df: DataFrame, label_col: str = "coarse_label", labels: tuple[str, ...] = vocab.COARSE, split_col: str = "split", digits: int = 4) -> DataFrame:
    """Percent of each label within each split."""
    counts = df.groupBy(split_col).agg(F.count(label_col).alias("_n"), *(F.count_if(F.col(label_col) == x).alias(x) for x in labels))
    return counts.select(split_col, *(percent(F.col(x), F.col("_n"), digits).alias(x) for x in labels))


def chain_straddle(df: DataFrame, split_cols: tuple[str, ...] = ("split", "random_split")) -> DataFrame:
    """Chains of two and more submissions, and how many of them are in more than one split."""
    chains = df.groupBy("user_id", "problem_id").agg(F.count("*").alias("n"), *(split_mask(c).alias(c) for c in split_cols))
    many = F.col("n") > 1
    return chains.agg(F.count("*").alias("chains"), F.count_if(many).alias("multi"), F.coalesce(F.sum(F.when(many, F.col("n"))), F.lit(0)).alias("submissions"), *(F.count_if(many & (F.bit_count(c) > 1)).alias(f"{c}_straddling") for c in split_cols))
