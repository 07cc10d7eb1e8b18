"""Stratified train/test splits and folds with exact class shares."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from quillsift.operators.ordering import class_rank, class_targets, flag_first

# The split seeds of the stability study.
STABILITY_SEEDS = [42, 123, 456, 789, 2024, 3141, 5926, 8080, 1234, 9999]


def stratified_split(df: DataFrame, id_column: str = "text_id", label: str = "label", test_size: float = 0.2,
                     seed: int = 42) -> DataFrame:
    """Adds ``is_test``: true for round(test_size * n) rows of each class, null where the label is null."""
    return flag_first(df, [label], id_column, class_targets(test_size), seed, "is_test")


def multi_seed_split(df: DataFrame, id_column: str = "text_id", label: str = "label", test_size: float = 0.2,
                     seeds: Sequence[int] = STABILITY_SEEDS) -> DataFrame:
    """One split per seed in one table: every row appears once for each ``seed``; null where the label is null."""
    seeded = df.withColumn("seed", F.explode(F.array(*[F.lit(seed) for seed in seeds])))
    strata = ["seed", label]
    return flag_first(seeded, strata, id_column, class_targets(test_size), F.col("seed"), "is_test")


def stratified_folds(df: DataFrame, id_column: str = "text_id", label: str = "label", k: int = 5,
                     seed: int = 42) -> DataFrame:
    """Adds ``fold`` in 0..k-1, dealing each class out evenly in hash order; null where the label is null."""
    ranked = class_rank(df, [label], id_column, seed, "_rank")
    return ranked.withColumn("fold", F.pmod(F.col("_rank") - 1, F.lit(k)).cast("int")).drop("_rank")
