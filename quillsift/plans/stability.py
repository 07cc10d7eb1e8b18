"""How far single splits can be trusted: seeds, folds, missing values, importances, yields."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from quillsift.operators import evaluation, models, splits
from quillsift.operators.matrix import median_imputer, sanitize_numeric
from quillsift.operators.summaries import attempt_summary, nan_counts
from quillsift.schemas import ALL_FEATURES
from quillsift.session import materialise


def run_stability(features: DataFrame, attempts: DataFrame | None = None, columns: Sequence[str] = ALL_FEATURES, *,
                  id_column: str = "text_id", seeds: Sequence[int] = splits.STABILITY_SEEDS, k: int = 5,
                  trainer: models.Trainer | None = None, impute: str = "zero", parallelism: int = 4) -> DataFrame:
    """The report as (section, metric, value).

    Logistic regression on the features as they are, all seeds and all folds fitted together, or a ``trainer`` of its own
    for each.

    ``features`` may still hold missing values: they are counted, then set to 0 or, with
    ``impute="median"``, to the column's median.
    """
    missing = materialise(nan_counts(features, columns))
    if impute == "median":
        features = median_imputer(features, columns).transform(features)
    clean = materialise(
        splits.stratified_folds(sanitize_numeric(features, columns), id_column, k=k)
    )
    if trainer is None:
        per_seed = models.lr_seed_suite(clean, columns, seeds, id_column)
        folds = models.lr_cross_validate(clean, columns, range(k))
    else:
        per_seed = models.seed_suite(clean, columns, seeds, trainer, id_column, parallelism=parallelism)
        folds = models.cross_validate(clean, columns, trainer, range(k), parallelism=parallelism)
    sensitivity = evaluation.seed_sensitivity(per_seed)
    accuracy = evaluation.cv_summary(folds, factor=1.0).filter(F.col("metric") == "accuracy")
    importances = models.lr_abs_importance((trainer or models.train_lr_unscaled)(clean, columns), columns)

    def section(name: str, df: DataFrame, metric, value) -> DataFrame:
        return df.select(F.lit(name).alias("section"), metric.alias("metric"), value.cast("double").alias("value"))

    parts = [
        section("seeds", sensitivity.unpivot([], ["mean", "std", "min", "max", "range_points"], "metric", "value"),
                F.col("metric"), F.col("value")),
        section("cross-validation", accuracy, F.lit("mean"), F.col("mean")),
        section("cross-validation", accuracy, F.lit("std"), F.col("std")),
        section("missing values", missing, F.col("feature"), F.col("nan_count")),
        section("importance", evaluation.topn_importance(importances, 5), F.col("feature"), F.col("importance")),
    ]
    if attempts is not None:
        parts.append(section("success rate", attempt_summary(attempts), F.col("approach"), F.col("success_rate")))
    return reduce(DataFrame.unionByName, parts)
