"""Raw labelled texts to trained and compared classifiers."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, functions as F

from quillsift.operators import evaluation, models, splits
from quillsift.operators.features import extract_all_features
from quillsift.operators.matrix import sanitize_numeric
from quillsift.operators.preprocess import preprocess_dataset
from quillsift.operators.summaries import class_distribution
from quillsift.schemas import ALL_FEATURES
from quillsift.session import materialise


def feature_table(df: DataFrame, *keep: str, text_column: str = "content",
                  easy_words: Sequence[str] | None = None, learn: Column | None = None) -> DataFrame:
    """(keep, 29 features), staged: training reads it many times and the texts never again.

    Without ``easy_words`` the list comes from the rows that ``learn`` marks (all by default); mark the training rows where test
    rows are to stay unseen.
    Feature rows are far smaller than texts, so they are packed into fewer, evenly sized
    partitions: every optimiser step runs one task for each.
    """
    prepared = preprocess_dataset(df.select(*keep, text_column), text_column)
    features = extract_all_features(prepared, easy_words=easy_words, keep=keep, learn=learn)
    return materialise(sanitize_numeric(features, ALL_FEATURES).hint("rebalance"))


@dataclass
class Detection:
    models: dict[str, PipelineModel]
    classes: DataFrame
    cv_folds: DataFrame
    cv_summary: DataFrame
    best: DataFrame
    test_scores: DataFrame
    metrics: DataFrame
    comparison: DataFrame
    reports: DataFrame
    confusion: DataFrame
    importance: DataFrame
    columns: list[str] = field(default_factory=lambda: list(ALL_FEATURES))


def run_detection(features: DataFrame, columns: Sequence[str] = ALL_FEATURES, *, id_column: str = "text_id",
                  trainers: dict[str, models.Trainer] | None = None, test_size: float = 0.2, k: int = 5,
                  seed: int = 42, cv_on_train_only: bool = False, parallelism: int = 4) -> Detection:
    """Cross-validate, fit, test and compare on a table from ``feature_table``.

    Folds cover all rows, test rows included, unless ``cv_on_train_only``.
    """
    trainers = trainers or models.DEFAULT_TRAINERS
    split = splits.stratified_split(features, id_column, test_size=test_size, seed=seed)
    split = materialise(splits.stratified_folds(split, id_column, k=k, seed=seed))
    train, test = split.filter(~F.col("is_test")), split.filter("is_test")
    cv_rows = train if cv_on_train_only else split

    folds = materialise(reduce(DataFrame.unionByName, [
        models.cross_validate(cv_rows, columns, trainer, range(k), model=name, parallelism=parallelism)
        for name, trainer in trainers.items()
    ]))
    fitted, scored = models.model_suite(train, test, columns, trainers, id_column, parallelism=parallelism)
    scored = materialise(scored)
    summary = evaluation.cv_summary(folds, factor=1.0)
    position = reduce(lambda chain, item: chain.when(F.col("model") == item[1], item[0]), enumerate(trainers), F)
    accuracy = summary.filter(F.col("metric") == "accuracy").withColumn("model_pos", position)
    metrics = evaluation.model_metrics(scored)
    linear = next((model for name, model in fitted.items() if hasattr(model.stages[-1], "coefficients")), None)
    importance = models.lr_abs_importance(linear, columns) if linear else None
    return Detection(
        models=fitted,
        classes=class_distribution(features),
        cv_folds=folds,
        cv_summary=summary,
        best=evaluation.best_model(accuracy),
        test_scores=scored,
        metrics=metrics,
        comparison=evaluation.model_comparison(metrics),
        reports=evaluation.classification_report(scored, ["model"]),
        confusion=evaluation.confusion_matrix(scored, ["model"]),
        importance=importance,
        columns=list(columns),
    )


def detection_report(result: Detection) -> DataFrame:
    """The closing summary as (section, metric, value)."""
    def section(name: str, df: DataFrame, metric, value) -> DataFrame:
        return df.select(F.lit(name).alias("section"), metric.alias("metric"), value.cast("double").alias("value"))

    accuracy = result.cv_summary.filter(F.col("metric") == "accuracy")
    return reduce(DataFrame.unionByName, [
        section("classes", result.classes, F.concat(F.lit("label "), F.col("label").cast("string")), F.col("n")),
        section("features", result.best, F.lit("total"), F.lit(len(result.columns))),
        section("cv accuracy mean", accuracy, F.col("model"), F.col("mean")),
        section("cv accuracy std", accuracy, F.col("model"), F.col("std")),
        section("test accuracy", result.metrics.filter(F.col("metric") == "accuracy"), F.col("model"), F.col("value")),
        section("best model", result.best, F.col("model"), F.col("mean")),
    ])
