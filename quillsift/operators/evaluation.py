"""Metrics and curves over scored rows ``(label, prediction, score)``.

Every function takes ``groups`` (for example ``["model"]``) and returns one result per group.
All of them reduce to small counts in one aggregate; the curves also need an order over the
distinct scores, which comes from ``running_totals`` and so is never a single-task sort.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from quillsift.operators.ordering import join_null_safe, running_totals

METRICS = ["accuracy", "precision", "recall", "f1_score", "roc_auc"]


def _count(condition: Column) -> Column:
    return F.coalesce(F.sum(condition.cast("long")), F.lit(0).cast("long"))


def _share(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole), F.lit(0.0))


def confusion_counts(scored: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """tn, fp, fn, tp in one row per group."""
    positive, called = F.col("label") == 1, F.col("prediction") == 1
    return scored.groupBy(*groups).agg(
        _count(~positive & ~called).alias("tn"),
        _count(~positive & called).alias("fp"),
        _count(positive & ~called).alias("fn"),
        _count(positive & called).alias("tp"),
    )


def confusion_matrix(scored: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """(groups, label, prediction, n) with empty cells kept."""
    cells = F.array(*[
        F.struct(F.lit(actual).alias("label"), F.lit(called).alias("prediction"), F.col(name).alias("n"))
        for actual, called, name in ((0, 0, "tn"), (0, 1, "fp"), (1, 0, "fn"), (1, 1, "tp"))
    ])
    counts = confusion_counts(scored, groups)
    return counts.select(*groups, F.explode(cells).alias("_c")).select(*groups, "_c.*")


def classification_metrics(scored: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Accuracy, and precision, recall and F1 of class 1; 0 where undefined."""
    tn, fp, fn, tp = (F.col(name) for name in ("tn", "fp", "fn", "tp"))
    return confusion_counts(scored, groups).select(
        *groups,
        _share(tp + tn, tp + tn + fp + fn).alias("accuracy"),
        _share(tp, tp + fp).alias("precision"),
        _share(tp, tp + fn).alias("recall"),
        _share(F.lit(2) * tp, F.lit(2) * tp + fp + fn).alias("f1_score"),
    )


def classification_report(scored: DataFrame, groups: Sequence[str] = (),
                          class_names: Sequence[str] = ("Human", "AI")) -> DataFrame:
    """Per class and averaged precision, recall, F1 and support, one row per line of the report.

    In the accuracy row all three scores hold the accuracy.
    """
    tn, fp, fn, tp = (F.col(name) for name in ("tn", "fp", "fn", "tp"))
    scores = confusion_counts(scored, groups).withColumns({
        "p0": _share(tn, tn + fn), "r0": _share(tn, tn + fp),
        "f0": _share(F.lit(2) * tn, F.lit(2) * tn + fp + fn), "s0": tn + fp,
        "p1": _share(tp, tp + fp), "r1": _share(tp, tp + fn),
        "f1": _share(F.lit(2) * tp, F.lit(2) * tp + fp + fn), "s1": tp + fn,
        "acc": _share(tp + tn, tp + tn + fp + fn),
    })
    total = F.col("s0") + F.col("s1")

    def mean(measure: str, weighted: bool) -> Column:
        zero, one = F.col(f"{measure}0"), F.col(f"{measure}1")
        return _share(zero * F.col("s0") + one * F.col("s1"), total) if weighted else (zero + one) / 2.0

    def line(name: str, precision: Column, recall: Column, f1: Column, support: Column) -> Column:
        return F.struct(F.lit(name).alias("class"), precision.alias("precision"), recall.alias("recall"),
                        f1.alias("f1_score"), support.alias("support"))

    lines = F.array(
        line(class_names[0], F.col("p0"), F.col("r0"), F.col("f0"), F.col("s0")),
        line(class_names[1], F.col("p1"), F.col("r1"), F.col("f1"), F.col("s1")),
        line("accuracy", F.col("acc"), F.col("acc"), F.col("acc"), total),
        line("macro avg", mean("p", False), mean("r", False), mean("f", False), total),
        line("weighted avg", mean("p", True), mean("r", True), mean("f", True), total),
    )
    return scores.select(*groups, F.explode(lines).alias("_l")).select(*groups, "_l.*")


def _by_score(scored: DataFrame, groups: Sequence[str], following: Sequence[str] = ()) -> DataFrame:
    """(groups, score, pos, neg, tp, fp): counts at each distinct score and at or above it.

    Rows with equal scores are merged first, so a very common score is one row.
    """
    merged = scored.groupBy(*groups, "score").agg(
        _count(F.col("label") == 1).alias("pos"), _count(F.col("label") != 1).alias("neg")
    )
    return running_totals(merged, [F.desc("score")], {"tp": "pos", "fp": "neg"}, groups, following)


def roc_auc(scored: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve, equal scores counting half; null with a single class."""
    # Each negative at a score: positives above it count whole, those beside it half.
    area = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2.0))
    pairs = (F.sum("pos") * F.sum("neg")).cast("double")
    return _by_score(scored, groups).groupBy(*groups).agg(F.try_divide(area, pairs).alias("roc_auc"))


def roc_curve(scored: DataFrame, groups: Sequence[str] = (), bins: int | None = None) -> DataFrame:
    """(threshold, fpr, tpr) per distinct score, from (infinity, 0, 0) on. A null group is a group.

    A point is left out where the step after it repeats the step to it, except at the ends.
    ``bins`` rounds scores in [0, 1] down to that many steps, to plot very large tables.
    """
    if bins:
        scored = scored.withColumn("score", F.floor(F.col("score") * bins) / bins)
    points = _by_score(scored, groups, following=["pos", "neg"])
    first = F.col("tp") + F.col("fp") == F.col("pos") + F.col("neg")
    turns = (F.col("pos") != F.col("next_pos")) | (F.col("neg") != F.col("next_neg"))
    corners = points.filter(first | F.col("next_pos").isNull() | turns)
    totals = scored.groupBy(*groups, F.lit(0).alias("_k")).agg(_count(F.col("label") == 1).alias("_p"), _count(F.col("label") != 1).alias("_n"))
    curve = join_null_safe(corners.withColumn("_k", F.lit(0)), totals, [*groups, "_k"]).select(
        *groups,
        F.col("score").cast("double").alias("threshold"),
        F.try_divide(F.col("fp").cast("double"), F.col("_n")).alias("fpr"),
        F.try_divide(F.col("tp").cast("double"), F.col("_p")).alias("tpr"),
    )
    origin = totals.select(
        *groups, F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")
    )
    return origin.unionByName(curve)


def model_metrics(scored: DataFrame, with_auc: bool = True) -> DataFrame:
    """Long table (model, metric, value) of a scored table with a ``model`` column."""
    wide = classification_metrics(scored, ["model"])
    if with_auc:
        wide = wide.join(roc_auc(scored, ["model"]), "model")
    names = [name for name in METRICS if name in wide.columns]
    return wide.unpivot(["model"], names, "metric", "value").filter(F.col("value").isNotNull())


def model_comparison(metrics: DataFrame) -> DataFrame:
    """One row per model, one column per metric, from (model, metric, value)."""
    return metrics.groupBy("model").pivot("metric", METRICS).agg(F.first("value"))


def cv_summary(fold_metrics: DataFrame, factor: float = 2.0) -> DataFrame:
    """Mean and ``factor`` population deviations per model and metric, with the fold values."""
    return fold_metrics.groupBy("model", "metric").agg(
        F.avg("value").alias("mean"),
        F.stddev_pop("value").alias("std"),
        (F.lit(factor) * F.stddev_pop("value")).alias("spread"),
        F.count(F.lit(1)).alias("folds"),
        F.transform(F.array_sort(F.collect_list(F.struct("fold", "value"))), lambda x: x["value"]).alias("fold_values"),
    )


def seed_sensitivity(seed_scores: DataFrame, value: str = "accuracy") -> DataFrame:
    """Mean, population deviation, extremes and range in percentage points over seeds."""
    return seed_scores.agg(
        F.count(F.lit(1)).alias("seeds"),
        F.avg(value).alias("mean"),
        F.stddev_pop(value).alias("std"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
        ((F.max(value) - F.min(value)) * 100.0).alias("range_points"),
    )


def best_model(summary: DataFrame, position: str = "model_pos", score: str = "mean") -> DataFrame:
    """The model with the highest mean score; the earlier one wins a tie."""
    return summary.orderBy(F.desc(score), position).limit(1)


def topn_importance(importances: DataFrame, n: int = 20) -> DataFrame:
    """The n highest (feature, importance) rows, ties by name."""
    return importances.orderBy(F.desc("importance"), "feature").limit(n)


def topn_signed(coefficients: DataFrame, n: int = 20) -> DataFrame:
    """The n largest and n smallest (feature, coefficient) rows with their direction and rank."""
    def ranked(direction: str, order: Column) -> DataFrame:
        # One row per feature: a small table whatever the corpus size.
        window = Window.partitionBy("direction").orderBy(order, "feature")
        return (
            coefficients.withColumn("direction", F.lit(direction))
            .withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= n)
        )

    return ranked("positive", F.desc("coefficient")).unionByName(ranked("negative", F.asc("coefficient")))
