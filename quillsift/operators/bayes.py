"""Naive Bayes as tables: sums per class and feature, models as rows, scores as expressions.

One aggregate per (fold, class) holds all that any fold's model needs: it is the whole less that fold. So cross-validation
reads the features twice, however many folds there are, and a model is a row that can be joined, stored and replayed in
SQL. ``models.train_nb`` fits the same models as ``pyspark.ml`` pipelines.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from quillsift.operators.evaluation import classification_metrics
from quillsift.session import materialise

# The share of the greatest variance added to all, and what multinomial counts start from.
VARIANCE_SHARE = 1e-9
SMOOTHING = 1.0


def class_sums(df: DataFrame, columns: Sequence[str], groups: Sequence[str], label: str = "label") -> DataFrame:
    """(groups, label, place, n, mean, square, total): per class and feature (its place in ``columns``) the rows, the mean, the
    sum of squared deviations from it and the sum of absolute values. One aggregate; rows without a label are of no class."""
    values = [F.col(f"`{name}`").cast("double") for name in columns]
    wide = df.filter(F.col(label).isNotNull()).groupBy(*groups, F.col(label).alias("label")).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.avg(v).alias(f"_m{i}") for i, v in enumerate(values)], *[F.var_pop(v).alias(f"_v{i}") for i, v in enumerate(values)],
        *[F.sum(F.abs(v)).alias(f"_t{i}") for i, v in enumerate(values)])
    cells = F.array(*[
        F.struct(F.col(f"_m{i}").alias("mean"), (F.col(f"_v{i}") * F.col("n")).alias("square"), F.col(f"_t{i}").alias("total"))
        for i in range(len(values))])
    return wide.select(*groups, "label", "n", F.posexplode(cells).alias("place", "_c")).select(*groups, "label", "place", "n", "_c.*")


def merged(parts: DataFrame, *keys: str) -> DataFrame:
    """The sums of parts as the sums of all their rows, per ``keys``."""
    joint = parts.groupBy(*keys).agg((F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("_mean"))
    away = F.col("mean") - F.col("_mean")
    return parts.join(joint, list(keys)).groupBy(*keys).agg(
        F.sum("n").alias("n"), F.first("_mean").alias("mean"), F.sum(F.col("square") + F.col("n") * away * away).alias("square"),
        F.sum("total").alias("total"))


def without_part(parts: DataFrame, groups: Sequence[str]) -> DataFrame:
    """For each group the sums of all rows but its own, of every class: the whole less the part. Stage ``parts`` first.

    A class that a group lacks is whole in that group's model. The driver learns the groups.
    """
    names = F.array(*[F.struct(*[F.lit(row[g]).alias(g) for g in groups]) for row in parts.select(*groups).distinct().collect()])
    whole = merged(parts, "label", "place").toDF("label", "place", "_n", "_mean", "_square", "_total")
    cells = whole.withColumn("_g", F.explode(names)).select("*", "_g.*").join(parts, [*groups, "label", "place"], "left")
    n, mean, square, total = (F.coalesce(F.col(c), F.lit(0)) for c in ("n", "mean", "square", "total"))
    left = F.col("_n") - n
    left_mean = (F.col("_n") * F.col("_mean") - n * mean) / left
    shift = left_mean - mean
    return cells.filter(left > 0).select(
        *groups, "label", "place", left.alias("n"), left_mean.alias("mean"),
        F.greatest(F.col("_square") - square - n * left / F.col("_n") * shift * shift, F.lit(0.0)).alias("square"),
        (F.col("_total") - total).alias("total"))


def _models(classes: DataFrame, groups: Sequence[str]) -> DataFrame:
    fields = [name for name in classes.columns if name not in groups]
    return classes.groupBy(*groups).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("classes"))


def gaussian_models(sums: DataFrame, groups: Sequence[str]) -> DataFrame:
    """(groups, classes): per class ``log_prior`` and its features' ``means`` and ``variances``."""
    least = merged(sums, *groups, "place").groupBy(*groups).agg(
        (F.max(F.col("square") / F.col("n")) * VARIANCE_SHARE).alias("_least"), F.max("n").alias("_all"))
    cell = F.struct("place", "mean", (F.col("square") / F.col("n") + F.col("_least")).alias("variance"))
    per_class = sums.join(least, list(groups)).groupBy(*groups, "label", "n", "_all").agg(F.sort_array(F.collect_list(cell)).alias("_c"))
    return _models(per_class.select(
        *groups, "label", F.ln(F.col("n") / F.col("_all")).alias("log_prior"), F.col("_c.mean").alias("means"),
        F.col("_c.variance").alias("variances")), groups)


def multinomial_models(sums: DataFrame, groups: Sequence[str], smoothing: float = SMOOTHING) -> DataFrame:
    """(groups, classes): per class ``log_prior`` and its features' ``weights``, on absolute values."""
    per_class = sums.groupBy(*groups, "label", "n").agg(
        F.sort_array(F.collect_list(F.struct("place", "total"))).alias("_c"), F.sum("total").alias("_mass"))
    size = per_class.groupBy(*groups).agg(F.sum("n").alias("_all"), F.count(F.lit(1)).alias("_classes"))
    prior = F.ln((F.col("n") + smoothing) / (F.col("_all") + F.col("_classes") * smoothing))
    weights = F.transform("_c", lambda c: F.ln((c["total"] + smoothing) / (F.col("_mass") + F.size("_c") * smoothing)))
    return _models(per_class.join(size, list(groups)).select(*groups, "label", prior.alias("log_prior"), weights.alias("weights")), groups)


def _added(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, v: total + v)


def score_rows(df: DataFrame, models: DataFrame, columns: Sequence[str], groups: Sequence[str], *keep: str) -> DataFrame:
    """(keep, label, prediction, score) by the model of each row's group; score is the probability of class 1.

    There is one row of models per group, so adaptive execution broadcasts them and rows are scored where they lie. Of
    classes that are as likely the first is predicted.
    """
    gaussian = "variances" in models.schema["classes"].dataType.elementType.names
    values = F.array(*[F.col(f"`{name}`").cast("double") for name in columns])

    def fit(c: Column) -> Column:
        if gaussian:
            away = F.zip_with("_values", c["means"], lambda x, m: (x - m) * (x - m))
            return _added(F.zip_with(away, c["variances"], lambda d, v: F.lit(-0.5) * (F.ln(F.lit(2 * math.pi) * v) + d / v)))
        return _added(F.zip_with("_values", c["weights"], lambda x, w: F.abs(x) * w))

    rows = df.select(*dict.fromkeys([*keep, *groups, "label"]), values.alias("_values")).join(models, list(groups))
    fits = F.transform("classes", lambda c: F.struct((c["log_prior"] + fit(c)).alias("fit"), (-c["label"]).alias("back")))
    rows = rows.withColumn("_fits", fits).withColumn("_best", F.array_max("_fits"))
    mass = _added(F.transform("_fits", lambda f: F.exp(f["fit"] - F.col("_best.fit"))))
    one = _added(F.transform(F.filter("_fits", lambda f: f["back"] == -1), lambda f: F.exp(f["fit"] - F.col("_best.fit"))))
    return rows.select(*keep, F.col("label").cast("int").alias("label"), (-F.col("_best.back")).cast("int").alias("prediction"), (one / mass).alias("score"))


MODELS = {"gaussian": gaussian_models, "multinomial": multinomial_models}


def cross_validate_nb(df: DataFrame, columns: Sequence[str], variant: str = "gaussian", fold: str = "fold",
                      model: str = "Naive Bayes") -> DataFrame:
    """(model, fold, metric, value), as ``models.cross_validate`` has it, from one aggregate over all folds."""
    sums = materialise(class_sums(df, columns, [fold]))
    models = materialise(MODELS[variant](without_part(sums, [fold]), [fold]))
    wide = classification_metrics(score_rows(df, models, columns, [fold], fold), [fold])
    return wide.unpivot([fold], ["accuracy", "precision", "recall", "f1_score"], "metric", "value").select(
        F.lit(model).alias("model"), F.col(fold).alias("fold"), "metric", "value")
