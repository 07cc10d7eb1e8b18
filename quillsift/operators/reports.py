"""The tables behind the plots: means, histograms, box plots, correlations, point pairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from quillsift.operators.moments import pair_moments
from quillsift.operators.ordering import sample_n
from quillsift.operators.quantiles import exact_quantiles, long_form

# Fixed value: bars per histogram.
HISTOGRAM_BINS = 30


def class_feature_means(df: DataFrame, features: Sequence[str], label: str = "label") -> DataFrame:
    """(label, feature, mean): one aggregate over plain columns, turned long afterwards."""
    means = df.groupBy(label).agg(*[F.avg(name).alias(name) for name in features])
    return means.unpivot([label], list(features), "feature", "mean")


def feature_histogram(df: DataFrame, features: Sequence[str], label: str = "label",
                      bins: int = HISTOGRAM_BINS) -> DataFrame:
    """(label, feature, bin, n): equal bins over each class's own range, the last one closed.

    A constant column is given a range of half a unit on either side.
    """
    values = long_form(df, features, label)
    group = [label, "feature"]
    ranges = values.groupBy(*group).agg(F.min("value").alias("_min"), F.max("value").alias("_max"))
    flat = F.col("_min") == F.col("_max")
    ranges = ranges.select(
        *group,
        F.when(flat, F.col("_min") - 0.5).otherwise(F.col("_min")).alias("_low"),
        F.when(flat, F.col("_max") + 0.5).otherwise(F.col("_max")).alias("_high"),
    )
    place = (F.col("value") - F.col("_low")) / (F.col("_high") - F.col("_low")) * bins
    placed = values.join(ranges, group).withColumn(
        "bin", F.least(F.floor(place), F.lit(bins - 1)).cast("int")
    )
    return placed.groupBy(*group, "bin").agg(F.count(F.lit(1)).alias("n"))


def feature_boxplot(df: DataFrame, features: Sequence[str], label: str = "label",
                    whisker: float = 1.5) -> DataFrame:
    """Quartiles, whiskers and number of outliers per class and feature.

    Whiskers reach the furthest value within ``whisker`` interquartile ranges of the box.
    """
    group = [label, "feature"]
    quartiles = exact_quantiles(df, features, [0.25, 0.5, 0.75], [label])
    box = quartiles.groupBy(*group).pivot("probability", [0.25, 0.5, 0.75]).agg(F.first("value")).select(
        *group, F.col("`0.25`").alias("q1"), F.col("`0.5`").alias("median"), F.col("`0.75`").alias("q3")
    )
    reach = F.lit(whisker) * (F.col("q3") - F.col("q1"))
    values = long_form(df, features, label).join(box, group)
    inside = F.col("value").between(F.col("q1") - reach, F.col("q3") + reach)
    return values.groupBy(*group, "q1", "median", "q3").agg(
        F.min(F.when(inside, F.col("value"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("value"))).alias("whisker_high"),
        F.coalesce(F.sum((~inside).cast("long")), F.lit(0)).alias("outliers"),
    )


def boxplot_outliers(df: DataFrame, boxes: DataFrame, features: Sequence[str], label: str = "label",
                     whisker: float = 1.5) -> DataFrame:
    """The values outside the whiskers of ``feature_boxplot``'s result."""
    reach = F.lit(whisker) * (F.col("q3") - F.col("q1"))
    values = long_form(df, features, label).join(boxes.select(label, "feature", "q1", "q3"), [label, "feature"])
    return values.filter(~F.col("value").between(F.col("q1") - reach, F.col("q3") + reach)).select(label, "feature", "value")


def correlation_matrix(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """(feature_x, feature_y, correlation) for every ordered pair, null for a constant column.

    Missing values (null, NaN) are left out pair by pair. One pass finds means, a second one all pairs at once.
    """
    known = df.select(*[F.nanvl(F.col(f"`{name}`").cast("double"), F.lit(None).cast("double")).alias(f"c{i}") for i, name in enumerate(features)])
    means = known.agg(*[F.avg(name).alias(name) for name in known.columns]).first()
    sums = pair_moments(df, features, [0.0 if mean is None else mean for mean in means])
    n = F.col("n")

    def spread(a: str, b: str) -> Column:
        return F.col(f"sum_{a}{b}") / n - F.col(f"sum_{a}") / n * (F.col(f"sum_{b}") / n)

    varies = (n > 0) & (F.col("low_x") < F.col("high_x")) & (F.col("low_y") < F.col("high_y"))
    value = F.when(varies, F.when(F.col("x") == F.col("y"), F.lit(1.0)).otherwise(
        F.try_divide(spread("x", "y"), F.sqrt(spread("x", "x")) * F.sqrt(spread("y", "y")))))
    name = F.array(*[F.lit(feature) for feature in features])
    both = F.array(F.struct(F.col("x").alias("i"), F.col("y").alias("j")), F.struct(F.col("y").alias("i"), F.col("x").alias("j")))
    cells = sums.withColumn("correlation", value).withColumn("_cell", F.explode(F.array_distinct(both)))
    return cells.select(
        F.get(name, F.col("_cell.i").cast("int")).alias("feature_x"), F.get(name, F.col("_cell.j").cast("int")).alias("feature_y"), "correlation")


def feature_pairs(df: DataFrame, feature1: str, feature2: str, label: str = "label",
                  points: int | None = None, id_column: str = "text_id") -> DataFrame:
    """(label, f1, f2) points, all of them or a repeatable sample of a given size for plotting."""
    if points is not None:
        df = sample_n(df, points, id_column)
    return df.select(label, feature1, feature2)
