"""Exact quantiles without gathering a column in one task."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from quillsift.session import materialise

# Rank error of the sketch is 1/ACCURACY of the rows; the bracket is several times wider.
ACCURACY = 10_000
MARGIN = 4.0 / ACCURACY
# Groups up to this size are bracketed whole; above it the margin is at least four rows wide.
SMALL_GROUP = ACCURACY
# Ranges that a bracket is cut into: the most rows that one quantile puts in order.
RANGES = 16_384


def long_form(df: DataFrame, columns: Sequence[str], *keys: str) -> DataFrame:
    """(keys, feature, value) with nulls and NaN dropped."""
    doubles = df.select(*keys, *[F.col(name).cast("double").alias(name) for name in columns])
    melted = doubles.unpivot(list(keys), list(columns), "feature", "value")
    return melted.filter(F.col("value").isNotNull() & ~F.isnan("value"))


def exact_quantiles(df: DataFrame, columns: Sequence[str], probabilities: Sequence[float],
                    keys: Sequence[str] = ()) -> DataFrame:
    """(keys, feature, probability, value) with linear interpolation between order statistics.

    ``percentile`` would hold every distinct value of a group in one task. Instead a sketch brackets each quantile; the
    bracket is cut into equal ranges, whose values are counted, and the range in which the quantile lies is the
    next bracket, until it holds one value or the quantile falls between two ranges. So no task puts more than ``RANGES`` rows in
    order, however large the table. Each round makes a bracket at least 16,384 times narrower; one or two are
    enough unless values differ by many orders of magnitude. ``df`` is read once per round: stage it first.
    """
    group = [*keys, "feature"]
    values = long_form(df, columns, *keys)
    bounds = [min(max(p + side * MARGIN, 0.0), 1.0) for p in probabilities for side in (-1, 1)]
    sketch = values.groupBy(*group).agg(
        F.count(F.lit(1)).alias("_n"),
        F.min("value").alias("_min"),
        F.max("value").alias("_max"),
        F.percentile_approx("value", bounds, ACCURACY).alias("_bounds"),
    )
    small = F.col("_n") <= SMALL_GROUP
    brackets = F.array(*[
        F.struct(
            F.lit(float(p)).alias("probability"),
            (F.lit(float(p)) * (F.col("_n") - 1)).alias("_rank"),
            F.when(small | F.lit(bounds[2 * i] == 0.0), F.col("_min")).otherwise(F.col("_bounds")[2 * i]).alias("_low"),
            F.when(small | F.lit(bounds[2 * i + 1] == 1.0), F.col("_max"))
            .otherwise(F.col("_bounds")[2 * i + 1]).alias("_high"),
        )
        for i, p in enumerate(probabilities)
    ])
    spot = [*group, "probability", "_rank"]
    # The first round counts what lies below the bracket as one more range.
    brackets = sketch.select(*group, F.explode(brackets).alias("_b")).select(*group, "_b.*", F.lit(None).cast("long").alias("_before"))
    found = []
    while True:
        placed = materialise(_narrowed(values, brackets, spot))
        sure = placed.filter("_lo IS NOT NULL")
        found.append(sure.select(*spot, "_lo", "_hi"))
        brackets = placed.filter("_lo IS NULL").select(*spot, "_low", "_high", "_before")
        if brackets.isEmpty():
            break
    picked = reduce(DataFrame.unionByName, found)
    share = F.col("_rank") - F.floor("_rank")
    return picked.select(*group, "probability", (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * share).alias("value"))


def _narrowed(values: DataFrame, brackets: DataFrame, spot: Sequence[str]) -> DataFrame:
    """(spot, _lo, _hi, _low, _high, _before): both order statistics where one round finds them, else the narrower bracket."""
    group = [name for name in spot if name not in ("probability", "_rank")]
    counted = F.col("_before").isNull() | (F.col("value") >= F.col("_low"))
    inside = values.join(brackets, group).filter(counted & (F.col("value") <= F.col("_high")))
    # Halves first, since the width of the widest bracket is no double.
    width = F.col("_high") / 2 - F.col("_low") / 2
    part = F.when(F.col("value") < F.col("_low"), F.lit(-1)).when(width > 0, F.least(F.floor((F.col("value") / 2 - F.col("_low") / 2) / width * RANGES), F.lit(RANGES - 1))).otherwise(F.lit(0))
    ranges = inside.groupBy(*spot, "_before", part.cast("int").alias("_part")).agg(
        F.count(F.lit(1)).alias("_n"), F.min("value").alias("_from"), F.max("value").alias("_to"))
    order = Window.partitionBy(*spot).orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)
    ranges = ranges.withColumn("_upto", F.coalesce("_before", F.lit(0)) + F.sum("_n").over(order)).withColumn("_start", F.col("_upto") - F.col("_n"))
    first, last = F.floor("_rank"), F.ceil("_rank")

    def has(rank: Column) -> Column:
        return (F.col("_start") <= rank) & (rank < F.col("_upto")) & (F.col("_part") >= 0)

    def of(rank: Column, name: str) -> Column:
        value = F.max(F.when(has(rank), F.col(name)))
        kind = "double" if name in ("_from", "_to") else "long"
        return F.when(value.isNull(), F.raise_error(F.lit("a quantile lies outside its bracket")).cast(kind)).otherwise(value)

    ends = ranges.groupBy(*spot).agg(
        of(first, "_part").alias("_p"), of(last, "_part").alias("_q"), of(first, "_from").alias("_low"), of(first, "_to").alias("_high"),
        of(last, "_from").alias("_after"), of(first, "_start").alias("_before"))
    apart, one = F.col("_p") != F.col("_q"), F.col("_low") == F.col("_high")
    return ends.select(
        *spot, F.when(apart | one, F.col("_high")).alias("_lo"), F.when(apart, F.col("_after")).when(one, F.col("_high")).alias("_hi"),
        "_low", "_high", "_before")
