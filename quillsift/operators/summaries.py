"""Counts and audits of a labelled table, each in a single pass."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from quillsift.operators.dataset import MAX_CHARS, MIN_CHARS


def class_distribution(df: DataFrame, label: str = "label") -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def null_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, nulls) for every column."""
    names = list(columns or df.columns)
    counts = df.agg(*[_count_if(F.col(name).isNull()).alias(name) for name in names])
    return counts.unpivot([], names, "column", "nulls")


def nan_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, nan_count, share_pct) of columns that hold NaN or null, most first, and a total.

    Run it before the values are sanitised.
    """
    missing = [
        _count_if(F.col(name).isNull() | F.isnan(F.col(name).cast("double"))).alias(name) for name in columns
    ]
    counts = df.agg(F.count(F.lit(1)).alias("_n"), *missing)
    total = F.aggregate(F.array(*columns), F.lit(0).cast("long"), lambda acc, x: acc + x)
    long = counts.withColumn("total", total).unpivot(["_n"], [*columns, "total"], "feature", "nan_count")
    cells = F.when(F.col("feature") == "total", F.col("_n") * len(columns)).otherwise(F.col("_n"))
    return (
        long.filter((F.col("nan_count") > 0) | (F.col("feature") == "total"))
        .select("feature", "nan_count", F.coalesce(F.try_divide(F.col("nan_count") * 100.0, cells), F.lit(0.0)).alias("share_pct"))
        .orderBy(F.desc("nan_count"), "feature")
    )


def _count_if(condition: Column) -> Column:
    return F.coalesce(F.sum(condition.cast("long")), F.lit(0).cast("long"))


def cleaning_funnel(df: DataFrame, content: str = "content", label: str = "label", order: str = "ingest_order",
                    low: int = MIN_CHARS, high: int = MAX_CHARS) -> DataFrame:
    """Rows left after each cleaning step, the classes and the balanced size, as (stage, rows).

    One scan and one shuffle of fixed-width rows: a digest stands in for the text, and the first
    row's label decides the class of its copies.
    """
    rows = df.select(
        F.sha2(F.col(content), 256).alias("_digest"),
        F.length(content).between(low, high).alias("_fits"),
        F.col(label).alias("_label"), F.col(order).alias("_order"),
    )
    texts = rows.groupBy("_digest", "_fits").agg(
        F.count(F.lit(1)).alias("_rows"), F.min_by("_label", "_order").alias("_label")
    )
    real = F.col("_digest").isNotNull()
    kept = real & F.col("_fits")
    counts = texts.agg(
        F.coalesce(F.sum("_rows"), F.lit(0)).alias("initial"),
        F.coalesce(F.sum(F.when(real, F.col("_rows"))), F.lit(0)).alias("not_null"),
        _count_if(real).alias("distinct"),
        _count_if(kept).alias("length_ok"),
        _count_if(kept & (F.col("_label") == 0)).alias("human"),
        _count_if(kept & (F.col("_label") == 1)).alias("ai"),
    ).withColumn("balanced", F.lit(2).cast("long") * F.least("human", "ai"))
    return counts.unpivot([], counts.columns, "stage", "rows")


def dataset_summary(df: DataFrame, content: str = "content", label: str = "label") -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("total"),
        _count_if(F.col(label) == 0).alias("human"),
        _count_if(F.col(label) == 1).alias("ai"),
        F.avg(F.length(content)).alias("avg_chars"),
    )


# --- attempt logs: one row per try, with ``approach``, ``succeeded`` and ``error_message`` -----

def classify_api_error(message: Column) -> Column:
    """blocked, rate_limit or other."""
    folded = F.lower(message)
    return (
        F.when(folded.contains("block") | folded.contains("safety"), "blocked")
        .when(message.contains("429") | folded.contains("quota"), "rate_limit")
        .otherwise("other")
    )


def attempt_summary(attempts: DataFrame) -> DataFrame:
    """Attempts, successes, errors and success rate per approach."""
    return attempts.groupBy("approach").agg(
        F.count(F.lit(1)).alias("attempted"),
        _count_if(F.col("succeeded")).alias("collected"),
        _count_if(F.col("error_message").isNotNull()).alias("errors"),
        F.avg(F.col("succeeded").cast("double")).alias("success_rate"),
    )


# Band limits in percent and the wanted share.
RED_BELOW, ORANGE_BELOW = 25, 90
TARGET_SHARE = 0.8


def rate_band(success_rate: Column) -> Column:
    percent = success_rate * 100
    return F.when(percent < RED_BELOW, "red").when(percent < ORANGE_BELOW, "orange").otherwise("green")


def reached_rate_target(collected: Column, wanted: Column) -> Column:
    return collected >= F.lit(TARGET_SHARE) * wanted
