"""Numeric clean-up, feature vectors, scaling and imputation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import NumericType

from quillsift.operators.quantiles import exact_quantiles
from quillsift.schemas import NOT_FEATURES

# What infinities become.
POSITIVE_CAP, NEGATIVE_CAP = 1e10, -1e10


def sanitize(value: Column) -> Column:
    """NaN and null become 0, infinities a large finite number."""
    value = value.cast("double")
    return (
        F.when(value.isNull() | F.isnan(value), 0.0)
        .when(value == float("inf"), POSITIVE_CAP)
        .when(value == float("-inf"), NEGATIVE_CAP)
        .otherwise(value)
    )


def feature_columns(df: DataFrame) -> list[str]:
    """All numeric columns that are not labels, ids or size counts."""
    return [
        field.name for field in df.schema.fields
        if isinstance(field.dataType, NumericType) and field.name not in NOT_FEATURES
    ]


def sanitize_numeric(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return df.withColumns({name: sanitize(F.col(name)) for name in columns or feature_columns(df)})


def assemble_features(df: DataFrame, columns: Sequence[str] | None = None,
                      output: str = "features") -> tuple[DataFrame, list[str]]:
    """Adds a feature vector of sanitised columns; also returns the column names in its order."""
    names = list(columns or feature_columns(df))
    clean = sanitize_numeric(df, names)
    return VectorAssembler(inputCols=names, outputCol=output, handleInvalid="error").transform(clean), names


def _sql_step(expressions: dict[str, str]) -> SQLTransformer:
    """A pipeline stage that replaces columns by SQL expressions and keeps the others."""
    names = ", ".join(f"`{name}`" for name in expressions)
    replaced = ", ".join(f"{expression} AS `{name}`" for name, expression in expressions.items())
    return SQLTransformer(statement=f"SELECT * EXCEPT ({names}), {replaced} FROM __THIS__")


def standard_scaler(train: DataFrame, columns: Sequence[str]) -> SQLTransformer:
    """A fitted scaler: centred, divided by the population deviation, constant columns to 0.

    It is a pipeline stage, so it is saved with the model and applied to other rows unchanged.
    """
    stats = train.agg(
        *[F.avg(name).alias(f"mean_{name}") for name in columns],
        *[F.stddev_pop(name).alias(f"std_{name}") for name in columns],
    ).first()

    def scaled(name: str) -> str:
        mean, std = stats[f"mean_{name}"], stats[f"std_{name}"]
        if mean is None or not std:
            return "CAST(0 AS DOUBLE)"
        return f"(`{name}` - CAST('{mean!r}' AS DOUBLE)) / CAST('{std!r}' AS DOUBLE)"

    return _sql_step({name: scaled(name) for name in columns})


def absolute_values(columns: Sequence[str]) -> SQLTransformer:
    """A pipeline stage that takes absolute values, for models that need counts."""
    return _sql_step({name: f"ABS(`{name}`)" for name in columns})


def median_imputer(train: DataFrame, columns: Sequence[str]) -> SQLTransformer:
    """A fitted stage that puts each column's exact median for null and NaN."""
    rows = exact_quantiles(train, columns, [0.5]).collect()  # one row per column
    medians = {row["feature"]: row["value"] for row in rows}

    def filled(name: str) -> str:
        median = medians.get(name)
        missing = f"`{name}` IS NULL OR isnan(`{name}`)"
        return f"CASE WHEN {missing} THEN CAST('{0.0 if median is None else median!r}' AS DOUBLE) ELSE `{name}` END"

    return _sql_step({name: filled(name) for name in columns})
