"""Registration of queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def comparable(df: DataFrame) -> DataFrame:
    """Whole numbers as bigint and doubles at six places, as the SQL side has them."""
    def column(field: T.StructField):
        if isinstance(field.dataType, (T.IntegerType, T.ShortType)):
            return F.col(field.name).cast("bigint").alias(field.name)
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            return F.round(F.col(field.name).cast("double"), 6).alias(field.name)
        return F.col(field.name)

    return df.select(*[column(field) for field in df.schema.fields])


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: comparable(function(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register
