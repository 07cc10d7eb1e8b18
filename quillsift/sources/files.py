"""CSV, staged tables and models."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.util import MLWritable
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from quillsift.schemas import COMBINED_TEXT

# Texts hold commas, quotes and line breaks: quotes are doubled, blanks are kept.
# Null is written as \N on both sides, so that an empty text stays one.
_CSV = {
    "header": True, "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False,
    "nullValue": "\\N",
}


def read_csv(spark: SparkSession, path: str, schema: T.StructType = COMBINED_TEXT, text_column: str = "content",
             label_column: str = "label") -> DataFrame:
    """Labelled texts from CSV with a declared schema.

    Multi-line records cannot be split, so one file is one task: keep files to some hundred
    megabytes and stage the table as parquet once. A malformed record is an error.
    """
    for name in (text_column, label_column):
        if name not in schema.names:
            raise ValueError(f"column {name!r} not found in {schema.names}")
    reader = spark.read.schema(schema).options(multiLine=True, enforceSchema=False, mode="FAILFAST", emptyValue="", **_CSV)
    return reader.csv(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Writes CSV that ``read_csv`` can read back; list columns become JSON text."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    columns = [
        F.to_json(field.name).alias(field.name) if isinstance(field.dataType, nested) else F.col(field.name)
        for field in df.schema.fields
    ]
    df.select(*columns).write.mode(mode).options(emptyValue='""', **_CSV).csv(path)


def write_stage(df: DataFrame, directory: str, stage: str, *partition_by: str) -> DataFrame:
    """Writes a stage as parquet and returns it read back, which also cuts its lineage."""
    path = f"{directory.rstrip('/')}/{stage}"
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def save_model(model: MLWritable, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
