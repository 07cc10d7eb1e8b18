"""Which row a decision is about, where ids may repeat: the id together with a hash of the text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def text_key(text: Column) -> Column:
    return F.xxhash64(text)


def document_key(ident: Column, text: Column) -> Column:
    """Rows equal in id and text have the same key."""
    return F.xxhash64(ident.isNull(), ident, text)


def without(df: DataFrame, rejected: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``df`` that ``rejected`` (``doc_id``, ``text_key``) does not name; rows equal in id and text go together."""
    named = rejected.select(F.col("doc_id").alias("_rejected_id"), F.col("text_key").alias("_rejected_key")).distinct()
    same = F.col(f"`{id_column}`").eqNullSafe(F.col("_rejected_id")) & (text_key(F.col(f"`{text_column}`")) == F.col("_rejected_key"))
    return df.join(named, same, "left_anti")
