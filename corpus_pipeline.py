"""From raw documents to packed sequences: quality, repeated lines, near-duplicates, benchmark passages, packing.

Each stage works on all that the one before kept. The first four return the columns of their input; rows equal in id and
text stay or go together. Null and empty texts never fail a stage: the quality filter rejects them, as texts without words.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from quillsift.llm.fmindex import find_contamination
from quillsift.llm.lines import drop_repeated_lines
from quillsift.llm.minhash import near_duplicates
from quillsift.llm.packing import pack_documents
from quillsift.llm.quality import hierarchical_quality
from quillsift.llm.rows import without
from quillsift.session import materialise

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")

# Quality classes, MinHash and the index are no SQL; tests compare each stage with brute force.
ORACLE_SQL = None


def _measured(before: DataFrame, after: DataFrame) -> DataFrame:
    """The columns of ``before``, with the length of the new texts."""
    if "n_chars" in before.columns:
        after = after.withColumn("n_chars", F.char_length("text").cast(before.schema["n_chars"].dataType))
    return after.select(*[F.col(f"`{c}`") for c in before.columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier and their sites do not reject."""
    judged = hierarchical_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return without(docs, judged.filter("not kept"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that came before; one of which nothing but blanks is left goes."""
    cut = drop_repeated_lines(docs).filter((F.col("n_lines_dropped") == 0) | F.col("text").rlike(r"[^\x09-\x0D\x20]"))
    return _measured(docs, cut)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that with the smallest id."""
    return without(docs, near_duplicates(docs).filter("not kept"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words that occur in a benchmark passage."""
    return _measured(docs, find_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), cut=True))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 ids."""
    return pack_documents(docs, TOKENIZER)


STAGES = [
    ("quality", quality),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        made = stage(spark, docs, sf_dir)
        docs = made if name == STAGES[-1][0] else materialise(made)
    return docs
