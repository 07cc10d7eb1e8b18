"""Queries of the operators on token ids. SQL cannot tokenize; tests compare with brute force."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from quillsift.llm.packing import pack_documents
from quillsift.llm.registry import query, table
from quillsift.llm.tokenfile import read_token_file, write_token_file
from quillsift.session import scratch_path

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


@query("op1_packing")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack_documents(table(spark, sf_dir, "documents"), TOKENIZER)
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id",
                         "offset")


@query("op2_token_file")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "tokens")
    write_token_file(table(spark, sf_dir, "documents"), path, TOKENIZER)
    return read_token_file(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
