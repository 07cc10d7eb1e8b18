"""Queries of the operators that read texts in Python tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quillsift.llm.fmindex import find_contamination
from quillsift.llm.katz import score_documents
from quillsift.llm.langid import identify_languages
from quillsift.llm.minhash import near_duplicates
from quillsift.llm.quality import hierarchical_quality
from quillsift.llm.registry import query, table
from quillsift.llm.secretscan import find_secrets


@query("op3_secret_scan")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))
    line = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    base = F.filter("spans", lambda s: s["base"])
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(F.array_join(F.transform(base, line), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", line), ",").alias("spans"),
    )


@query("op7_quality")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchical_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("text_key")


@query("op9_decontamination")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_contamination(documents, table(spark, sf_dir, "benchmark"))
    hits = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    ids = F.array_join(F.array_sort(F.transform("item_ids", lambda i: i.cast("string"))), ",")
    return found.select(
        "doc_id", "n_words", hits.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(ids, 256).alias("items_sha256"), (hits > 0).alias("contaminated"),
    )


@query("op5_near_dedup")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), similarity=0.85).drop("text_key")


@query("op8_katz_scores")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")), F.lit(0)) % 7 == 2
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", (~held_out).alias("train"))
    return score_documents(documents, "train").select(
        "doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query("op12_language_id")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")), F.lit(0)) % 4 == 2
    documents = table(spark, sf_dir, "documents").select("doc_id", "lang", "text", held_out.alias("held_out"), (~held_out).alias("train"))
    return identify_languages(documents, "train", keep=["doc_id", "held_out"])
