"""How the supplied tables stand in for the library's inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quillsift.operators.dataset import tag_corpus, union_corpora
from quillsift.operators.preprocess import preprocess_dataset
from quillsift.operators.splits import stratified_folds, stratified_split
from quillsift.plans.detection import feature_table
from quillsift.session import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, content)"""
    return table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content"))


def labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, label, content) of the documents that carry a quality label."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    return documents(spark, sf_dir).join(labels, "doc_id").select("doc_id", "label", "content")


def corpora(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """User turns as human texts, assistant turns as generated ones."""
    turns = table(spark, sf_dir, "conversations").select(
        F.concat_ws("-", "conv_id", "turn").alias("text_id"),
        F.col("text").alias("content"),
        # A turn number below 2^20 keeps this unique and in reading order.
        (F.col("conv_id") * (1 << 20) + F.col("turn")).alias("ingest_order"),
        "role",
    )
    human = tag_corpus(turns.filter(F.col("role") == "user").drop("role"), 0, "user", "conversation")
    generated = tag_corpus(turns.filter(F.col("role") == "assistant").drop("role"), 1, "assistant", "conversation")
    return human.withColumn("query", F.lit("chat")), generated.withColumn("topic", F.lit("chat"))


def labelled_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(text_id, label, content) of both corpora."""
    return union_corpora(*corpora(spark, sf_dir)).select("text_id", "label", "content")


def prepared_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preprocess_dataset(spread(documents(spark, sf_dir)))


def prepared_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preprocess_dataset(spread(labelled_turns(spark, sf_dir)))


def turn_features(spark: SparkSession, sf_dir: str, unseen_test: bool = False) -> DataFrame:
    """(text_id, label, 29 features), staged for training; with ``unseen_test`` the word list comes from training rows."""
    turns = spread(labelled_turns(spark, sf_dir))
    if not unseen_test:
        return feature_table(turns, "text_id", "label")
    split = stratified_split(turns)
    return feature_table(split, "text_id", "label", "is_test", learn=~F.col("is_test")).drop("is_test")


def scored_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(model, doc_id, fold, label, prediction, score): three simple scores of labelled documents."""
    folded = stratified_folds(labelled_documents(spark, sf_dir), "doc_id")
    chars = F.length("content").cast("double")
    scores = folded.select(
        "doc_id", "fold", "label",
        (chars / (chars + 1000.0)).alias("length"),
        (F.length(F.replace(F.col("content"), F.lit(" "), F.lit(""))) / chars).alias("density"),
        (F.length(F.replace(F.lower("content"), F.lit("e"), F.lit(""))) / chars - F.lit(0.4)).alias("letter"),
    )
    long = scores.unpivot(["doc_id", "fold", "label"], ["length", "density", "letter"], "model", "score")
    return long.withColumn("prediction", (F.col("score") >= 0.5).cast("int"))


def landed_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, query, body): each document as the JSON response of an article service.

    Languages decide which parts are missing, so that every default is reached.
    """
    lines = F.split("text", "\n")
    lang = F.col("lang")
    article = F.struct(
        F.get(lines, F.lit(0)).alias("title"),
        F.when(lang != "es", F.get(lines, F.lit(1))).alias("description"),
        F.col("text").alias("content"),
        F.concat(F.lit("https://example.org/"), F.col("doc_id").cast("string")).alias("url"),
        F.when(lang != "es", F.lit("2024-01-01")).alias("publishedAt"),
        F.struct(F.when(lang != "de", F.col("source")).alias("name")).alias("source"),
    )
    failed = lang == "fr"
    body = F.struct(
        F.when(failed, "error").otherwise("ok").alias("status"),
        F.when(failed & (F.col("source") != "src1"), F.concat(F.lit("quota for "), F.col("source"))).alias("message"),
        F.array(article).alias("articles"),
    )
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.col("source").alias("query"), F.to_json(body).alias("body")
    )


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, approach, succeeded, error_message): events as an attempt log."""
    code = F.get_json_object("props", "$.k").cast("int")
    message = (
        F.when(F.col("event_type") == "view", F.lit("Blocked by SAFETY filter"))
        .when(F.col("event_type") == "click", F.lit("Resource Quota exceeded"))
        .otherwise(F.concat(F.lit("HTTP "), (F.lit(380) + code).cast("string")))
    )
    succeeded = F.col("value") >= F.length("event_type") * 2
    return table(spark, sf_dir, "events").select(
        "event_id", F.col("event_type").alias("approach"), succeeded.alias("succeeded"),
        F.when(~succeeded, message).alias("error_message"),
    )


def gappy_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, value) with NaN, infinities and nulls by event type."""
    kind = F.col("event_type")
    value = (
        F.when(kind == "error", float("nan")).when(kind == "click", float("inf"))
        .when(kind == "view", float("-inf")).when(kind == "signup", F.lit(None).cast("double"))
        .otherwise(F.col("value"))
    )
    return table(spark, sf_dir, "events").select("event_id", value.alias("value"))
