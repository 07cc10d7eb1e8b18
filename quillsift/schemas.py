"""Declared schemas, so that no reader has to infer one."""

from pyspark.sql import types as T


def _strings(*names: str) -> list[T.StructField]:
    return [T.StructField(name, T.StringType()) for name in names]


HUMAN_TEXT = T.StructType(
    _strings("text_id", "content")
    + [T.StructField("label", T.IntegerType())]
    + _strings("source", "title", "url", "published_at", "query", "collection_method")
)

GENERATED_TEXT = T.StructType(
    _strings("text_id", "content")
    + [T.StructField("label", T.IntegerType())]
    + _strings("source", "prompt", "topic", "collection_method")
)

COMBINED_TEXT = T.StructType(
    list(HUMAN_TEXT.fields)
    + _strings("prompt", "topic", "collection_date")
)

ARTICLE = T.StructType(
    _strings("title", "description", "content", "url", "publishedAt")
    + [T.StructField("source", T.StructType(_strings("name")))]
)

ARTICLE_RESPONSE = T.StructType(
    _strings("status", "message") + [T.StructField("articles", T.ArrayType(ARTICLE))]
)

STATISTICAL_FEATURES = [
    "avg_word_length", "avg_sentence_length", "vocabulary_richness", "unique_word_count",
    "lexical_diversity", "punctuation_ratio", "comma_count", "period_count", "exclamation_count",
    "question_count", "semicolon_count", "colon_count", "sentence_length_std", "paragraph_count",
]
READABILITY_FEATURES = [
    "flesch_reading_ease", "flesch_kincaid_grade", "automated_readability_index",
    "dale_chall_readability", "gunning_fog", "smog_index",
]
LINGUISTIC_FEATURES = [
    "noun_ratio", "verb_ratio", "adjective_ratio", "adverb_ratio", "pronoun_ratio",
    "bigram_diversity", "trigram_diversity",
]
PERPLEXITY_FEATURES = ["word_entropy", "unique_word_ratio"]
ALL_FEATURES = STATISTICAL_FEATURES + READABILITY_FEATURES + LINGUISTIC_FEATURES + PERPLEXITY_FEATURES

# Numeric columns of a feature table that are never model inputs.
NOT_FEATURES = ("label", "text_id", "word_count", "num_tokens", "num_sentences")
