"""Text table in, tokenised text table out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from quillsift.functions import cleaning, tokens as tok
from quillsift.functions.lexicon import DEFAULT_STOP_WORDS


def preprocess_document(
    df: DataFrame,
    text_column: str = "content",
    *,
    lowercase: bool = True,
    unicode_form: bool = True,
    remove_stop_words: bool = False,
    stop_words: Sequence[str] = DEFAULT_STOP_WORDS,
    abbreviations: Sequence[str] = (),
) -> DataFrame:
    """Adds cleaned_text, normalized_text, tokens and sentences; row-local throughout."""
    df = df.withColumn("cleaned_text", cleaning.clean_text(F.col(text_column)))
    df = df.withColumn("normalized_text", cleaning.normalize_text(F.col("cleaned_text"), lowercase, unicode_form))
    words = tok.tokenize_words(F.col("normalized_text"))
    if remove_stop_words:
        words = tok.drop_stop_words(words, stop_words)
    return df.withColumns({
        "tokens": words,
        "sentences": tok.tokenize_sentences(F.col("normalized_text"), abbreviations),
    })


def preprocess_dataset(df: DataFrame, text_column: str = "content", **options) -> DataFrame:
    """``preprocess_document`` plus num_tokens, num_sentences and the original text's word_count."""
    return preprocess_document(df, text_column, **options).withColumns({
        "num_tokens": F.size("tokens"),
        "num_sentences": F.size("sentences"),
        "word_count": tok.word_count(F.col(text_column)),
    })
