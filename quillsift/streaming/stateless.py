"""The row-local work on a stream.

Cleaning, tokens and the 29 features keep no state and need no shuffle, so the batch transforms
apply to a streaming DataFrame as they are. Only the list of easy words has to be given: it
comes from a corpus, not from the stream.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from quillsift.operators.features import extract_all_features
from quillsift.operators.matrix import sanitize_numeric
from quillsift.operators.preprocess import preprocess_dataset
from quillsift.schemas import ALL_FEATURES


def featurise_stream(texts: DataFrame, easy_words: Sequence[str], text_column: str = "content") -> DataFrame:
    """Appends the preprocessed columns and all features to a stream of texts."""
    prepared = preprocess_dataset(texts, text_column)
    return sanitize_numeric(extract_all_features(prepared, easy_words=easy_words), ALL_FEATURES)
