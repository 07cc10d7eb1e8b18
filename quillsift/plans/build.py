"""Two labelled corpora in, a clean and balanced data set out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from quillsift.operators.dataset import (
    MAX_CHARS, MIN_CHARS, balance_classes, collection_date, corpus_order, dedup_exact, filter_char_range, filter_not_null,
    preview_per_class, union_corpora,
)
from quillsift.operators.ordering import assign_text_id, shuffle_rows
from quillsift.operators.dataset import filter_word_range
from quillsift.operators.summaries import dataset_summary
from quillsift.session import materialise
from quillsift.sources.files import write_stage


def clean_and_balance(combined: DataFrame, *, clean: bool = True, low: int = MIN_CHARS, high: int = MAX_CHARS,
                      order: str = "ingest_order", seed: int = 42) -> DataFrame:
    """Not null, length in range, first of each text, then equal classes.

    Length depends on the text alone, so filtering by it before removing copies gives the same
    rows and shuffles fewer. The result is staged once, since balancing reads it three times.
    """
    if clean:
        kept = filter_char_range(filter_not_null(combined, "content"), low=low, high=high)
        combined = dedup_exact(kept, order=corpus_order(kept, order))
    return balance_classes(materialise(combined), seed=seed)


def build_dataset(human: DataFrame, generated: DataFrame, *, clean: bool = True, low: int = MIN_CHARS,
                  high: int = MAX_CHARS, order: str = "ingest_order", seed: int = 42, date: str | None = None,
                  output_dir: str | None = None, save_intermediates: bool = True) -> DataFrame:
    """The balanced set in random row order.

    ``clean=False`` skips the null, copy and length steps and the collection date: classes are
    only cut to equal size. With ``output_dir`` the inputs and the result are kept there.
    """
    if output_dir and save_intermediates:
        human = write_stage(human, output_dir, "human")
        generated = write_stage(generated, output_dir, "generated")
    balanced = clean_and_balance(
        union_corpora(human, generated), clean=clean, low=low, high=high, order=order, seed=seed
    )
    final = shuffle_rows(balanced.drop("corpus_position"), "text_id", seed)
    if clean:
        final = final.withColumn("collection_date", collection_date(date))
    return write_stage(final, output_dir, "final") if output_dir else final


@dataclass
class DatasetOverview:
    summary: DataFrame
    previews: DataFrame


def overview(dataset: DataFrame) -> DatasetOverview:
    """Counts, mean length and the beginning of one text per class."""
    return DatasetOverview(dataset_summary(dataset), preview_per_class(dataset))


def load_and_clean(df: DataFrame, text: str = "content", label: str = "label",
                   order: str = "ingest_order") -> DataFrame:
    """Text and label present, first of each text, 300 to 1000 words, an id for every row."""
    for name in (text, label):
        if name not in df.columns:
            raise ValueError(f"column {name!r} not found")
    kept = filter_word_range(filter_not_null(df, text, label), text)
    return assign_text_id(dedup_exact(kept, text, order), [order])
