"""Feature tables: all 29 features, and the token-table forms of the word list look-ups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from quillsift.functions import features as per_doc, lexicon
from quillsift.functions.features import MAX_LITERAL_WORDS
from quillsift.functions.tokens import bare_words
from quillsift.schemas import ALL_FEATURES, READABILITY_FEATURES
from quillsift.session import materialise

# Fixed value: words of the list of easy ones.
EASY_WORDS = 3000


def _most_frequent(words: DataFrame, size: int) -> list[str]:
    if size > MAX_LITERAL_WORDS:
        raise ValueError(f"at most {MAX_LITERAL_WORDS} words can be held as a literal list")
    top = words.groupBy("word").count().orderBy(F.desc("count"), "word").limit(size)
    return [row.word for row in top.select("word").collect()]


def easy_word_list(df: DataFrame, text: str = "normalized_text", size: int = EASY_WORDS) -> list[str]:
    """The ``size`` most frequent words of the corpus, ties by word.

    Stands in for a published list of easy words. Counts are combined map-side before the one
    shuffle, and only the top ``size`` words reach the driver.
    """
    return _most_frequent(word_table(df, text=text), size)


def word_table(df: DataFrame, *keep: str, text: str = "normalized_text") -> DataFrame:
    """One row per word of a cleaned text, punctuation taken out."""
    return df.select(*keep, F.explode(bare_words(F.col(text))).alias("word"))


def token_table(df: DataFrame, *keep: str, tokens: str = "tokens") -> DataFrame:
    """One row per token with its position."""
    return df.select(*keep, F.posexplode(tokens).alias("pos", "token"))


def stop_word_filter(tokens: DataFrame, stop_words: DataFrame) -> DataFrame:
    """Token rows whose lower case is not in ``stop_words(word)``, a table of any size."""
    listed = stop_words.select(F.lower("word").alias("_stop")).distinct()
    return tokens.join(listed, F.lower("token") == F.col("_stop"), "left_anti")


def difficult_words(words: DataFrame, easy_words: DataFrame) -> DataFrame:
    """Word rows that are not in ``easy_words(word)``, a table of any size."""
    return words.join(easy_words.select("word").distinct(), "word", "left_anti")


def pos_lookup(tokens: DataFrame, tag_lexicon: DataFrame | None = None) -> DataFrame:
    """Adds ``tag``: from ``tag_lexicon(token, tag)`` where listed, else by rule.

    Spark broadcasts the lexicon when it is small. When it is not, the hottest tokens land on
    few join keys: adaptive skew handling splits those, since the lexicon has one row per token.
    """
    lowered = tokens.withColumn("_low", F.lower("token"))
    ruled = F.expr(lexicon.pos_tag("_low"))
    if tag_lexicon is None:
        return lowered.withColumn("tag", ruled).drop("_low")
    listed = tag_lexicon.groupBy("token").agg(F.min("tag").alias("_listed"))
    return lowered.join(listed, "token", "left").withColumn("tag", F.coalesce("_listed", ruled)).drop("_listed", "_low")


def pos_ratios(tagged: DataFrame, *keys: str) -> DataFrame:
    """Word class shares per document from a tagged token table (partial sums before the shuffle)."""
    def share(group: Sequence[str]) -> Column:
        return F.sum(F.col("tag").isin(*group).cast("long")) / F.count(F.lit(1))

    return tagged.groupBy(*keys).agg(*[share(group).alias(name) for name, group in per_doc.TAG_RATIOS.items()])


def corpus_readability(df: DataFrame, text: str = "normalized_text", sentences: str = "sentences",
                       keep: Sequence[str] | None = None, learn: Column | None = None, size: int = EASY_WORDS) -> DataFrame:
    """The columns ``keep`` (all by default) and six readability columns, with the corpus's most frequent words as the easy ones.

    The list needs all texts before the first can be scored. Each text is cleaned and cut once: its words are staged with
    what else is kept, the list comes from these, and so does the number of words that are not on it. ``learn`` says which rows
    the list may come from: the training rows, for instance. Name ``keep`` without the texts, which are staged otherwise.
    """
    names = [*(df.columns if keep is None else keep)]
    scored = per_doc.readability_features(df, None, text, sentences, words="_easy").withColumn("_sentences", F.size(sentences))
    taught = F.lit(True) if learn is None else F.coalesce(learn, F.lit(False))
    staged = materialise(scored.select(*names, *READABILITY_FEATURES, "_easy", "_sentences", taught.alias("_taught")))
    listed = _most_frequent(staged.filter("_taught").select(F.explode("_easy").alias("word")), size)
    zero, hard = F.lit(0), per_doc.unlisted("_easy", listed)
    score = per_doc.readability_scores(F.size("_easy"), F.col("_sentences"), zero, zero, zero, hard)["dale_chall_readability"]
    return staged.withColumn("dale_chall_readability", score).drop("_easy", "_sentences", "_taught")


def extract_all_features(
    df: DataFrame,
    text: str = "normalized_text",
    tokens: str = "tokens",
    sentences: str = "sentences",
    easy_words: Sequence[str] | None = None,
    keep: Sequence[str] | None = None,
    learn: Column | None = None,
) -> DataFrame:
    """The columns ``keep`` (all by default) of a preprocessed table and all 29 features, without a shuffle.

    Without ``easy_words`` the list is taken from the corpus itself, from the rows that ``learn`` marks where given (see
    ``corpus_readability``): one small aggregate more, and the words of the texts are staged.
    """
    names = [*(df.columns if keep is None else keep)]
    df = per_doc.statistical_features(df, text, tokens, sentences)
    df = per_doc.perplexity_features(per_doc.linguistic_features(df, tokens), tokens)
    if easy_words is None:
        others = [name for name in ALL_FEATURES if name not in READABILITY_FEATURES]
        df = corpus_readability(df, text, sentences, [*names, *others], learn)
    else:
        df = per_doc.readability_features(df, easy_words, text, sentences)
    return df.select(*names, *ALL_FEATURES)


def attach_features(df: DataFrame, features: DataFrame, key: str = "text_id") -> DataFrame:
    """Join separately computed features to their documents by key, keeping every document."""
    names = [name for name in ALL_FEATURES if name in features.columns]
    return df.join(features.select(key, *names), key, "left")
