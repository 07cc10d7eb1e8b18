"""The 29 per-document features as row-local expressions: no shuffle, no Python.

Each builder adds columns next to the ones it reads. Arrays that several features share are
put in a column first, so that they are computed once, and dropped afterwards.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from quillsift.functions import lexicon
from quillsift.functions.tokens import bare_words, ngrams, word_count

# The characters counted by ``punctuation_ratio``.
PUNCTUATION_MARKS = ".,!?;:'\""

# A word list travels with every task, so its size is checked.
MAX_LITERAL_WORDS = 20_000


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part.cast("double") / whole).otherwise(F.lit(0.0))


def _occurrences(text: Column, mark: str) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))).cast("double")


def syllables(word: Column) -> Column:
    """Vowel groups, less a silent final e, at least one."""
    silent = word.rlike("[^aeiouyl]e$").cast("int")
    return F.greatest(F.regexp_count(word, F.lit("[aeiouy]+")) - silent, F.lit(1))


def word_entropy(tokens: Column) -> Column:
    """Shannon entropy (bits) of the token distribution.

    Sorting brings equal tokens together; a fold over the run lengths c then gives
    log2(W) - sum(c * log2(c)) / W in time linear in the sorted array.
    """
    size = F.size(tokens)

    def weight(run: Column) -> Column:
        return run * F.log2(run)

    start = F.struct(F.lit("").alias("word"), F.lit(1.0).alias("run"), F.lit(0.0).alias("total"))

    def step(state: Column, token: Column) -> Column:
        same = token == state["word"]
        return F.struct(
            token.alias("word"),
            F.when(same, state["run"] + 1.0).otherwise(F.lit(1.0)).alias("run"),
            F.when(same, state["total"]).otherwise(state["total"] + weight(state["run"])).alias("total"),
        )

    folded = F.aggregate(
        F.sort_array(tokens), start, step, lambda state: state["total"] + weight(state["run"])
    )
    return F.when(size > 0, F.log2(size) - folded / size).otherwise(F.lit(0.0))


def sentence_length_std(sentences: Column) -> Column:
    """Population standard deviation of words per sentence; 0 unless there are two sentences.

    The sums stay whole numbers, so nothing is lost to cancellation.
    """
    lengths = F.transform(sentences, lambda sentence: word_count(sentence).cast("long"))
    zero = F.lit(0).cast("long")
    total = F.aggregate(lengths, zero, lambda acc, x: acc + x)
    squares = F.aggregate(lengths, zero, lambda acc, x: acc + x * x)
    n = F.size(sentences).cast("long")
    return F.when(n > 1, F.sqrt((n * squares - total * total).cast("double")) / n).otherwise(F.lit(0.0))


def paragraph_count(text: Column) -> Column:
    """Non-blank parts between empty lines (one at most on cleaned text)."""
    return F.size(F.filter(F.split(text, "\n\n"), lambda part: word_count(part) > 0)).cast("double")


def statistical_features(
    df: DataFrame, text: str = "normalized_text", tokens: str = "tokens", sentences: str = "sentences"
) -> DataFrame:
    """14 columns on lengths, vocabulary and punctuation."""
    df = df.withColumn("_distinct", F.size(F.array_distinct(tokens)))
    words, body = F.size(tokens), F.col(text)
    richness = _ratio(F.col("_distinct"), words)
    marks = F.length(body) - F.length(F.translate(body, PUNCTUATION_MARKS, ""))
    return df.withColumns({
        "avg_word_length": _ratio(F.length(F.array_join(tokens, "")), words),
        "avg_sentence_length": _ratio(words, F.size(sentences)),
        "vocabulary_richness": richness,
        "unique_word_count": F.col("_distinct").cast("double"),
        "lexical_diversity": richness,
        "punctuation_ratio": _ratio(marks, F.length(body)),
        "comma_count": _occurrences(body, ","),
        "period_count": _occurrences(body, "."),
        "exclamation_count": _occurrences(body, "!"),
        "question_count": _occurrences(body, "?"),
        "semicolon_count": _occurrences(body, ";"),
        "colon_count": _occurrences(body, ":"),
        "sentence_length_std": sentence_length_std(F.col(sentences)),
        "paragraph_count": paragraph_count(body),
    }).drop("_distinct")


def _is_listed(name: str, words: Sequence[str]) -> str:
    """A membership test as SQL text: thousands of words reach the JVM in one call."""
    escaped = (word.replace("\\", "\\\\").replace("'", "\\'") for word in words)
    listed = ", ".join(f"'{word}'" for word in escaped)
    return f"{name} IN ({listed})" if listed else "false"


def unlisted(words: str, easy_words: Sequence[str]) -> Column:
    """How many of an array column's words are not in the list."""
    return F.expr(f"size(filter({words}, word -> NOT {_is_listed('word', easy_words)}))")


def readability_counts(df: DataFrame, text: str, easy_words: Sequence[str] | None, words: str | None = None) -> DataFrame:
    """Adds ``_words``, ``_letters``, ``_syllables``, ``_poly`` and ``_hard`` for the formulas, and the words themselves as
    ``words`` where named.

    ``easy_words`` is a literal list of a few thousand entries at most; Spark turns membership
    into a hash look-up, so no join is needed. A longer list than that is refused: ``difficult_words`` joins one of
    any size. Without a list no word is difficult.
    """
    if easy_words is not None and len(easy_words) > MAX_LITERAL_WORDS:
        raise ValueError(f"at most {MAX_LITERAL_WORDS} words can be held as a literal list")
    df = df.withColumn("_bare", bare_words(F.col(text)))
    df = df.withColumn("_per_word", F.transform("_bare", syllables))
    hard = F.lit(0) if easy_words is None else unlisted("_bare", easy_words)
    if words is not None:
        df = df.withColumn(words, F.col("_bare"))
    return df.withColumns({
        "_words": F.size("_bare"),
        "_letters": F.length(F.replace(F.col(text), F.lit(" "), F.lit(""))),
        "_syllables": F.aggregate("_per_word", F.lit(0), lambda acc, x: acc + x),
        "_poly": F.size(F.filter("_per_word", lambda x: x >= 3)),
        "_hard": hard,
    }).drop("_bare", "_per_word")


def readability_scores(words: Column, sentences: Column, letters: Column, syllable_total: Column,
                       polysyllables: Column, hard_words: Column) -> dict[str, Column]:
    """The six published formulas over plain counts; all 0 on a document without words."""
    usable = (words > 0) & (sentences > 0)
    n = words.cast("double")
    per_sentence = n / sentences
    per_word = syllable_total / n
    hard_share = F.lit(100.0) * hard_words / n

    def guarded(score: Column) -> Column:
        return F.when(usable, score).otherwise(F.lit(0.0))

    return {
        "flesch_reading_ease": guarded(206.835 - 1.015 * per_sentence - 84.6 * per_word),
        "flesch_kincaid_grade": guarded(0.39 * per_sentence + 11.8 * per_word - 15.59),
        "automated_readability_index": guarded(4.71 * (letters / n) + 0.5 * per_sentence - 21.43),
        "dale_chall_readability": guarded(
            0.1579 * hard_share + 0.0496 * per_sentence
            + F.when(hard_share > 5, F.lit(3.6365)).otherwise(F.lit(0.0))
        ),
        "gunning_fog": guarded(0.4 * (per_sentence + 100.0 * polysyllables / n)),
        "smog_index": F.when(
            usable & (sentences >= 3), 1.0430 * F.sqrt(30.0 * polysyllables / sentences) + 3.1291
        ).otherwise(F.lit(0.0)),
    }


def readability_features(df: DataFrame, easy_words: Sequence[str] | None = None,
                         text: str = "normalized_text", sentences: str = "sentences", words: str | None = None) -> DataFrame:
    """Six readability columns, and the words that they count as ``words`` where named."""
    df = readability_counts(df, text, easy_words, words)
    scores = readability_scores(
        F.col("_words"), F.size(sentences), F.col("_letters"), F.col("_syllables"), F.col("_poly"), F.col("_hard")
    )
    return df.withColumns(scores).drop("_words", "_letters", "_syllables", "_poly", "_hard")


TAG_RATIOS = {
    "noun_ratio": lexicon.NOUN_TAGS,
    "verb_ratio": lexicon.VERB_TAGS,
    "adjective_ratio": lexicon.ADJECTIVE_TAGS,
    "adverb_ratio": lexicon.ADVERB_TAGS,
    "pronoun_ratio": lexicon.PRONOUN_TAGS,
}


def tag_ratios(df: DataFrame, tokens: str = "tokens") -> DataFrame:
    """Share of nouns, verbs, adjectives, adverbs and pronouns among the tokens."""
    def share(group: Sequence[str]) -> Column:
        return _ratio(F.size(F.filter("_tags", lambda tag: tag.isin(*group))), F.size("_tags"))

    df = df.withColumn("_tags", F.expr(
        f"transform(transform({tokens}, token -> lower(token)), token -> {lexicon.pos_tag('token')})"
    ))
    return df.withColumns({name: share(group) for name, group in TAG_RATIOS.items()}).drop("_tags")


def ngram_diversity(df: DataFrame, tokens: str = "tokens") -> DataFrame:
    """Distinct share of bigrams and trigrams; 0 for documents that have none."""
    df = df.withColumns({"_bigrams": ngrams(F.col(tokens), 2), "_trigrams": ngrams(F.col(tokens), 3)})
    return df.withColumns({
        "bigram_diversity": _ratio(F.size(F.array_distinct("_bigrams")), F.size("_bigrams")),
        "trigram_diversity": _ratio(F.size(F.array_distinct("_trigrams")), F.size("_trigrams")),
    }).drop("_bigrams", "_trigrams")


def linguistic_features(df: DataFrame, tokens: str = "tokens") -> DataFrame:
    """Five word class ratios and two n-gram ratios."""
    return ngram_diversity(tag_ratios(df, tokens), tokens)


def perplexity_features(df: DataFrame, tokens: str = "tokens") -> DataFrame:
    """Token entropy and distinct share (there is no language model behind the name)."""
    return df.withColumns({
        "word_entropy": word_entropy(F.col(tokens)),
        "unique_word_ratio": _ratio(F.size(F.array_distinct(tokens)), F.size(tokens)),
    })
