"""From raw labelled texts to a clean, balanced data set."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame, functions as F

from quillsift.functions.cleaning import strip_blank
from quillsift.functions.tokens import word_count
from quillsift.operators.ordering import flag_first, hash_order
from quillsift.session import materialise

# Default length limits.
MIN_ARTICLE_CHARS = 300
MIN_RESPONSE_CHARS = 100
MIN_CHARS, MAX_CHARS = 300, 2000
MIN_WORDS, MAX_WORDS = 300, 1000


# --- projections ------------------------------------------------------------------------------

def compose_text(title: Column, description: Column, content: Column) -> Column:
    """``title. description content``; a missing part counts as empty."""
    part = [F.coalesce(piece, F.lit("")) for piece in (title, description, content)]
    return F.concat(part[0], F.lit(". "), part[1], F.lit(" "), part[2])


def tag_corpus(df: DataFrame, label: int, source: str, collection_method: str) -> DataFrame:
    return df.withColumns({
        "label": F.lit(label), "source": F.lit(source), "collection_method": F.lit(collection_method),
    })


def topic_title(topic: Column) -> Column:
    return F.replace(topic, F.lit("_"), F.lit(" "))


def collection_date(date: str | None = None) -> Column:
    """Today, or a given day so that a run can be repeated, as ``yyyy-MM-dd``."""
    return F.lit(date) if date else F.date_format(F.current_date(), "yyyy-MM-dd")


# --- filters ----------------------------------------------------------------------------------

def filter_min_chars(df: DataFrame, column: str = "content", more_than: int = MIN_ARTICLE_CHARS) -> DataFrame:
    return df.filter(F.length(column) > more_than)


def filter_short_response(df: DataFrame, column: str = "content", at_least: int = MIN_RESPONSE_CHARS) -> DataFrame:
    return df.filter(F.length(strip_blank(F.col(column))) >= at_least)


def filter_not_null(df: DataFrame, *columns: str) -> DataFrame:
    return df.dropna(subset=list(columns))


def filter_char_range(df: DataFrame, column: str = "content", low: int = MIN_CHARS,
                      high: int = MAX_CHARS) -> DataFrame:
    return df.filter(F.length(column).between(low, high))


def filter_word_range(df: DataFrame, column: str = "content", low: int = MIN_WORDS,
                      high: int = MAX_WORDS) -> DataFrame:
    """Keeps texts by word count and leaves the count in ``word_count``."""
    return df.withColumn("word_count", word_count(F.col(column))).filter(F.col("word_count").between(low, high))


def filter_class(df: DataFrame, label: int, column: str = "label") -> DataFrame:
    return df.filter(F.col(column) == label)


# --- set operations ---------------------------------------------------------------------------

def union_corpora(human: DataFrame, generated: DataFrame) -> DataFrame:
    """All rows of both by column name; columns one side lacks are null there.

    ``corpus_position`` is 0 for human rows and 1 for generated ones: where both number their rows from 0, it
    says which come first.
    """
    return human.withColumn("corpus_position", F.lit(0)).unionByName(
        generated.withColumn("corpus_position", F.lit(1)), allowMissingColumns=True)


def corpus_order(df: DataFrame, order: str = "ingest_order") -> list[str]:
    """The columns that put the rows of a union in their order: corpus, place in it, id."""
    return [name for name in ("corpus_position", order, "text_id") if name in df.columns]


def text_digest(text: Column) -> Column:
    """64 bits that stand for a text; equal ones are compared as texts."""
    return F.xxhash64(text)


def _later_digest(text: Column, turn: int) -> Column:
    return F.sha2(F.concat(F.lit(f"{turn}|"), text), 256)


def dedup_exact(df: DataFrame, column: str = "content", order: str | Sequence[str] = "ingest_order",
                digest: Callable[[Column], Column] = text_digest) -> DataFrame:
    """Keeps the first row, by ``order`` (one column or several), of each distinct ``column`` value; null counts as one.

    Digests are counted first, in narrow rows. Rows whose digest occurs once pass where they lie. The others are
    merged per digest in each map task, so a text that makes up a third of the table reaches its reducer as one row per
    task; the least and the greatest text of a digest are equal only if all its texts are. Should they differ, the rows of
    that digest are told apart by another one, until all are.
    """
    order = [order] if isinstance(order, str) else list(order)
    columns, text = [F.col(f"`{name}`") for name in df.columns], F.col(f"`{column}`")
    keyed = df.withColumn("_digest", F.coalesce(digest(text).cast("string"), F.lit("")))
    repeated = keyed.groupBy("_digest").agg(F.count(F.lit(1)).alias("_rows")).filter("_rows > 1").select("_digest")
    kept = [keyed.join(repeated, "_digest", "left_anti").select(*columns)]
    copies = keyed.join(repeated, "_digest", "left_semi")
    for turn in count(1):
        merged = materialise(copies.groupBy("_digest").agg(
            F.min_by(F.struct(*columns), F.struct(*order)).alias("_first"), F.count(F.lit(1)).alias("_rows"),
            F.count(text).alias("_texts"), F.min(text).alias("_least"), F.max(text).alias("_greatest")))
        alike = F.col("_least").eqNullSafe(F.col("_greatest")) & F.col("_texts").isin(F.lit(0), F.col("_rows"))
        kept.append(merged.filter(alike).select("_first.*"))
        torn = merged.filter(~alike).select("_digest")
        if torn.isEmpty():
            return reduce(DataFrame.unionByName, kept)
        copies = copies.join(torn, "_digest", "left_semi").withColumn(
            "_digest", F.concat_ws("|", "_digest", _later_digest(text, turn)))


def dedup_report(df: DataFrame, column: str = "content") -> DataFrame:
    """Rows, distinct texts and the difference, over a digest so that texts are not shuffled."""
    digests = df.select(F.sha2(F.col(column), 256).alias("_digest"))
    copies = digests.groupBy("_digest").agg(F.count(F.lit(1)).alias("_rows"))
    return copies.agg(
        F.coalesce(F.sum("_rows"), F.lit(0)).alias("n_rows"),
        F.count(F.lit(1)).alias("n_distinct"),
        F.coalesce(F.sum(F.col("_rows") - 1), F.lit(0)).alias("n_removed"),
    )


# --- labels -----------------------------------------------------------------------------------

@dataclass
class Binding:
    """Labelled rows, and the joined table that says which keys matched or lacked the other side."""

    rows: DataFrame
    joined: DataFrame

    def counts(self) -> dict[str, int]:
        sides = [F.count_if(F.col("_side") == name).alias(name) for name in ("matched", "without_label", "without_text")]
        return self.joined.agg(*sides).first().asDict()


def bind_labels(df: DataFrame, labels: DataFrame, key: str, label: str = "label") -> Binding:
    """The rows of ``df`` that have a label in ``labels(key, label)``, with it, and an audit of those that have none.

    The join is staged with the side that each row came from, so the audit reads one short column and joins nothing again.
    (``DataFrame.observe`` would count while the rows pass, but a session that has observed cannot run the
    closures of ``pyspark.ml`` models any more.) A null key matches nothing, and a null label is no label; a key
    that is repeated on one side matches each time.
    """
    ours = df.withColumn("_ours", F.lit(True))
    theirs = labels.select(F.col(key), F.col(label).alias("_label")).filter(F.col("_label").isNotNull())
    side = F.when(F.col("_ours").isNull(), "without_text").when(F.col("_label").isNull(), "without_label").otherwise("matched")
    joined = materialise(ours.join(theirs, key, "full").withColumn("_side", side))
    kept = [F.col(f"`{name}`") for name in df.columns if name != label]
    return Binding(joined.filter("_side = 'matched'").select(*kept, F.col("_label").alias(label)), joined)


# --- balance ----------------------------------------------------------------------------------

def balance_classes(df: DataFrame, id_column: str = "text_id", label: str = "label", seed: int = 42) -> DataFrame:
    """A repeatable sample of each class, as large as the smallest class. Rows without a label are of no class.

    ``df`` is read three times (see ``flag_first``).
    """
    chosen = flag_first(df, [label], id_column, F.col("_smallest"), seed, "_chosen")
    return chosen.filter("_chosen").drop("_chosen")


# --- chunks -----------------------------------------------------------------------------------

# Chunk size and count, and how few paragraphs make lines count too.
CHUNK_CHARS = 200
CHUNKS_PER_PAGE = 5
FEW_PARAGRAPHS = 3


def page_chunks(text: Column, per_page: int = CHUNKS_PER_PAGE) -> Column:
    """Up to ``per_page`` chunks of a page: its long paragraphs, with its long lines added when
    there are fewer than three of those."""
    def long_parts(separator: str) -> Column:
        parts = F.transform(F.split(text, separator), strip_blank)
        return F.filter(parts, lambda part: F.length(part) > CHUNK_CHARS)

    paragraphs = long_parts("\n\n")
    found = F.when(F.size(paragraphs) < FEW_PARAGRAPHS, F.concat(paragraphs, long_parts("\n"))).otherwise(paragraphs)
    flat = F.transform(
        F.slice(found, 1, per_page), lambda part: strip_blank(F.translate(part, "\n", " "))
    )
    return F.filter(flat, lambda part: F.length(part) >= CHUNK_CHARS)


def chunk_pages(df: DataFrame, text: str = "content", per_page: int = CHUNKS_PER_PAGE) -> DataFrame:
    """One row per chunk, numbered by ``chunk_pos`` from 0."""
    others = [name for name in df.columns if name != text]
    return df.select(*others, F.posexplode(page_chunks(F.col(text), per_page)).alias("chunk_pos", text))


# --- prompts ----------------------------------------------------------------------------------

# Default topics, prompt templates and text lengths.
TOPICS = [
    "artificial intelligence", "machine learning", "climate change", "renewable energy",
    "technology", "education", "healthcare", "space exploration", "cybersecurity",
    "data science", "biotechnology", "social media", "automation", "robotics",
]
PROMPT_TEMPLATES = [
    "Write a {length}-word informative article about {topic} and its impact on society.",
    "Explain the importance of {topic} in modern times. Write about {length} words.",
    "Discuss the future of {topic} and provide detailed analysis. Around {length} words.",
    "Analyze how {topic} is changing our world. Write a {length}-word essay.",
    "Describe the benefits and challenges of {topic}. Write approximately {length} words.",
    "Write an educational piece about {topic} for a general audience. {length} words.",
    "Explore the role of {topic} in addressing global challenges. {length} words.",
    "Provide a comprehensive overview of {topic} and its applications. {length} words.",
]
PROMPT_LENGTHS = [300, 400, 500]


def fill_prompt(template: Column, topic: Column, length: Column) -> Column:
    with_topic = F.replace(template, F.lit("{topic}"), topic)
    return F.replace(with_topic, F.lit("{length}"), length.cast("string"))


def _literals(values: Sequence) -> Column:
    return F.array(*[F.lit(value) for value in values])


def prompt_grid(topics: DataFrame, templates: Sequence[str] = PROMPT_TEMPLATES,
                lengths: Sequence[int] = PROMPT_LENGTHS) -> DataFrame:
    """Every prompt for every row of ``topics(topic)``, each topic expanded where it lies."""
    return (
        topics.select("topic", F.explode(_literals(templates)).alias("template"))
        .withColumn("length", F.explode(_literals(lengths)))
        .select("topic", "length", fill_prompt(F.col("template"), F.col("topic"), F.col("length")).alias("prompt"))
    )


def prompt_sample(attempts: DataFrame, id_column: str, seed: int = 42, topics: Sequence[str] = TOPICS,
                  templates: Sequence[str] = PROMPT_TEMPLATES,
                  lengths: Sequence[int] = PROMPT_LENGTHS) -> DataFrame:
    """One prompt for each attempt; topic, template and length drawn independently."""
    def draw(part: str, values: Sequence) -> Column:
        key = F.md5(F.concat_ws("|", F.col(id_column).cast("string"), F.lit(str(seed)), F.lit(part)))
        number = F.conv(F.substring(key, 1, 8), 16, 10).cast("long")
        return F.get(_literals(values), (number % len(values)).cast("int"))

    drawn = attempts.withColumns({
        "topic": draw("topic", topics), "template": draw("template", templates), "length": draw("length", lengths),
    })
    return drawn.withColumn("prompt", fill_prompt(F.col("template"), F.col("topic"), F.col("length"))).drop("template")


def preview_per_class(df: DataFrame, id_column: str = "text_id", label: str = "label", content: str = "content",
                      chars: int = 200, seed: int = 42) -> DataFrame:
    """The beginning of one text of each class: the first in hash order."""
    start = F.concat(F.substring(F.col(content), 1, chars), F.lit("..."))
    order = F.concat_ws("|", hash_order(id_column, seed), F.col(id_column).cast("string"))
    return df.groupBy(label).agg(F.min_by(start, order).alias("preview"))
