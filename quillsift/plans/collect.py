"""Collection jobs: landed articles, pages and model responses in, labelled text records out.

What a service returned is a landed table; each job filters it, keeps the first ``total`` rows in order and gives them the ids
and columns of the declared schemas.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from quillsift.operators.dataset import chunk_pages, filter_min_chars, filter_short_response, topic_title
from quillsift.operators.ordering import first_n, first_n_per_group, with_position
from quillsift.schemas import GENERATED_TEXT, HUMAN_TEXT

# Id prefixes, sources and methods of the records.
ARTICLE_PREFIX, ARTICLE_METHOD = "human", "newsapi"
CHUNK_PREFIX, CHUNK_SOURCE, CHUNK_METHOD = "human_wiki", "Wikipedia", "wikipedia_api"
RESPONSE_PREFIX, RESPONSE_SOURCE, RESPONSE_METHOD = "ai_gemini", "google_gemini_flash_latest", "gemini_api"


def _records(df: DataFrame, schema: T.StructType, order: Sequence[str | Column], total: int, prefix: str) -> DataFrame:
    """The first ``total`` rows in order, numbered from 0, in the columns of ``schema``."""
    placed = with_position(first_n(df, order, total), order, output="_position")
    named = placed.withColumn("text_id", F.format_string(f"{prefix}_%04d", F.col("_position") - F.lit(1)))
    return named.select(*[F.col(field.name).cast(field.dataType).alias(field.name) for field in schema.fields])


def article_records(articles: DataFrame, queries: int, total: int, order: Sequence[str]) -> DataFrame:
    """Human records from flattened articles: long enough, an equal share per query (one at least), ``total`` at most."""
    share = max(total // queries, 1)
    accepted = first_n_per_group(filter_min_chars(articles), ["query"], order, share).withColumns({
        "label": F.lit(0), "collection_method": F.lit(ARTICLE_METHOD),
    })
    return _records(accepted, HUMAN_TEXT, ["query", *order], total, ARTICLE_PREFIX)


def chunk_records(pages: DataFrame, total: int, order: Sequence[str]) -> DataFrame:
    """Human records from pages (``topic``, ``url``, ``content``): their chunks in page order, ``total`` at most."""
    chunks = chunk_pages(pages).withColumns({
        "label": F.lit(0), "source": F.lit(CHUNK_SOURCE), "title": topic_title(F.col("topic")), "published_at": F.lit(""),
        "query": F.col("topic"), "collection_method": F.lit(CHUNK_METHOD),
    })
    return _records(chunks, HUMAN_TEXT, [*order, "chunk_pos"], total, CHUNK_PREFIX)


def response_records(responses: DataFrame, total: int, order: Sequence[str]) -> DataFrame:
    """Generated records from responses (``prompt``, ``topic``, ``content``): not too short, ``total`` at most."""
    accepted = filter_short_response(responses).withColumns({
        "label": F.lit(1), "source": F.lit(RESPONSE_SOURCE), "collection_method": F.lit(RESPONSE_METHOD),
    })
    return _records(accepted, GENERATED_TEXT, order, total, RESPONSE_PREFIX)
