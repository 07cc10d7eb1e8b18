"""Landed article responses: one JSON document per response."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quillsift.operators.dataset import compose_text, filter_min_chars
from quillsift.operators.ordering import first_n, first_n_per_group
from quillsift.schemas import ARTICLE_RESPONSE


def parse_responses(landed: DataFrame, body: str = "body") -> DataFrame:
    """Adds ``response``, the parsed JSON; the other columns stay."""
    return landed.withColumn("response", F.from_json(body, ARTICLE_RESPONSE)).drop(body)


def rejected_responses(parsed: DataFrame) -> DataFrame:
    """Responses whose status is not ``ok``, with their message."""
    others = [name for name in parsed.columns if name != "response"]
    failed = ~F.col("response.status").eqNullSafe("ok")
    return parsed.filter(failed).select(
        *others, F.coalesce("response.message", F.lit("Unknown error")).alias("message")
    )


def flatten_articles(parsed: DataFrame) -> DataFrame:
    """One row per article of the accepted responses, in API order (``rank``)."""
    others = [name for name in parsed.columns if name != "response"]
    articles = parsed.filter(F.col("response.status") == "ok").select(
        *others, F.posexplode("response.articles").alias("rank", "article")
    )
    text = compose_text(F.col("article.title"), F.col("article.description"), F.col("article.content"))
    return articles.select(
        *others, "rank",
        text.alias("content"),
        F.coalesce("article.source.name", F.lit("unknown")).alias("source"),
        F.coalesce("article.title", F.lit("")).alias("title"),
        F.coalesce("article.url", F.lit("")).alias("url"),
        F.coalesce("article.publishedAt", F.lit("")).alias("published_at"),
    )


def collect_articles(articles: DataFrame, queries: int, total: int, order: list[str]) -> DataFrame:
    """Long enough articles, an equal share for each query, at most ``total`` overall.

    ``order`` ranks articles within a query. A share below one is taken as one.
    """
    share = max(total // queries, 1)
    accepted = first_n_per_group(filter_min_chars(articles), ["query"], order, share)
    return first_n(accepted, ["query", *order], total)
