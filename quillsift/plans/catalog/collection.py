"""The collection jobs on landed forms of the supplied tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillsift.plans import collect
from quillsift.plans.catalog import bindings as bind, sql
from quillsift.plans.catalog.registry import query
from quillsift.plans.catalog.texts import _CHUNKS
from quillsift.sources import articles

# Fixed value: records a job collects by default.
DEFAULT_TOTAL = 500


def _shown(records):
    """Texts as digests."""
    return records.withColumn("content", F.md5("content"))


@query("human_articles", """
WITH flat AS (
  SELECT doc_id, source AS query, CASE WHEN lang <> 'de' THEN source ELSE 'unknown' END AS source,
    coalesce(string_split(text, chr(10))[1], '') AS title, 'https://example.org/' || doc_id AS url,
    CASE WHEN lang <> 'es' THEN '2024-01-01' ELSE '' END AS published_at,
    coalesce(string_split(text, chr(10))[1], '') || '. '
      || coalesce(CASE WHEN lang <> 'es' THEN string_split(text, chr(10))[2] END, '') || ' ' || text AS content
  FROM documents WHERE lang <> 'fr'),
kept AS (SELECT * FROM flat WHERE length(content) > 300 QUALIFY row_number() OVER (PARTITION BY query ORDER BY doc_id) <= 33)
SELECT printf('human_%04d', row_number() OVER (ORDER BY query, doc_id) - 1) AS text_id, md5(content) AS content, 0::BIGINT AS label,
  source, title, url, published_at, query, 'newsapi' AS collection_method FROM kept ORDER BY query, doc_id LIMIT 500""")
def human_articles(spark, sf_dir):
    flat = articles.flatten_articles(articles.parse_responses(bind.landed_responses(spark, sf_dir)))
    return _shown(collect.article_records(flat, 15, DEFAULT_TOTAL, ["doc_id"]))


@query("human_chunks", f"""
SELECT printf('human_wiki_%04d', row_number() OVER (ORDER BY doc_id, chunk_pos) - 1) AS text_id, md5(content) AS content,
  0::BIGINT AS label, 'Wikipedia' AS source, 'page ' || doc_id AS title, 'https://example.org/' || doc_id AS url,
  '' AS published_at, 'page_' || doc_id AS query, 'wikipedia_api' AS collection_method
FROM ({_CHUNKS}) ORDER BY doc_id, chunk_pos LIMIT 500""")
def human_chunks(spark, sf_dir):
    ident = F.col("doc_id").cast("string")
    pages = bind.documents(spark, sf_dir).withColumns({
        "topic": F.concat(F.lit("page_"), ident), "url": F.concat(F.lit("https://example.org/"), ident),
    })
    return _shown(collect.chunk_records(pages, DEFAULT_TOTAL, ["doc_id"]))


@query("generated_texts", f"""
SELECT printf('ai_gemini_%04d', row_number() OVER (ORDER BY ingest_order) - 1) AS text_id, md5(content) AS content, 1::BIGINT AS label,
  'google_gemini_flash_latest' AS source, 'about chat' AS prompt, 'chat' AS topic, 'gemini_api' AS collection_method
FROM ({sql.TURNS}) WHERE label = 1 AND length(trim(content, {sql.BLANKS})) >= 100 ORDER BY ingest_order LIMIT 500""")
def generated_texts(spark, sf_dir):
    _, generated = bind.corpora(spark, sf_dir)
    return _shown(collect.response_records(generated.withColumn("prompt", F.lit("about chat")), DEFAULT_TOTAL, ["ingest_order"]))
