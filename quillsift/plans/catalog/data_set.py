"""Set operations, sampling, balance, splits, folds, counts and the data set jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillsift.operators import dataset, ordering, splits, summaries
from quillsift.plans import build
from quillsift.plans.catalog import bindings as bind, sql
from quillsift.plans.catalog.registry import query
from quillsift.sources import articles

# --- union and copies -------------------------------------------------------------------------

_UNION = f"""
SELECT id AS text_id, md5(content) AS text_md5, label, CASE WHEN label = 0 THEN 'user' ELSE 'assistant' END AS source,
  CASE WHEN label = 0 THEN 'chat' END AS query, CASE WHEN label = 1 THEN 'chat' END AS topic FROM ({sql.TURNS})"""


@query("union_corpora", _UNION)
def union_corpora(spark, sf_dir):
    return dataset.union_corpora(*bind.corpora(spark, sf_dir)).select(
        "text_id", F.md5("content").alias("text_md5"), "label", "source", "query", "topic"
    )


@query("dedup_exact", """
SELECT doc_id, md5(text) AS text_md5 FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1""")
def dedup_exact(spark, sf_dir):
    kept = dataset.dedup_exact(bind.documents(spark, sf_dir), "content", "doc_id")
    return kept.select("doc_id", F.md5("content").alias("text_md5"))


@query("dedup_report", """
SELECT count(*) AS n_rows, count(DISTINCT text) AS n_distinct, count(*) - count(DISTINCT text) AS n_removed FROM documents""")
def dedup_report(spark, sf_dir):
    return dataset.dedup_report(bind.documents(spark, sf_dir))


# --- order, limits, samples -------------------------------------------------------------------

@query("assign_text_id", """
SELECT doc_id, printf('text_%04d', row_number() OVER (ORDER BY doc_id) - 1) AS text_id FROM documents""")
def assign_text_id(spark, sf_dir):
    return ordering.assign_text_id(bind.documents(spark, sf_dir).select("doc_id"), ["doc_id"])


_LONG = "SELECT doc_id, source AS query FROM documents WHERE length(text) > 300"


@query("topk_per_query", f"""
SELECT doc_id, query FROM ({_LONG}) QUALIFY row_number() OVER (PARTITION BY query ORDER BY doc_id) <= 10""")
def topk_per_query(spark, sf_dir):
    rows = dataset.filter_min_chars(bind.table(spark, sf_dir, "documents"), "text")
    ranked = rows.select("doc_id", F.col("source").alias("query"))
    return ordering.first_n_per_group(ranked, ["query"], ["doc_id"], 10)


@query("global_cap", """
SELECT doc_id, query FROM (
  SELECT doc_id, source AS query FROM documents
  WHERE lang <> 'fr'
    AND length(coalesce(string_split(text, chr(10))[1], '') || '. '
      || coalesce(CASE WHEN lang <> 'es' THEN string_split(text, chr(10))[2] END, '') || ' ' || text) > 300
  QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 33
) ORDER BY query, doc_id LIMIT 500""")
def global_cap(spark, sf_dir):
    """An equal share for each of 15 places, all queries offered, 500 in total."""
    flat = articles.flatten_articles(articles.parse_responses(bind.landed_responses(spark, sf_dir)))
    return articles.collect_articles(flat, 15, 500, ["doc_id"]).select("doc_id", "query")


@query("shuffle_rows", f"""
SELECT doc_id, row_number() OVER (ORDER BY {sql.hash_key('doc_id')}, doc_id) AS position FROM documents""")
def shuffle_rows(spark, sf_dir):
    rows = bind.documents(spark, sf_dir).select("doc_id", ordering.hash_order("doc_id").alias("h"))
    return ordering.with_position(rows, ["h", "doc_id"]).drop("h")


@query("sample_n", f"SELECT doc_id, text AS content FROM documents ORDER BY {sql.hash_key('doc_id')}, doc_id LIMIT 100")
def sample_n(spark, sf_dir):
    return ordering.sample_n(bind.documents(spark, sf_dir), 100, "doc_id")


@query("sample_per_class", f"""
SELECT id AS doc_id, label FROM ({sql.LABELLED})
QUALIFY row_number() OVER (PARTITION BY label ORDER BY {sql.hash_key('id')}, id) <= 40""")
def sample_per_class(spark, sf_dir):
    rows = bind.labelled_documents(spark, sf_dir).select("doc_id", "label")
    return ordering.sample_per_class(rows, 40, ["label"], "doc_id")


_SMALLEST = "SELECT min(n) FROM (SELECT count(*) AS n FROM {rows} GROUP BY label)"


@query("balance_classes", f"""
WITH turns AS ({sql.TURNS})
SELECT id AS text_id, label FROM turns
QUALIFY row_number() OVER (PARTITION BY label ORDER BY {sql.hash_key('id')}, id) <= ({_SMALLEST.format(rows='turns')})""")
def balance_classes(spark, sf_dir):
    return dataset.balance_classes(bind.labelled_turns(spark, sf_dir)).select("text_id", "label")


@query("class_rank", f"""
SELECT id AS doc_id, label, row_number() OVER (PARTITION BY label ORDER BY {sql.hash_key('id')}, id) AS class_rank
FROM ({sql.LABELLED})""")
def class_rank(spark, sf_dir):
    rows = bind.labelled_documents(spark, sf_dir).select("doc_id", "label")
    return ordering.class_rank(rows, ["label"], "doc_id")


_RANKED = f"""
SELECT id AS doc_id, label, row_number() OVER (PARTITION BY label ORDER BY {sql.hash_key('id')}, id) AS r,
  count(*) OVER (PARTITION BY label) AS n FROM ({sql.LABELLED})"""


@query("stratified_split", f"SELECT doc_id, label, r <= round(0.2 * n) AS is_test FROM ({_RANKED})")
def stratified_split(spark, sf_dir):
    rows = bind.labelled_documents(spark, sf_dir).select("doc_id", "label")
    return splits.stratified_split(rows, "doc_id")


@query("stratified_folds", f"SELECT doc_id, label, (r - 1) % 5 AS fold FROM ({_RANKED})")
def stratified_folds(spark, sf_dir):
    rows = bind.labelled_documents(spark, sf_dir).select("doc_id", "label")
    return splits.stratified_folds(rows, "doc_id")


_SEEDS = ", ".join(f"({seed})" for seed in splits.STABILITY_SEEDS)


@query("multi_seed_split", f"""
SELECT doc_id, label, seed::BIGINT AS seed, r <= round(0.2 * n) AS is_test FROM (
  SELECT id AS doc_id, label, seed, count(*) OVER (PARTITION BY seed, label) AS n,
    row_number() OVER (PARTITION BY seed, label ORDER BY {sql.hash_key('id', 'seed')}, id) AS r
  FROM ({sql.LABELLED}) CROSS JOIN (VALUES {_SEEDS}) s(seed))""")
def multi_seed_split(spark, sf_dir):
    rows = bind.labelled_documents(spark, sf_dir).select("doc_id", "label")
    return splits.multi_seed_split(rows, "doc_id")


# --- counts -----------------------------------------------------------------------------------

@query("class_distribution", f"SELECT label, count(*) AS n FROM ({sql.LABELLED}) GROUP BY label")
def class_distribution(spark, sf_dir):
    return summaries.class_distribution(bind.labelled_documents(spark, sf_dir))


@query("null_counts", f"""
SELECT unnest(['text_id', 'source', 'query', 'topic']) AS "column",
  unnest([count(*) - count(text_id), count(*) - count(source), count(*) - count(query), count(*) - count(topic)]) AS nulls
FROM ({_UNION})""")
def null_counts(spark, sf_dir):
    return summaries.null_counts(
        dataset.union_corpora(*bind.corpora(spark, sf_dir)), ["text_id", "source", "query", "topic"]
    )


@query("nan_counts", """
WITH n AS (SELECT count(*) AS n, count(*) FILTER (event_type IN ('error', 'signup')) AS bad FROM events)
SELECT 'value' AS feature, bad AS nan_count, round(bad * 100.0::DOUBLE / n, 6) AS share_pct FROM n
UNION ALL SELECT 'total', bad, round(bad * 100.0::DOUBLE / (2 * n), 6) FROM n""")
def nan_counts(spark, sf_dir):
    rows = bind.gappy_events(spark, sf_dir).withColumn("whole", F.col("event_id").cast("double"))
    return summaries.nan_counts(rows, ["value", "whole"])


_FIRST = f"""
SELECT *, row_number() OVER (PARTITION BY content ORDER BY label, ingest_order) AS copy FROM ({sql.TURNS}) WHERE content IS NOT NULL"""
_CLEAN = f"SELECT * FROM ({_FIRST}) WHERE copy = 1 AND length(content) BETWEEN 300 AND 2000"


@query("cleaning_funnel", f"""
WITH steps AS (
  SELECT (SELECT count(*) FROM ({sql.TURNS})) AS initial, (SELECT count(*) FROM ({_FIRST})) AS not_null,
    (SELECT count(*) FROM ({_FIRST}) WHERE copy = 1) AS "distinct", count(*) AS length_ok,
    count(*) FILTER (label = 0) AS human, count(*) FILTER (label = 1) AS ai FROM ({_CLEAN})
)
SELECT unnest(['initial', 'not_null', 'distinct', 'length_ok', 'human', 'ai', 'balanced']) AS stage,
  unnest([initial, not_null, "distinct", length_ok, human, ai, 2 * least(human, ai)]) AS rows FROM steps""")
def cleaning_funnel(spark, sf_dir):
    return summaries.cleaning_funnel(dataset.union_corpora(*bind.corpora(spark, sf_dir)))


@query("dataset_summary", f"""
SELECT count(*) AS total, count(*) FILTER (label = 0) AS human, count(*) FILTER (label = 1) AS ai,
  round(avg(length(content)), 6) AS avg_chars FROM ({sql.TURNS})""")
def dataset_summary(spark, sf_dir):
    return summaries.dataset_summary(bind.labelled_turns(spark, sf_dir))


# --- jobs -------------------------------------------------------------------------------------

def _balanced(rows: str) -> str:
    return f"""
WITH kept AS ({rows})
SELECT id AS text_id, label, md5(content) AS text_md5 FROM kept
QUALIFY row_number() OVER (PARTITION BY label ORDER BY {sql.hash_key('id')}, id) <= ({_SMALLEST.format(rows='kept')})"""


@query("build_dataset", f"SELECT *, '2024-05-01' AS collection_date FROM ({_balanced(_CLEAN)})")
def build_dataset(spark, sf_dir):
    final = build.build_dataset(*bind.corpora(spark, sf_dir), date="2024-05-01")
    return final.select("text_id", "label", F.md5("content").alias("text_md5"), "collection_date")


@query("build_dataset_simple", _balanced(sql.TURNS))
def build_dataset_simple(spark, sf_dir):
    final = build.build_dataset(*bind.corpora(spark, sf_dir), clean=False)
    return final.select("text_id", "label", F.md5("content").alias("text_md5"))


@query("load_and_clean", rf"""
SELECT printf('text_%04d', row_number() OVER (ORDER BY id) - 1) AS text_id, id AS doc_id, label, word_count
FROM (SELECT id, label, len(regexp_extract_all(content, '[^{sql.WS}]+'))::BIGINT AS word_count
  FROM ({sql.LABELLED}) WHERE content IS NOT NULL AND label IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY content ORDER BY id) = 1)
WHERE word_count BETWEEN 300 AND 1000""")
def load_and_clean(spark, sf_dir):
    cleaned = build.load_and_clean(bind.labelled_documents(spark, sf_dir), order="doc_id")
    return cleaned.select("text_id", "doc_id", "label", "word_count")
