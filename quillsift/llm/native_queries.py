"""Queries of the operators that use DataFrame functions only, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quillsift.llm.exact import exact_duplicates
from quillsift.llm.hosts import judge_urls
from quillsift.llm.lines import drop_repeated_lines
from quillsift.llm.registry import query, table

EXACT_SQL = """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""


@query("op6_exact_dedup", EXACT_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


def _level(name: str, groups: str, key: str, parents: str) -> str:
    """One level of shrinkage: groups (n, bad) joined to their parents' means."""
    return f"""
{name}_p AS (SELECT g.*, p.mean AS prior FROM {groups} g JOIN {parents} p ON g.{key} IS NOT DISTINCT FROM p.{key}),
{name}_m AS (SELECT count(*) FILTER (n > 0) AS k, sum(n::DOUBLE) AS total, sum(n::DOUBLE * n) AS squares,
  sum(n * pow(bad::DOUBLE / n - prior, 2) / (prior * (1 - prior))) FILTER (n > 0) AS spread FROM {name}_p),
{name}_r AS (SELECT CASE WHEN k < 2 OR total - squares / total - (k - 1) <= 0 THEN 0.2::DOUBLE
  ELSE least(greatest((spread - (k - 1)) / (total - squares / total - (k - 1)), 0.001), 0.9) END AS rho FROM {name}_m),
{name}_s AS (SELECT p.*, (1 - rho) / rho AS strength,
  ((1 - rho) / rho * prior + bad) / ((1 - rho) / rho + n) AS mean FROM {name}_p p, {name}_r)"""


HOSTS_SQL = f"""
WITH cut AS (SELECT page_id, position('://' IN coalesce(url, '')) AS mark, coalesce(url, '') AS url FROM pages),
rest AS (SELECT page_id, CASE WHEN mark > 0 THEN regexp_extract(substr(url, mark + 3), '^([^?#]*)', 1) ELSE '' END AS r FROM cut),
split AS (SELECT page_id, translate(regexp_extract(r, '^([^/]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
  'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(r, '^[^/]*(.*)$', 1, 's') AS path FROM rest),
rules(verdict, rhost, rpath) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'),
  ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
ruled AS (SELECT page_id, host, path, max_by(rhost || rpath, length(rhost || rpath)) AS rule,
  max_by(verdict, length(rhost || rpath)) AS ruled FROM split LEFT JOIN rules
  ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY ALL),
labelled AS (SELECT host, split_part(host, '.', -1) AS suffix,
  CASE WHEN contains(host, '.') THEN split_part(host, '.', -2) || '.' || split_part(host, '.', -1) ELSE host END AS domain,
  count(ruled) AS n, count(*) FILTER (ruled = 'block') AS bad FROM ruled GROUP BY ALL),
domains AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM labelled GROUP BY ALL),
tops AS (SELECT suffix, 0 AS every, sum(n) AS n, sum(bad) AS bad FROM domains GROUP BY ALL),
whole AS (SELECT 0 AS every, (sum(bad) + 1)::DOUBLE / (sum(n) + 2) AS mean FROM tops),
{_level("top", "tops", "every", "whole")},
{_level("dom", "domains", "suffix", "top_s")},
{_level("hos", "labelled", "domain", "dom_s")},
judged AS (SELECT host, mean AS risk, mean - 1.645 * sqrt(mean * (1 - mean) / (strength + n + 1)) AS risk_lower FROM hos_s)
SELECT page_id, r.host, path, rule, coalesce(ruled, CASE WHEN risk_lower > 0.5 THEN 'block' ELSE 'allow' END) AS verdict,
  round(risk, 6) AS risk, round(risk_lower, 6) AS risk_lower
FROM ruled r JOIN judged j ON r.host = j.host
"""


@query("op4_url_filter", HOSTS_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages").select("page_id", "url")).select(
        "page_id", "host", "path", "rule", "verdict", F.round("risk", 6).alias("risk"),
        F.round("risk_lower", 6).alias("risk_lower"))


# Every window is compared here; winnowing must come to the same lines.
LINES_SQL = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos
  FROM documents WHERE text IS NOT NULL),
counted AS (
  SELECT doc_id, pos, line, len(list_filter(regexp_split_to_array(line, '[\\x09-\\x0D\\x20]+'), lambda w: w <> '')) AS words
  FROM lines),
worded AS (
  SELECT *, sum(words) OVER (PARTITION BY doc_id ORDER BY pos) AS upto FROM counted WHERE words > 0),
sides AS (
  SELECT doc_id, pos AS a, max(pos) OVER f AS b, sum(words) OVER f AS total, string_agg(line, chr(10)) OVER f AS content
  FROM worded WINDOW f AS (PARTITION BY doc_id ORDER BY upto - words RANGE BETWEEN CURRENT ROW AND 49 FOLLOWING)
  UNION
  SELECT doc_id, min(pos) OVER p AS a, pos AS b, sum(words) OVER p AS total, string_agg(line, chr(10)) OVER p AS content
  FROM worded WINDOW p AS (PARTITION BY doc_id ORDER BY upto RANGE BETWEEN 49 PRECEDING AND CURRENT ROW)),
later AS (
  SELECT doc_id, a, b, row_number() OVER (PARTITION BY content ORDER BY doc_id, a) AS n FROM sides WHERE total >= 50),
gone AS (
  SELECT DISTINCT w.doc_id, w.pos FROM worded w JOIN later l ON w.doc_id = l.doc_id AND w.pos BETWEEN l.a AND l.b AND l.n > 1),
kept AS (
  SELECT l.doc_id, count(g.pos) AS n_lines_dropped,
    coalesce(string_agg(line, chr(10) ORDER BY l.pos) FILTER (g.pos IS NULL), '') AS text
  FROM lines l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.pos = g.pos GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(n_lines_dropped, 0) AS n_lines_dropped, sha256(coalesce(k.text, '')) AS text_sha256
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""


@query("op10_line_dedup", LINES_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = drop_repeated_lines(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_lines_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))
