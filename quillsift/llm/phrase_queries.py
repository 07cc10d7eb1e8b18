"""The phrase miner's query and its SQL."""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, SparkSession

from quillsift.llm.phrases import mine_phrases
from quillsift.llm.registry import query, table

PHRASES_SQL = f"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'),
    '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
words AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \\t]+'), lambda w: w <> '') AS ws FROM pieces),
runs AS (
  SELECT lang, k, array_to_string(ws[s:s + k - 1], ' ') AS phrase FROM (
    SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS s FROM words, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(ws) >= k)),
totals AS (SELECT lang, count(*) AS n FROM runs WHERE k = 1 GROUP BY lang),
f AS (SELECT lang, k, phrase, string_split(phrase, ' ') AS ws, count(*) AS a FROM runs GROUP BY lang, k, phrase HAVING count(*) >= 30),
cuts AS (SELECT lang, k, phrase, ws, a, unnest(range(1, k)) AS c FROM f WHERE k > 1),
scored AS (
  SELECT cuts.lang, cuts.k, cuts.phrase, any_value(cuts.ws) AS ws, any_value(cuts.a) AS a, first(l.a ORDER BY (2000000 * cuts.a::HUGEINT) // (l.a + r.a), c) AS l,
    first(r.a ORDER BY (2000000 * cuts.a::HUGEINT) // (l.a + r.a), c) AS r, min((2000000 * cuts.a::HUGEINT) // (l.a + r.a))::BIGINT AS score
  FROM cuts JOIN f l ON l.lang = cuts.lang AND l.phrase = array_to_string(cuts.ws[1:c], ' ')
    JOIN f r ON r.lang = cuts.lang AND r.phrase = array_to_string(cuts.ws[c + 1:], ' ') GROUP BY ALL),
inner_parts AS (
  SELECT lang, array_to_string(ws[s:s + j - 1], ' ') AS phrase, max(a) AS most FROM (
    SELECT lang, ws, a, j, unnest(range(1, k - j + 2)) AS s FROM (SELECT *, unnest(range(2, k)) AS j FROM scored)) GROUP BY ALL),
kept AS (SELECT s.* FROM scored s LEFT JOIN inner_parts i ON i.lang = s.lang AND i.phrase = s.phrase WHERE NOT coalesce(100 * most >= 80 * a, false)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""


@query("op11_phrases", PHRASES_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine_phrases(table(spark, sf_dir, "documents"))
