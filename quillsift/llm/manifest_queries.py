"""The manifest's query and its SQL."""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, SparkSession, functions as F

from quillsift.llm.merkle import merkle_proofs, row_digest
from quillsift.llm.registry import query, table

# crc32 of a decimal number, bit by bit, since SQL has none: 3988292384 is its polynomial.
CRC32_SQL = """xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(k::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
  lambda crc, byte: list_reduce(list_concat([xor(crc, byte)], [0, 0, 0, 0, 0, 0, 0, 0]),
    lambda v, _: xor(v >> 1, (v & 1) * 3988292384))))"""


def crc32_sql(name: str) -> str:
    return CRC32_SQL.replace("k::VARCHAR", f"{name}::VARCHAR")


def _framed(value: str) -> str:
    return f"coalesce(strlen({value}::VARCHAR)::VARCHAR || ':' || {value}::VARCHAR, '-')"


_LOWERED = f"translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
_HEAD = " || ".join(_framed(c) for c in ("doc_id", "source", "lang", "n_chars"))

MERKLE_SQL = f"""
WITH RECURSIVE leaves AS (
  SELECT row_number() OVER () AS id, doc_id, lang, sha256({_HEAD} || {_framed('text')}) AS h,
    CASE WHEN {crc32_sql('doc_id')} % 3 = 0 THEN sha256({_HEAD} || {_framed(_LOWERED)}) ELSE sha256({_HEAD} || {_framed('text')}) END AS t,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM documents),
nodes AS (
  SELECT lang, 0 AS lev, pos, n, h FROM leaves
  UNION ALL
  SELECT lang, lev + 1, pos // 8, (any_value(n) + 7) // 8, sha256(string_agg(h, '' ORDER BY pos)) FROM nodes WHERE n > 1 GROUP BY lang, lev, pos // 8),
subroots AS (SELECT lang, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops AS (
  SELECT 0 AS lev, pos, n, h FROM subroots
  UNION ALL
  SELECT lev + 1, pos // 8, (any_value(n) + 7) // 8, sha256(string_agg(h, '' ORDER BY pos)) FROM tops WHERE n > 1 GROUP BY lev, pos // 8),
runs AS (SELECT lang, lev, pos // 8 AS run, list(h ORDER BY pos) AS hs FROM nodes WHERE n > 1 GROUP BY ALL),
top_runs AS (SELECT lev, pos // 8 AS run, list(h ORDER BY pos) AS hs FROM tops WHERE n > 1 GROUP BY ALL),
steps AS (
  SELECT id, lev, (pos // (8 ** lev)::BIGINT) % 8 AS slot, hs FROM leaves JOIN runs
    ON leaves.lang IS NOT DISTINCT FROM runs.lang AND leaves.pos // (8 ** (lev + 1))::BIGINT = run
  UNION ALL
  SELECT id, 1000 + lev, (s.pos // (8 ** lev)::BIGINT) % 8, hs FROM leaves JOIN subroots s ON leaves.lang IS NOT DISTINCT FROM s.lang
    JOIN top_runs ON s.pos // (8 ** (lev + 1))::BIGINT = run),
ordered AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY lev) AS step, array_to_string(hs[1:slot], '') AS l,
  array_to_string(hs[slot + 2:], '') AS r FROM steps),
folds AS (
  SELECT id, 0 AS step, t AS h FROM leaves
  UNION ALL
  SELECT f.id, f.step + 1, sha256(l || h || r) FROM folds f JOIN ordered o ON o.id = f.id AND o.step = f.step + 1),
folded AS (SELECT id, arg_max(h, step) AS h FROM folds GROUP BY id),
proofs AS (SELECT id, sha256(string_agg(l || r, '' ORDER BY step)) AS p FROM ordered GROUP BY id),
top AS (SELECT h FROM tops WHERE n = 1)
SELECT doc_id, leaves.h AS leaf, s.h AS subroot, top.h AS root, coalesce(p, sha256('')) AS proof_sha256, folded.h AS folded_root,
  folded.h = top.h AS verified
FROM leaves JOIN subroots s ON leaves.lang IS NOT DISTINCT FROM s.lang JOIN folded ON folded.id = leaves.id LEFT JOIN proofs ON proofs.id = leaves.id, top
"""


@query("op13_merkle_manifest", MERKLE_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = [F.col(name) for name in ("doc_id", "source", "lang", "n_chars")]
    lowered = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, F.lit(False))
    return merkle_proofs(
        table(spark, sf_dir, "documents"), row_digest(*head, F.col("text")),
        row_digest(*head, F.when(tampered, lowered).otherwise(F.col("text"))))
