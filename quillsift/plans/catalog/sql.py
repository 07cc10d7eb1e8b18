"""SQL building blocks shared by the queries' SQL side.

They restate the definitions in plain SQL (token rows, GROUP BY, joins) rather than in arrays,
so that the two sides are computed in different ways.
"""

from __future__ import annotations

import unicodedata

from quillsift.functions import lexicon
from quillsift.functions.cleaning import CONTRACTIONS, WHITESPACE
from quillsift.functions.features import TAG_RATIOS
from quillsift.functions.tokens import TERM_PATTERN, TOKEN_PATTERN
from quillsift.schemas import ALL_FEATURES


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def words(values) -> str:
    return "(" + ", ".join(quote(value) for value in values) + ")"


WS = WHITESPACE
BLANKS = "chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||' '||chr(133)||chr(160)||chr(8232)||chr(8233)||chr(12288)"

URLS = f"regexp_replace({{}}, '(?:http|www)[^{WS}]+', '', 'g')"
EMAILS = f"regexp_replace({{}}, '[^{WS}]+@[^{WS}]+', '', 'g')"
SYMBOLS = f"regexp_replace({{}}, {quote(rf'[^\p{{L}}\p{{N}}_{WS}.,!?;:' + chr(39) + '-]')}, ' ', 'g')"
SPACES = f"trim(regexp_replace({{}}, '[{WS}]+', ' ', 'g'))"
# The braces of regex classes and format fields must not meet.
URLS, EMAILS, SYMBOLS, SPACES = (
    (lambda template: lambda x: template.replace("{}", x))(t) for t in (URLS, EMAILS, SYMBOLS, SPACES)
)


def clean(x: str) -> str:
    return SPACES(SYMBOLS(EMAILS(URLS(f"coalesce({x}, '')"))))


def nfkd(x: str) -> str:
    """SQL has no NFKD: take apart the letters of Latin-1, by the Unicode tables."""
    for code in range(0xC0, 0x100):
        letter = chr(code)
        parts = unicodedata.normalize("NFKD", letter)
        if parts != letter:
            x = f"replace({x}, {quote(letter)}, {quote(parts)})"
    return x


def contractions(x: str) -> str:
    for short, full in CONTRACTIONS.items():
        x = f"replace({x}, {quote(short)}, {quote(full)})"
    return x


def tokens(x: str) -> str:
    x = rf"regexp_replace({x}, '\bcannot\b', 'can not', 'g')"
    x = rf"regexp_replace({x}, '''s\b', ' ''s', 'g')"
    return f"regexp_extract_all({x}, {quote(TOKEN_PATTERN)})"


def sentences(x: str) -> str:
    marked = rf"regexp_replace({x}, '([.!?]+)[{WS}]+', '\1' || chr(1), 'g')"
    return f"list_filter(string_split({marked}, chr(1)), lambda s: s <> '')"


DOCS = "SELECT doc_id AS id, text AS content FROM documents"
TURNS = (
    "SELECT concat_ws('-', conv_id, turn) AS id, text AS content, "
    "CASE role WHEN 'user' THEN 0 ELSE 1 END::BIGINT AS label, conv_id * 1048576 + turn AS ingest_order "
    "FROM conversations WHERE role IN ('user', 'assistant')"
)
LABELLED = (
    "SELECT d.doc_id AS id, d.text AS content, l.quality::BIGINT AS label "
    "FROM documents d JOIN labels l ON d.doc_id = l.doc_id"
)


def prepared(source: str) -> str:
    """CTEs up to ``tok``: id, content, cleaned_text, normalized_text, tokens, sentences."""
    return f"""
WITH src AS ({source}),
cleaned AS (SELECT *, {clean('content')} AS cleaned_text FROM src),
normal AS (SELECT *, {contractions('lower(' + nfkd('cleaned_text') + ')')} AS normalized_text FROM cleaned),
tok AS (SELECT *, {tokens('normalized_text')} AS tokens, {sentences('normalized_text')} AS sentences FROM normal)"""


def pos_case(token: str) -> str:
    branches = [f"WHEN {token} IN {words(listed)} THEN {quote(tag)}" for tag, listed in lexicon.CLOSED_CLASS.items()]
    suffixes = " ".join(f"WHEN suffix({token}, {quote(end)}) THEN {quote(tag)}" for end, tag in lexicon.SUFFIX_TAGS)
    branches.append(f"WHEN regexp_matches({token}, {quote(lexicon.WORD_START)}) THEN CASE {suffixes} ELSE 'NN' END")
    branches.append(f"WHEN regexp_matches({token}, {quote(lexicon.NUMBER_START)}) THEN 'CD'")
    return f"CASE {' '.join(branches)} ELSE {token} END"


def count_of(text: str, mark: str) -> str:
    return f"(length({text}) - length(replace({text}, {quote(mark)}, '')))::DOUBLE"


def bare(text: str) -> str:
    return f"regexp_extract_all(regexp_replace({text}, '[.,!?;:''-]+', '', 'g'), '[^{WS}]+')"


WORD_ROWS = f"words AS (SELECT id, unnest({bare('normalized_text')}) AS word FROM tok)"
EASY = "easy AS (SELECT word FROM words GROUP BY word ORDER BY count(*) DESC, word LIMIT 3000)"
TOKEN_ROWS = "toks AS (SELECT id, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS pos FROM tok)"

STATISTICAL = f"""
{TOKEN_ROWS},
tstat AS (SELECT id, count(*) AS n, sum(length(token)) AS chars, count(DISTINCT token) AS uniq FROM toks GROUP BY id),
sent AS (SELECT id, unnest(sentences) AS s FROM tok),
sstat AS (SELECT id, stddev_pop(len(regexp_extract_all(s, '[^{WS}]+'))) AS std FROM sent GROUP BY id),
stat AS (
  SELECT tok.id,
    coalesce(chars / n, 0)::DOUBLE AS avg_word_length,
    CASE WHEN len(sentences) > 0 THEN coalesce(n, 0) / len(sentences) ELSE 0 END::DOUBLE AS avg_sentence_length,
    coalesce(uniq / n, 0)::DOUBLE AS vocabulary_richness,
    coalesce(uniq, 0)::DOUBLE AS unique_word_count,
    coalesce(uniq / n, 0)::DOUBLE AS lexical_diversity,
    CASE WHEN length(normalized_text) > 0
      THEN (length(normalized_text) - length(translate(normalized_text, '.,!?;:''"', ''))) / length(normalized_text)
      ELSE 0 END::DOUBLE AS punctuation_ratio,
    {count_of('normalized_text', ',')} AS comma_count,
    {count_of('normalized_text', '.')} AS period_count,
    {count_of('normalized_text', '!')} AS exclamation_count,
    {count_of('normalized_text', '?')} AS question_count,
    {count_of('normalized_text', ';')} AS semicolon_count,
    {count_of('normalized_text', ':')} AS colon_count,
    CASE WHEN len(sentences) > 1 THEN std ELSE 0 END::DOUBLE AS sentence_length_std,
    CASE WHEN trim(normalized_text) <> '' THEN 1 ELSE 0 END::DOUBLE AS paragraph_count
  FROM tok LEFT JOIN tstat ON tok.id = tstat.id LEFT JOIN sstat ON tok.id = sstat.id
)"""

SYLLABLES = (
    "greatest(len(regexp_extract_all(word, '[aeiouy]+')) "
    "- CASE WHEN regexp_matches(word, '[^aeiouyl]e$') THEN 1 ELSE 0 END, 1)"
)

READABILITY = f"""
{WORD_ROWS},
{EASY},
wstat AS (
  SELECT id, count(*)::DOUBLE AS w, sum({SYLLABLES}) AS syl, count(*) FILTER ({SYLLABLES} >= 3) AS poly,
    count(*) FILTER (easy.word IS NULL) AS hard
  FROM words LEFT JOIN easy USING (word) GROUP BY id
),
rbase AS (
  SELECT tok.id, w, syl, poly, hard, len(sentences) AS s, length(replace(normalized_text, ' ', '')) AS letters
  FROM tok LEFT JOIN wstat ON tok.id = wstat.id
),
readable AS (
  SELECT id,
    coalesce(206.835::DOUBLE - 1.015::DOUBLE * (w / s) - 84.6::DOUBLE * (syl / w), 0)::DOUBLE AS flesch_reading_ease,
    coalesce(0.39::DOUBLE * (w / s) + 11.8::DOUBLE * (syl / w) - 15.59::DOUBLE, 0)::DOUBLE AS flesch_kincaid_grade,
    coalesce(4.71::DOUBLE * (letters / w) + 0.5::DOUBLE * (w / s) - 21.43::DOUBLE, 0)::DOUBLE
      AS automated_readability_index,
    coalesce(0.1579::DOUBLE * (100 * hard / w) + 0.0496::DOUBLE * (w / s)
      + CASE WHEN 100 * hard / w > 5 THEN 3.6365 ELSE 0 END::DOUBLE, 0)::DOUBLE AS dale_chall_readability,
    coalesce(0.4::DOUBLE * (w / s + 100 * poly / w), 0)::DOUBLE AS gunning_fog,
    CASE WHEN w > 0 AND s >= 3 THEN 1.0430::DOUBLE * sqrt(30 * poly / s) + 3.1291::DOUBLE ELSE 0 END::DOUBLE
      AS smog_index
  FROM rbase
)"""

_SHARES = ", ".join(
    f"(count(*) FILTER (tag IN {words(tags)}) / count(*))::DOUBLE AS {name}" for name, tags in TAG_RATIOS.items()
)
_ZEROED = ", ".join(f"coalesce({name}, 0)::DOUBLE AS {name}" for name in TAG_RATIOS)

TAGGED = f"tagged AS (SELECT id, token, {pos_case('token')} AS tag FROM toks)"
LINGUISTIC_BODY = f"""
{TAGGED},
shares AS (SELECT id, {_SHARES} FROM tagged GROUP BY id),
following AS (
  SELECT id, token, lead(token) OVER w AS second, lead(token, 2) OVER w AS third FROM toks
  WINDOW w AS (PARTITION BY id ORDER BY pos)
),
grams AS (
  SELECT id,
    count(DISTINCT CASE WHEN second IS NOT NULL THEN token || chr(1) || second END)
      / nullif(count(second), 0) AS bigram_diversity,
    count(DISTINCT CASE WHEN third IS NOT NULL THEN token || chr(1) || second || chr(1) || third END)
      / nullif(count(third), 0) AS trigram_diversity
  FROM following GROUP BY id
),
ling AS (
  SELECT tok.id, {_ZEROED}, coalesce(bigram_diversity, 0)::DOUBLE AS bigram_diversity,
    coalesce(trigram_diversity, 0)::DOUBLE AS trigram_diversity
  FROM tok LEFT JOIN shares ON tok.id = shares.id LEFT JOIN grams ON tok.id = grams.id
)"""
LINGUISTIC = f"{TOKEN_ROWS},{LINGUISTIC_BODY}"

PERPLEXITY_BODY = """
freq AS (SELECT id, token, count(*) AS c FROM toks GROUP BY id, token),
sizes AS (SELECT id, sum(c) AS n, count(*) AS uniq FROM freq GROUP BY id),
ent AS (
  SELECT freq.id, sum(c / n * log2(n / c)) AS entropy, any_value(uniq / n) AS ratio
  FROM freq JOIN sizes ON freq.id = sizes.id GROUP BY freq.id
),
perp AS (
  SELECT tok.id, coalesce(entropy, 0)::DOUBLE AS word_entropy, coalesce(ratio, 0)::DOUBLE AS unique_word_ratio
  FROM tok LEFT JOIN ent ON tok.id = ent.id
)"""
PERPLEXITY = f"{TOKEN_ROWS},{PERPLEXITY_BODY}"


def all_features(source: str) -> str:
    """CTEs up to ``feats``: the source columns and all 29 features."""
    return (
        f"{prepared(source)},{STATISTICAL},{READABILITY},{LINGUISTIC_BODY},{PERPLEXITY_BODY},\n"
        f"feats AS (SELECT src.*, {', '.join(ALL_FEATURES)} FROM src JOIN stat USING (id) JOIN readable USING (id) "
        "JOIN ling USING (id) JOIN perp USING (id))"
    )


def rounded(names, prefix: str = "") -> str:
    return ", ".join(f"round({prefix}{name}, 6) AS {name}" for name in names)


def hash_key(id_sql: str, seed: int | str = 42) -> str:
    return f"md5(concat_ws('|', {id_sql}, {seed}))"


def terms(text: str) -> str:
    """CTE body: one row per TF-IDF term of ``normal``, words and adjacent pairs."""
    return f"""
wrd AS (SELECT id, w AS term, p AS pos FROM (
  SELECT id, unnest(ws) AS w, generate_subscripts(ws, 1) AS p
  FROM (SELECT id, regexp_extract_all(lower({text}), {quote(TERM_PATTERN)}) AS ws FROM normal))),
trm AS (
  SELECT id, term FROM wrd
  UNION ALL
  SELECT id, term || ' ' || nxt FROM (
    SELECT id, term, lead(term) OVER (PARTITION BY id ORDER BY pos) AS nxt FROM wrd) WHERE nxt IS NOT NULL
),
vocab AS (
  SELECT term, count(*) AS tf, count(DISTINCT id) AS df, (SELECT count(*) FROM src) AS n_docs
  FROM trm GROUP BY term HAVING count(DISTINCT id) >= 2 AND count(DISTINCT id) <= 0.95::DOUBLE * (SELECT count(*) FROM src)
  ORDER BY tf DESC, term LIMIT 1000
)"""
