"""Sources, sinks, projections, filters and text functions."""

from __future__ import annotations

from pyspark.sql import types as T, functions as F

from quillsift.functions import cleaning, tokens as tok
from quillsift.functions.lexicon import DEFAULT_STOP_WORDS
from quillsift.operators import dataset, features as token_ops, matrix, summaries
from quillsift.operators.features import token_table, word_table
from quillsift.operators.models import predict, train_nb
from quillsift.plans.catalog import bindings as bind, sql
from quillsift.plans.catalog.registry import query
from quillsift.session import scratch_path
from quillsift.sources import articles, files

# --- sources and sinks ------------------------------------------------------------------------

_LABELLED_CSV = T.StructType([
    T.StructField("text_id", T.StringType()), T.StructField("content", T.StringType()),
    T.StructField("label", T.IntegerType()),
])


@query("src_csv", f"SELECT id::VARCHAR AS text_id, content, label FROM ({sql.LABELLED})")
def src_csv(spark, sf_dir):
    path = scratch_path(spark, "labelled-csv")
    rows = bind.labelled_documents(spark, sf_dir).select(F.col("doc_id").alias("text_id"), "content", "label")
    files.write_csv(rows, path)
    return files.read_csv(spark, path, _LABELLED_CSV)


_ARTICLES = """
SELECT doc_id, source AS query, 0::BIGINT AS rank, title || '. ' || coalesce(description, '') || ' ' || text AS content,
  CASE WHEN lang = 'de' THEN 'unknown' ELSE source END AS source, title,
  'https://example.org/' || doc_id AS url, CASE WHEN lang = 'es' THEN '' ELSE '2024-01-01' END AS published_at
FROM (
  SELECT *, string_split(text, chr(10))[1] AS title,
    CASE WHEN lang = 'es' THEN NULL ELSE string_split(text, chr(10))[2] END AS description
  FROM documents WHERE lang <> 'fr'
)"""


@query("src_articles_json", _ARTICLES)
def src_articles_json(spark, sf_dir):
    return articles.flatten_articles(articles.parse_responses(bind.landed_responses(spark, sf_dir)))


@query("src_response_status", """
SELECT doc_id, source AS query, CASE WHEN source = 'src1' THEN 'Unknown error' ELSE 'quota for ' || source END AS message
FROM documents WHERE lang = 'fr'""")
def src_response_status(spark, sf_dir):
    return articles.rejected_responses(articles.parse_responses(bind.landed_responses(spark, sf_dir)))


@query("sink_csv", f"""{sql.prepared(sql.DOCS)}
SELECT id AS doc_id, md5(normalized_text) AS text_md5, len(tokens)::BIGINT AS n_tokens,
  md5(array_to_string(tokens, ' ')) AS tokens_md5 FROM tok""")
def sink_csv(spark, sf_dir):
    path = scratch_path(spark, "prepared-csv")
    prepared = bind.prepared_documents(spark, sf_dir).select("doc_id", "normalized_text", "tokens")
    files.write_csv(prepared, path)
    schema = T.StructType([
        T.StructField("doc_id", T.LongType()), T.StructField("normalized_text", T.StringType()),
        T.StructField("tokens", T.StringType()),
    ])
    back = files.read_csv(spark, path, schema, text_column="normalized_text", label_column="doc_id")
    words = F.from_json("tokens", T.ArrayType(T.StringType()))
    return back.withColumn("tokens", words).select(
        "doc_id", F.md5("normalized_text").alias("text_md5"), F.size("tokens").alias("n_tokens"),
        F.md5(F.array_join("tokens", " ")).alias("tokens_md5"),
    )


@query("sink_stages", f"SELECT id AS text_id, label, md5(content) AS text_md5 FROM ({sql.TURNS})")
def sink_stages(spark, sf_dir):
    staged = files.write_stage(bind.labelled_turns(spark, sf_dir), scratch_path(spark, "stages"), "combined", "label")
    return staged.select("text_id", "label", F.md5("content").alias("text_md5"))


def _saved_and_loaded(spark, sf_dir):
    counts = bind.labelled_turns(spark, sf_dir).select(
        "text_id", "label", F.length("content").cast("double").alias("chars"),
        tok.word_count(F.col("content")).cast("double").alias("words"),
    )
    columns = ["chars", "words"]
    model = train_nb(counts, columns)
    path = scratch_path(spark, "model")
    files.save_model(model, path)
    before = predict(model, counts, "text_id").withColumnRenamed("prediction", "before")
    after = predict(files.load_model(path), counts, "text_id").select("text_id", "prediction")
    same = (F.col("before") == F.col("prediction")).alias("same")
    return before.join(after, "text_id").select("text_id", same)


@query("sink_model", f"SELECT id AS text_id, true AS same FROM ({sql.TURNS})")
def sink_model(spark, sf_dir):
    return _saved_and_loaded(spark, sf_dir)


# --- projections ------------------------------------------------------------------------------

@query("compose_text", """
SELECT doc_id, coalesce(string_split(text, chr(10))[1], '') || '. ' || coalesce(string_split(text, chr(10))[2], '')
  || ' ' || text AS content FROM documents""")
def compose_text(spark, sf_dir):
    lines = F.split("content", "\n")
    text = dataset.compose_text(F.get(lines, F.lit(0)), F.get(lines, F.lit(1)), F.col("content"))
    return bind.documents(spark, sf_dir).select("doc_id", text.alias("content"))


@query("tag_corpus", """
SELECT item_id, text, 0::BIGINT AS label, 'benchmark' AS source, 'table' AS collection_method FROM benchmark""")
def tag_corpus(spark, sf_dir):
    return dataset.tag_corpus(bind.table(spark, sf_dir, "benchmark"), 0, "benchmark", "table")


@query("topic_title", "SELECT doc_id, replace(source || '_' || lang, '_', ' ') AS title FROM documents")
def topic_title(spark, sf_dir):
    topic = F.concat_ws("_", "source", "lang")
    return bind.table(spark, sf_dir, "documents").select("doc_id", dataset.topic_title(topic).alias("title"))


@query("collection_date", "SELECT doc_id, '2024-05-01' AS collection_date FROM documents")
def collection_date(spark, sf_dir):
    return bind.documents(spark, sf_dir).select(
        "doc_id", dataset.collection_date("2024-05-01").alias("collection_date")
    )


_TEMPLATES = ", ".join(f"({i}, {sql.quote(t)})" for i, t in enumerate(dataset.PROMPT_TEMPLATES))
_TOPICS = ", ".join(f"({i}, {sql.quote(t)})" for i, t in enumerate(dataset.TOPICS))
_LENGTHS = ", ".join(f"({i}, {n})" for i, n in enumerate(dataset.PROMPT_LENGTHS))
_FILL = "replace(replace(template, '{topic}', topic), '{length}', length::VARCHAR)"


@query("prompt_grid", f"""
SELECT topic, length::BIGINT AS length, {_FILL} AS prompt
FROM (SELECT DISTINCT source || ' ' || lang AS topic FROM documents)
CROSS JOIN (VALUES {_TEMPLATES}) t(i, template) CROSS JOIN (VALUES {_LENGTHS}) l(j, length)""")
def prompt_grid(spark, sf_dir):
    topics = bind.table(spark, sf_dir, "documents").select(F.concat_ws(" ", "source", "lang").alias("topic")).distinct()
    return dataset.prompt_grid(topics)


def _draw(part: str, n: int) -> str:
    return f"('0x' || substr(md5(concat_ws('|', doc_id, 42, '{part}')), 1, 8))::BIGINT % {n}"


@query("prompt_sample", f"""
SELECT doc_id, topic, length::BIGINT AS length, {_FILL} AS prompt
FROM documents
JOIN (VALUES {_TOPICS}) a(i, topic) ON a.i = {_draw('topic', len(dataset.TOPICS))}
JOIN (VALUES {_TEMPLATES}) b(j, template) ON b.j = {_draw('template', len(dataset.PROMPT_TEMPLATES))}
JOIN (VALUES {_LENGTHS}) c(k, length) ON c.k = {_draw('length', len(dataset.PROMPT_LENGTHS))}""")
def prompt_sample(spark, sf_dir):
    return dataset.prompt_sample(bind.documents(spark, sf_dir).select("doc_id"), "doc_id")


@query("sanitize_numeric", """
SELECT event_id, round(CASE event_type WHEN 'error' THEN 0 WHEN 'click' THEN 1e10 WHEN 'view' THEN -1e10
  WHEN 'signup' THEN 0 ELSE value END::DOUBLE, 6) AS value FROM events""")
def sanitize_numeric(spark, sf_dir):
    return matrix.sanitize_numeric(bind.gappy_events(spark, sf_dir), ["value"])


@query("preview_per_class", f"""
SELECT label, substr(content, 1, 200) || '...' AS preview FROM ({sql.TURNS})
QUALIFY row_number() OVER (PARTITION BY label ORDER BY {sql.hash_key('id')}, id) = 1""")
def preview_per_class(spark, sf_dir):
    return dataset.preview_per_class(bind.labelled_turns(spark, sf_dir))


# --- filters ----------------------------------------------------------------------------------

@query("filter_min_chars", f"SELECT doc_id, content FROM ({_ARTICLES}) WHERE length(content) > 300")
def filter_min_chars(spark, sf_dir):
    flat = articles.flatten_articles(articles.parse_responses(bind.landed_responses(spark, sf_dir)))
    return dataset.filter_min_chars(flat).select("doc_id", "content")


@query("filter_short_response", f"""
SELECT id AS text_id, label FROM ({sql.TURNS}) WHERE length(trim(content, {sql.BLANKS})) >= 100""")
def filter_short_response(spark, sf_dir):
    return dataset.filter_short_response(bind.labelled_turns(spark, sf_dir)).select("text_id", "label")


@query("filter_not_null", """
SELECT d.doc_id, l.quality::BIGINT AS label FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
WHERE d.text IS NOT NULL AND l.quality IS NOT NULL""")
def filter_not_null(spark, sf_dir):
    labels = bind.table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    rows = bind.documents(spark, sf_dir).join(labels, "doc_id", "left")
    return dataset.filter_not_null(rows, "content", "label").select("doc_id", "label")


@query("filter_char_range", "SELECT doc_id, text AS content FROM documents WHERE length(text) BETWEEN 300 AND 2000")
def filter_char_range(spark, sf_dir):
    return dataset.filter_char_range(bind.documents(spark, sf_dir))


@query("filter_word_range", rf"""
SELECT * FROM (SELECT doc_id, len(regexp_extract_all(text, '[^{sql.WS}]+'))::BIGINT AS word_count FROM documents)
WHERE word_count BETWEEN 300 AND 1000""")
def filter_word_range(spark, sf_dir):
    return dataset.filter_word_range(bind.documents(spark, sf_dir)).select("doc_id", "word_count")


@query("filter_class", f"SELECT id AS text_id, label FROM ({sql.TURNS}) WHERE label = 1")
def filter_class(spark, sf_dir):
    return dataset.filter_class(bind.labelled_turns(spark, sf_dir), 1).select("text_id", "label")


_ATTEMPTS = """
SELECT event_id, event_type AS approach, value >= length(event_type) * 2 AS succeeded,
  CASE WHEN value >= length(event_type) * 2 THEN NULL ELSE
    CASE event_type WHEN 'view' THEN 'Blocked by SAFETY filter' WHEN 'click' THEN 'Resource Quota exceeded'
    ELSE 'HTTP ' || (380 + (props::JSON->>'$.k')::INT) END END AS error_message
FROM events"""


@query("classify_api_error", f"""
SELECT event_id, CASE WHEN regexp_matches(error_message, '(?i)block|safety') THEN 'blocked'
  WHEN contains(error_message, '429') OR regexp_matches(error_message, '(?i)quota') THEN 'rate_limit'
  ELSE 'other' END AS kind
FROM ({_ATTEMPTS}) WHERE error_message IS NOT NULL""")
def classify_api_error(spark, sf_dir):
    errors = bind.attempts(spark, sf_dir).filter(F.col("error_message").isNotNull())
    return errors.select("event_id", summaries.classify_api_error(F.col("error_message")).alias("kind"))


_ATTEMPT_SUMMARY = f"""
SELECT approach, count(*) AS attempted, (count(*) FILTER (succeeded)) AS collected, count(error_message) AS errors,
  round(avg(succeeded::INT), 6) AS success_rate
FROM ({_ATTEMPTS}) GROUP BY approach"""


@query("attempt_summary", _ATTEMPT_SUMMARY)
def attempt_summary(spark, sf_dir):
    return summaries.attempt_summary(bind.attempts(spark, sf_dir))


@query("rate_band", f"""
SELECT approach, CASE WHEN success_rate * 100 < 25 THEN 'red' WHEN success_rate * 100 < 90 THEN 'orange'
  ELSE 'green' END AS band FROM ({_ATTEMPT_SUMMARY})""")
def rate_band(spark, sf_dir):
    summary = summaries.attempt_summary(bind.attempts(spark, sf_dir))
    return summary.select("approach", summaries.rate_band(F.col("success_rate")).alias("band"))


@query("reached_rate_target", f"""
SELECT approach, collected, collected >= 0.8 * attempted AS reached FROM ({_ATTEMPT_SUMMARY})""")
def reached_rate_target(spark, sf_dir):
    summary = summaries.attempt_summary(bind.attempts(spark, sf_dir))
    reached = summaries.reached_rate_target(F.col("collected"), F.col("attempted"))
    return summary.select("approach", "collected", reached.alias("reached"))


# --- cleaning and tokens ----------------------------------------------------------------------

def _text_query(name: str, expression, sql_expression: str, alias: str = "text"):
    @query(name, f"SELECT doc_id, {sql_expression} AS {alias} FROM documents")
    def run(spark, sf_dir):
        return bind.documents(spark, sf_dir).select("doc_id", expression(F.col("content")).alias(alias))


_text_query("strip_urls", cleaning.strip_urls, sql.URLS("text"))
_text_query("strip_emails", cleaning.strip_emails, sql.EMAILS("text"))
_text_query("strip_symbols", cleaning.strip_symbols, sql.SYMBOLS("text"))
_text_query("collapse_spaces", cleaning.collapse_spaces, sql.SPACES("text"))
_text_query("clean_text", cleaning.clean_text, sql.clean("text"))
_text_query("nfkd", cleaning.nfkd, sql.nfkd("text"))
_text_query("lowercase", F.lower, "lower(text)")
_text_query("expand_contractions", cleaning.expand_contractions, sql.contractions("text"))
_text_query("normalize_text", cleaning.normalize_text, sql.contractions(f"lower({sql.nfkd('text')})"))
_text_query("tokenize_words", lambda c: F.array_join(tok.tokenize_words(F.lower(cleaning.clean_text(c))), "\u0001"),
            f"array_to_string({sql.tokens('lower(' + sql.clean('text') + ')')}, chr(1))")
_text_query("split_whitespace", lambda c: F.array_join(tok.split_whitespace(c), "\u0001"),
            f"array_to_string(regexp_extract_all(text, '[^{sql.WS}]+'), chr(1))")
_text_query("tokenize_sentences",
            lambda c: F.array_join(tok.tokenize_sentences(F.lower(cleaning.clean_text(c))), "\n"),
            f"array_to_string({sql.sentences('lower(' + sql.clean('text') + ')')}, chr(10))")
_text_query("split_sentences_fallback", lambda c: F.array_join(tok.split_sentences_fallback(c), "\u0001"),
            "array_to_string(list_filter(list_transform(regexp_split_to_array(text, '[.!?]+'), "
            f"lambda s: trim(s, {sql.BLANKS})), lambda s: s <> ''), chr(1))")


@query("preprocess_document", f"""{sql.prepared(sql.DOCS)}
SELECT id AS doc_id, content, cleaned_text, normalized_text, array_to_string(tokens, ' ') AS tokens,
  array_to_string(sentences, chr(1)) AS sentences FROM tok""")
def preprocess_document(spark, sf_dir):
    from quillsift.operators.preprocess import preprocess_document as prepare

    return prepare(bind.documents(spark, sf_dir)).select(
        "doc_id", "content", "cleaned_text", "normalized_text", F.array_join("tokens", " ").alias("tokens"),
        F.array_join("sentences", "\u0001").alias("sentences"),
    )


@query("preprocess_dataset", f"""{sql.prepared(sql.DOCS)}
SELECT id AS doc_id, md5(cleaned_text) AS cleaned_md5, md5(normalized_text) AS normalized_md5,
  len(tokens)::BIGINT AS num_tokens, len(sentences)::BIGINT AS num_sentences,
  len(regexp_extract_all(content, '[^{sql.WS}]+'))::BIGINT AS word_count FROM tok""")
def preprocess_dataset(spark, sf_dir):
    return bind.prepared_documents(spark, sf_dir).select(
        "doc_id", F.md5("cleaned_text").alias("cleaned_md5"), F.md5("normalized_text").alias("normalized_md5"),
        "num_tokens", "num_sentences", "word_count",
    )


def _long_parts(separator: str) -> str:
    return (
        f"list_filter(list_transform(string_split(text, {separator}), lambda p: trim(p, {sql.BLANKS})), "
        "lambda p: length(p) > 200)"
    )


_CHUNKS = f"""
WITH parts AS (SELECT doc_id, {_long_parts('chr(10)||chr(10)')} AS paragraphs, {_long_parts('chr(10)')} AS lines FROM documents),
found AS (SELECT doc_id, CASE WHEN len(paragraphs) < 3 THEN list_concat(paragraphs, lines) ELSE paragraphs END AS c FROM parts),
flat AS (SELECT doc_id, list_filter(list_transform(c[1:5], lambda p: trim(replace(p, chr(10), ' '), {sql.BLANKS})),
  lambda p: length(p) >= 200) AS c FROM found)
SELECT doc_id, generate_subscripts(c, 1)::BIGINT - 1 AS chunk_pos, unnest(c) AS content FROM flat"""


@query("chunk_pages", _CHUNKS)
def chunk_pages(spark, sf_dir):
    return dataset.chunk_pages(bind.documents(spark, sf_dir))


@query("topk_chunks_per_page", f"SELECT doc_id, count(*) AS chunks, max(chunk_pos) AS last_pos FROM ({_CHUNKS}) GROUP BY doc_id")
def topk_chunks_per_page(spark, sf_dir):
    return dataset.chunk_pages(bind.documents(spark, sf_dir)).groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("chunks"), F.max("chunk_pos").alias("last_pos")
    )


# --- joins ------------------------------------------------------------------------------------

@query("label_bind", f"SELECT id AS doc_id, label, content FROM ({sql.LABELLED})")
def label_bind(spark, sf_dir):
    labels = bind.table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    return dataset.bind_labels(bind.documents(spark, sf_dir), labels, "doc_id").rows.select("doc_id", "label", "content")


@query("label_bind_audit", """
SELECT unnest(['matched', 'without_label', 'without_text']) AS rows, unnest([
  count(*) FILTER (d.doc_id IS NOT NULL AND quality IS NOT NULL), count(*) FILTER (quality IS NULL), count(*) FILTER (d.doc_id IS NULL)]) AS n
FROM documents d FULL JOIN (SELECT * FROM labels WHERE quality IS NOT NULL) l ON d.doc_id = l.doc_id""")
def label_bind_audit(spark, sf_dir):
    """What the binding left out on either side."""
    labels = bind.table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    bound = dataset.bind_labels(bind.documents(spark, sf_dir).select("doc_id"), labels, "doc_id")
    return spark.createDataFrame(list(bound.counts().items()), "rows string, n long")


@query("stopword_filter", f"""{sql.prepared(sql.DOCS)}, {sql.TOKEN_ROWS}
SELECT id AS doc_id, count(*) AS kept, sum(pos - 1)::BIGINT AS positions, sum(length(token))::BIGINT AS chars
FROM toks WHERE lower(token) NOT IN {sql.words(DEFAULT_STOP_WORDS)} GROUP BY id""")
def stopword_filter(spark, sf_dir):
    stop = spark.createDataFrame([(word,) for word in DEFAULT_STOP_WORDS], "word string")
    kept = token_ops.stop_word_filter(token_table(bind.prepared_documents(spark, sf_dir), "doc_id"), stop)
    return kept.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("kept"), F.sum("pos").alias("positions"), F.sum(F.length("token")).alias("chars")
    )


@query("easy_word_antijoin", f"""{sql.prepared(sql.DOCS)}, {sql.WORD_ROWS},
easy AS (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '[^{sql.WS}]+'))) AS word FROM benchmark)
SELECT id AS doc_id, count(*) AS difficult FROM words WHERE word NOT IN (SELECT word FROM easy) GROUP BY id""")
def easy_word_antijoin(spark, sf_dir):
    listed = bind.table(spark, sf_dir, "benchmark").select(F.explode(tok.split_whitespace(F.col("text"))).alias("word"))
    words = word_table(bind.prepared_documents(spark, sf_dir), "doc_id")
    hard = token_ops.difficult_words(words, listed.select(F.lower("word").alias("word")))
    return hard.groupBy("doc_id").agg(F.count(F.lit(1)).alias("difficult"))


_LEXICON = f"""lex AS (
  SELECT DISTINCT lower(w) AS token, 'NNP' AS tag
  FROM (SELECT unnest(regexp_extract_all(text, '[^{sql.WS}]+')) AS w FROM benchmark) WHERE length(w) >= 8
)"""


@query("pos_lookup", f"""{sql.prepared(sql.DOCS)}, {sql.TOKEN_ROWS}, {_LEXICON}
SELECT toks.id AS doc_id, coalesce(lex.tag, {sql.pos_case('toks.token')}) AS tag, count(*) AS n
FROM toks LEFT JOIN lex ON toks.token = lex.token GROUP BY ALL""")
def pos_lookup(spark, sf_dir):
    listed = bind.table(spark, sf_dir, "benchmark").select(F.explode(tok.split_whitespace(F.col("text"))).alias("w"))
    lexicon = listed.filter(F.length("w") >= 8).select(F.lower("w").alias("token"), F.lit("NNP").alias("tag"))
    tagged = token_ops.pos_lookup(token_table(bind.prepared_documents(spark, sf_dir), "doc_id"), lexicon)
    return tagged.groupBy("doc_id", "tag").agg(F.count(F.lit(1)).alias("n"))
