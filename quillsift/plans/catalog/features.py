"""The 29 features, their groups, feature tables, TF-IDF and SVD."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillsift.functions import features as per_doc
from quillsift.functions.tokens import bare_words
from quillsift.operators import features as tables, matrix, tfidf
from quillsift.plans.catalog import bindings as bind, sql
from quillsift.plans.catalog.registry import query
from quillsift.schemas import (
    ALL_FEATURES, LINGUISTIC_FEATURES, PERPLEXITY_FEATURES, READABILITY_FEATURES, STATISTICAL_FEATURES,
)
from quillsift.session import materialise


def _readability(df):
    return tables.corpus_readability(df, keep=["doc_id"])


# group name: (columns, transform, SQL CTEs, name of the last CTE)
_GROUPS = {
    "statistical_features": (STATISTICAL_FEATURES, per_doc.statistical_features, sql.STATISTICAL, "stat"),
    "readability_features": (READABILITY_FEATURES, _readability, sql.READABILITY, "readable"),
    "linguistic_features": (LINGUISTIC_FEATURES, per_doc.linguistic_features, sql.LINGUISTIC, "ling"),
    "perplexity_features": (PERPLEXITY_FEATURES, per_doc.perplexity_features, sql.PERPLEXITY, "perp"),
}


def _register(name: str, columns: list[str], transform, ctes: str, last: str) -> None:
    @query(name, f"{sql.prepared(sql.DOCS)},{ctes}\nSELECT id AS doc_id, {sql.rounded(columns)} FROM {last}")
    def run(spark, sf_dir):
        return transform(bind.prepared_documents(spark, sf_dir)).select("doc_id", *columns)


for _name, (_columns, _transform, _ctes, _last) in _GROUPS.items():
    _register(_name, _columns, _transform, _ctes, _last)
    for _column in _columns:
        # Only the Dale-Chall score looks at the word list.
        _one = per_doc.readability_features if _name == "readability_features" and "dale" not in _column else _transform
        _register(_column, [_column], _one, _ctes, _last)


@query("extract_all_features", f"""{sql.all_features(sql.DOCS)}
SELECT id AS doc_id, {sql.rounded(ALL_FEATURES)} FROM feats""")
def extract_all_features(spark, sf_dir):
    return tables.extract_all_features(bind.prepared_documents(spark, sf_dir), keep=["doc_id"])


@query("pos_ratios", f"""{sql.prepared(sql.DOCS)},{sql.LINGUISTIC}
SELECT id AS doc_id, {sql.rounded(per_doc.TAG_RATIOS)} FROM shares""")
def pos_ratios(spark, sf_dir):
    tokens = tables.token_table(bind.prepared_documents(spark, sf_dir), "doc_id")
    return tables.pos_ratios(tables.pos_lookup(tokens), "doc_id")


@query("syllables", f"""{sql.prepared(sql.DOCS)}, {sql.WORD_ROWS}
SELECT id AS doc_id, count(*) AS words, sum({sql.SYLLABLES})::BIGINT AS syllables,
  count(*) FILTER ({sql.SYLLABLES} >= 3) AS polysyllables FROM words GROUP BY id""")
def syllables(spark, sf_dir):
    words = bind.prepared_documents(spark, sf_dir).select(
        "doc_id", F.explode(bare_words(F.col("normalized_text"))).alias("word")
    )
    count = per_doc.syllables(F.col("word"))
    return words.select("doc_id", count.alias("n")).groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("words"), F.sum("n").alias("syllables"),
        F.sum((F.col("n") >= 3).cast("long")).alias("polysyllables"),
    )


@query("attach_features", f"""{sql.prepared(sql.LABELLED)},{sql.PERPLEXITY}
SELECT tok.id AS doc_id, label, {sql.rounded(PERPLEXITY_FEATURES)} FROM tok JOIN perp ON tok.id = perp.id""")
def attach_features(spark, sf_dir):
    features = per_doc.perplexity_features(bind.prepared_documents(spark, sf_dir))
    labelled = bind.labelled_documents(spark, sf_dir).select("doc_id", "label")
    return tables.attach_features(labelled, features, "doc_id")


_LONG_STAT = f"""{sql.prepared(sql.TURNS)},{sql.STATISTICAL},
long AS (UNPIVOT (SELECT id, {', '.join(STATISTICAL_FEATURES)} FROM stat) ON COLUMNS(* EXCLUDE (id)) INTO NAME feature VALUE value)"""


@query("assemble_features", f"{_LONG_STAT}\nSELECT id AS text_id, feature, round(value, 6) AS value FROM long")
def assemble_features(spark, sf_dir):
    """The vector written out again by position, with the names it came with."""
    from pyspark.ml.functions import vector_to_array

    prepared = per_doc.statistical_features(bind.prepared_turns(spark, sf_dir))
    vectors, names = matrix.assemble_features(prepared.drop("content", "cleaned_text", "normalized_text"))
    cells = vectors.select("text_id", F.posexplode(vector_to_array("features")).alias("pos", "value"))
    named = F.get(F.array(*[F.lit(name) for name in names]), F.col("pos"))
    return cells.select("text_id", named.alias("feature"), "value")


@query("standard_scale", f"""{_LONG_STAT},
moments AS (SELECT feature, avg(value) AS m, stddev_pop(value) AS s FROM long GROUP BY feature)
SELECT id AS text_id, feature, round(CASE WHEN s > 0 THEN (value - m) / s ELSE 0 END::DOUBLE, 6) AS value
FROM long JOIN moments USING (feature)""")
def standard_scale(spark, sf_dir):
    rows = materialise(per_doc.statistical_features(bind.prepared_turns(spark, sf_dir)).select("text_id", *STATISTICAL_FEATURES))
    scaled = matrix.standard_scaler(rows, STATISTICAL_FEATURES).transform(rows)
    return scaled.unpivot(["text_id"], STATISTICAL_FEATURES, "feature", "value")


@query("impute_median", """
WITH v AS (SELECT event_id, CASE WHEN event_type IN ('error', 'signup') THEN NULL ELSE value END AS value FROM events)
SELECT event_id, round(coalesce(value, (SELECT quantile_cont(value, 0.5) FROM v)), 6) AS value FROM v""")
def impute_median(spark, sf_dir):
    kind = F.col("event_type")
    value = F.when(kind == "error", float("nan")).when(kind != "signup", F.col("value"))
    rows = bind.table(spark, sf_dir, "events").select("event_id", value.alias("value"))
    return matrix.median_imputer(rows, ["value"]).transform(rows)


# --- TF-IDF -----------------------------------------------------------------------------------

_TERMS = f"{sql.prepared(sql.DOCS)},{sql.terms('normalized_text')}"


@query("tfidf_vocabulary", f"{_TERMS}\nSELECT term, tf, df, n_docs FROM vocab")
def tfidf_vocabulary(spark, sf_dir):
    return tfidf.tfidf_vocabulary(_texts(spark, sf_dir))


def _texts(spark, sf_dir):
    return materialise(bind.prepared_documents(spark, sf_dir).select("doc_id", "normalized_text"))


def _tfidf(spark, sf_dir):
    texts = _texts(spark, sf_dir)
    return tfidf.tfidf_vectors(texts, tfidf.tfidf_vocabulary(texts))


_WEIGHTS = f"""{_TERMS},
counted AS (SELECT id, term, count(*) AS c FROM trm WHERE term IN (SELECT term FROM vocab) GROUP BY id, term),
raw AS (
  SELECT id, term, (1 + ln(c)) * (ln((1 + n_docs) / (1 + df)) + 1) AS w FROM counted JOIN vocab USING (term)
),
unit AS (SELECT id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM raw)"""


@query("tfidf_weights", f"{_WEIGHTS}\nSELECT id AS doc_id, term, round(w, 6) AS weight FROM unit")
def tfidf_weights(spark, sf_dir):
    return tfidf.tfidf_weights(*_tfidf(spark, sf_dir), "doc_id")


def _reduced(spark, sf_dir, n_components=None):
    """All components where no number is given."""
    vectors, names = _tfidf(spark, sf_dir)
    return tfidf.svd_reduce(materialise(vectors.select("doc_id", "tfidf")), len(names), n_components or len(names))[0]


@query("svd_reduce", f"""{_WEIGHTS},
near AS (SELECT a.id, sum(a.w * b.w) AS dot FROM unit a JOIN unit b ON b.id = a.id + 1 AND b.term = a.term GROUP BY a.id)
SELECT src.id AS doc_id, round(coalesce(sum(w * w), 0), 6)::DOUBLE AS energy, round(coalesce(any_value(dot), 0), 6)::DOUBLE AS next_similarity
FROM src LEFT JOIN unit ON unit.id = src.id LEFT JOIN near ON near.id = src.id GROUP BY src.id""")
def svd_reduce(spark, sf_dir):
    """All components turn the weights without changing lengths or angles: each document's length and its product with the next.

    The next document's weights are joined; a thousand coordinates of each document are only made where they are multiplied.
    """
    vectors, names = _tfidf(spark, sf_dir)
    vectors = materialise(vectors.select("doc_id", "tfidf"))
    after = vectors.select((F.col("doc_id") - 1).alias("doc_id"), F.col("tfidf").alias("_after"))
    pairs = vectors.join(after, "doc_id", "left")
    reduced, _ = tfidf.svd_reduce(pairs, len(names), len(names), learn=vectors, also={"_after": "_next"})

    def dot(a, b):
        return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda total, v: total + v)

    return reduced.select(
        "doc_id", dot("svd", "svd").alias("energy"), F.coalesce(dot("svd", "_next"), F.lit(0.0)).alias("next_similarity"))


@query("svd_components")
def svd_components(spark, sf_dir):
    """The coordinates of all documents in the first hundred components."""
    return _reduced(spark, sf_dir, tfidf.N_COMPONENTS).select("doc_id", F.posexplode("svd").alias("component", "value"))


@query("svd_explained_variance", f"""{_WEIGHTS},
spread AS (SELECT (sum(w * w) - pow(sum(w), 2) / (SELECT count(*) FROM src)) / ((SELECT count(*) FROM src) - 1) AS v FROM unit GROUP BY term)
SELECT round(sum(v), 6) AS total_variance, round(sum(v), 6) AS kept_variance, 1.0::DOUBLE AS explained_variance FROM spread""")
def svd_explained_variance(spark, sf_dir):
    """All components keep all of the variance."""
    return tfidf.svd_explained_variance(_reduced(spark, sf_dir))


@query("svd_truncated_variance")
def svd_truncated_variance(spark, sf_dir):
    return tfidf.svd_explained_variance(_reduced(spark, sf_dir, tfidf.N_COMPONENTS))
