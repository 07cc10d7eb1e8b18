"""Metrics, curves and report tables over scored rows and features."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillsift.operators import evaluation as ev, reports
from quillsift.operators.features import extract_all_features
from quillsift.operators.matrix import sanitize_numeric
from quillsift.plans.catalog import bindings as bind, sql
from quillsift.plans.catalog.registry import query
from quillsift.schemas import ALL_FEATURES

# --- scored rows ------------------------------------------------------------------------------

_SCORED = f"""
SELECT *, (score >= 0.5::DOUBLE)::BIGINT AS prediction FROM (
  SELECT id, label, (row_number() OVER (PARTITION BY label ORDER BY {sql.hash_key('id')}, id) - 1) % 5 AS fold,
    unnest(['length', 'density', 'letter']) AS model,
    unnest([length(content) / (length(content) + 1000.0::DOUBLE), length(replace(content, ' ', '')) / length(content),
      length(replace(lower(content), 'e', '')) / length(content) - 0.4::DOUBLE]) AS score
  FROM ({sql.LABELLED})
)"""


def _counts(keys: str) -> str:
    return f"""
SELECT {keys}, count(*) FILTER (label <> 1 AND prediction <> 1) AS tn, count(*) FILTER (label <> 1 AND prediction = 1) AS fp,
  count(*) FILTER (label = 1 AND prediction <> 1) AS fn, count(*) FILTER (label = 1 AND prediction = 1) AS tp
FROM ({_SCORED}) GROUP BY {keys}"""


def _metrics(keys: str) -> str:
    return f"""
SELECT {keys}, (tp + tn) / (tp + tn + fp + fn) AS accuracy, coalesce(tp / nullif(tp + fp, 0), 0)::DOUBLE AS precision,
  coalesce(tp / nullif(tp + fn, 0), 0)::DOUBLE AS recall, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)::DOUBLE AS f1_score
FROM ({_counts(keys)})"""


_NAMES = ["accuracy", "precision", "recall", "f1_score"]

_AUC = f"""
SELECT model, (sum(r) FILTER (label = 1) - any_value(p) * (any_value(p) + 1) / 2) / (any_value(p) * any_value(n)) AS roc_auc
FROM (
  SELECT model, label, rank() OVER (PARTITION BY model ORDER BY score)
      + (count(*) OVER (PARTITION BY model, score) - 1) / 2 AS r,
    sum(label) OVER (PARTITION BY model) AS p, sum(1 - label) OVER (PARTITION BY model) AS n
  FROM ({_SCORED})
) GROUP BY model"""


@query("classification_metrics", f"SELECT model, {sql.rounded(_NAMES)} FROM ({_metrics('model')})")
def classification_metrics(spark, sf_dir):
    return ev.classification_metrics(bind.scored_documents(spark, sf_dir), ["model"])


@query("roc_auc", f"SELECT model, round(roc_auc, 6) AS roc_auc FROM ({_AUC})")
def roc_auc(spark, sf_dir):
    return ev.roc_auc(bind.scored_documents(spark, sf_dir), ["model"])


@query("confusion_matrix", f"""
SELECT model, unnest([0, 0, 1, 1])::BIGINT AS label, unnest([0, 1, 0, 1])::BIGINT AS prediction, unnest([tn, fp, fn, tp]) AS n
FROM ({_counts('model')})""")
def confusion_matrix(spark, sf_dir):
    return ev.confusion_matrix(bind.scored_documents(spark, sf_dir), ["model"])


@query("classification_report", f"""
WITH c AS ({_counts('model')}),
d AS (
  SELECT model, 'Human' AS class, tn AS hit, tn + fn AS called, tn + fp AS support FROM c
  UNION ALL SELECT model, 'AI', tp, tp + fp, tp + fn FROM c
),
e AS (
  SELECT model, class, coalesce(hit / nullif(called, 0), 0)::DOUBLE AS precision, coalesce(hit / nullif(support, 0), 0)::DOUBLE AS recall,
    coalesce(2 * hit / nullif(called + support, 0), 0)::DOUBLE AS f1_score, support FROM d
),
r AS (
  SELECT * FROM e
  UNION ALL SELECT model, 'accuracy', (tn + tp) / (tn + tp + fn + fp), (tn + tp) / (tn + tp + fn + fp),
    (tn + tp) / (tn + tp + fn + fp), tn + tp + fn + fp FROM c
  UNION ALL SELECT model, 'macro avg', avg(precision), avg(recall), avg(f1_score), sum(support)::BIGINT FROM e GROUP BY model
  UNION ALL SELECT model, 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
    sum(f1_score * support) / sum(support), sum(support)::BIGINT FROM e GROUP BY model
)
SELECT model, class, {sql.rounded(['precision', 'recall', 'f1_score'])}, support FROM r""")
def classification_report(spark, sf_dir):
    return ev.classification_report(bind.scored_documents(spark, sf_dir), ["model"])


@query("roc_curve", f"""
WITH s AS (SELECT model, score, sum(label) AS pos, sum(1 - label) AS neg FROM ({_SCORED}) GROUP BY model, score),
c AS (
  SELECT model, score, pos, neg, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, lead(pos) OVER w AS next_pos,
    lead(neg) OVER w AS next_neg, row_number() OVER w AS r,
    sum(pos) OVER (PARTITION BY model) AS p, sum(neg) OVER (PARTITION BY model) AS n
  FROM s WINDOW w AS (PARTITION BY model ORDER BY score DESC)
)
SELECT model, round(score, 6) AS threshold, round(fp / n, 6) AS fpr, round(tp / p, 6) AS tpr FROM c
WHERE r = 1 OR next_pos IS NULL OR pos <> next_pos OR neg <> next_neg
UNION ALL SELECT DISTINCT model, 'Infinity'::DOUBLE, 0::DOUBLE, 0::DOUBLE FROM c""")
def roc_curve(spark, sf_dir):
    return ev.roc_curve(bind.scored_documents(spark, sf_dir), ["model"])


@query("model_comparison", f"""
SELECT model, {sql.rounded(_NAMES)}, round(roc_auc, 6) AS roc_auc FROM ({_metrics('model')}) JOIN ({_AUC}) USING (model)""")
def model_comparison(spark, sf_dir):
    return ev.model_comparison(ev.model_metrics(bind.scored_documents(spark, sf_dir)))


def _fold_metrics(spark, sf_dir):
    wide = ev.classification_metrics(bind.scored_documents(spark, sf_dir), ["model", "fold"])
    return wide.unpivot(["model", "fold"], _NAMES, "metric", "value")


_LONG = f"UNPIVOT ({_metrics('model, fold')}) ON accuracy, precision, recall, f1_score INTO NAME metric VALUE value"
_SUMMARY = f"""
SELECT model, metric, avg(value) AS mean, stddev_pop(value) AS std, 2 * stddev_pop(value) AS spread, count(*) AS folds
FROM ({_LONG}) GROUP BY model, metric"""


@query("cv_summary", f"""
SELECT model, metric, {sql.rounded(['mean', 'std', 'spread'])}, folds, round(list_min(v), 6) AS lowest, round(list_max(v), 6) AS highest
FROM ({_SUMMARY}) JOIN (SELECT model, metric, list(value) AS v FROM ({_LONG}) GROUP BY model, metric) USING (model, metric)""")
def cv_summary(spark, sf_dir):
    summary = ev.cv_summary(_fold_metrics(spark, sf_dir))
    return summary.withColumns({
        "lowest": F.array_min("fold_values"), "highest": F.array_max("fold_values")}).drop("fold_values")


@query("best_model", f"""
SELECT model, round(mean, 6) AS mean FROM ({_SUMMARY}) WHERE metric = 'accuracy' ORDER BY mean DESC, model LIMIT 1""")
def best_model(spark, sf_dir):
    summary = ev.cv_summary(_fold_metrics(spark, sf_dir)).filter(F.col("metric") == "accuracy")
    return ev.best_model(summary, position="model").select("model", "mean")


@query("seed_sensitivity", f"""
SELECT count(*) AS seeds, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, round(min(value), 6) AS min,
  round(max(value), 6) AS max, round((max(value) - min(value)) * 100, 6) AS range_points
FROM ({_LONG}) WHERE metric = 'accuracy' AND model = 'letter'""")
def seed_sensitivity(spark, sf_dir):
    scores = _fold_metrics(spark, sf_dir).filter((F.col("metric") == "accuracy") & (F.col("model") == "letter"))
    return ev.seed_sensitivity(scores, "value")


# --- features by class ------------------------------------------------------------------------

# Sums of logarithms and shares differ in their last bits between engines: nine decimals decide on bins, quartiles and ties.
_FEATS = f"""{sql.all_features(sql.TURNS)}"""
_NINE = ", ".join(f"round({name}, 9) AS {name}" for name in ALL_FEATURES)
_LONG = f"""{_FEATS},
long AS (UNPIVOT (SELECT label, {_NINE} FROM feats) ON COLUMNS(* EXCLUDE (label)) INTO NAME feature VALUE value)"""


def _features(spark, sf_dir):
    """All 29 features of all turns, staged."""
    return bind.turn_features(spark, sf_dir)


def _rounded(spark, sf_dir):
    return _features(spark, sf_dir).select("text_id", "label", *[F.round(name, 9).alias(name) for name in ALL_FEATURES])


@query("class_feature_means", f"""{sql.all_features(sql.TURNS)},
long AS (UNPIVOT (SELECT label, {', '.join(ALL_FEATURES)} FROM feats) ON COLUMNS(* EXCLUDE (label)) INTO NAME feature VALUE value)
SELECT label, feature, round(avg(value), 6) AS mean FROM long GROUP BY label, feature""")
def class_feature_means(spark, sf_dir):
    features = extract_all_features(bind.prepared_turns(spark, sf_dir), keep=["label"])
    return reports.class_feature_means(features, ALL_FEATURES)


@query("feature_histogram", f"""{_LONG},
ends AS (
  SELECT label, feature, CASE WHEN min(value) = max(value) THEN min(value) - 0.5::DOUBLE ELSE min(value) END AS low,
    CASE WHEN min(value) = max(value) THEN max(value) + 0.5::DOUBLE ELSE max(value) END AS high
  FROM long GROUP BY label, feature
)
SELECT label, feature, least(floor((value - low) / (high - low) * 30), 29)::BIGINT AS bin, count(*) AS n
FROM long JOIN ends USING (label, feature) GROUP BY ALL""")
def feature_histogram(spark, sf_dir):
    return reports.feature_histogram(_rounded(spark, sf_dir), ALL_FEATURES)


_BOX = f"""{_LONG},
box AS (
  SELECT label, feature, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median,
    quantile_cont(value, 0.75) AS q3 FROM long GROUP BY label, feature
),
placed AS (
  SELECT *, value BETWEEN q1 - 1.5::DOUBLE * (q3 - q1) AND q3 + 1.5::DOUBLE * (q3 - q1) AS inside
  FROM long JOIN box USING (label, feature)
)"""


@query("feature_boxplot", f"""{_BOX}
SELECT label, feature, {sql.rounded(['q1', 'median', 'q3'])}, round(min(value) FILTER (inside), 6) AS whisker_low,
  round(max(value) FILTER (inside), 6) AS whisker_high, count(*) FILTER (NOT inside) AS outliers
FROM placed GROUP BY label, feature, q1, median, q3""")
def feature_boxplot(spark, sf_dir):
    return reports.feature_boxplot(_rounded(spark, sf_dir), ALL_FEATURES)


@query("boxplot_outliers", f"{_BOX}\nSELECT label, feature, round(value, 6) AS value FROM placed WHERE NOT inside")
def boxplot_outliers(spark, sf_dir):
    rows = _rounded(spark, sf_dir)
    boxes = reports.feature_boxplot(rows, ALL_FEATURES)
    return reports.boxplot_outliers(rows, boxes, ALL_FEATURES)


def _gappy(name: str) -> str:
    """Zeros of a feature count as missing."""
    return f"nullif({name}, 0)"


def _corr(x: str, y: str) -> str:
    return f"covar_pop({x}, {y}) / nullif(stddev_pop(CASE WHEN {y} IS NOT NULL THEN {x} END) * stddev_pop(CASE WHEN {x} IS NOT NULL THEN {y} END), 0)"


def _correlations(source: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{x}' AS feature_x, '{y}' AS feature_y, round({_corr(x, y)}, 6) AS correlation FROM {source}"
        for x in ALL_FEATURES for y in ALL_FEATURES)


@query("correlation_matrix", f"""{_FEATS},
gappy AS MATERIALIZED (SELECT {', '.join(f"{_gappy(name)} AS {name}" for name in ALL_FEATURES)} FROM feats)
{_correlations('gappy')}""")
def correlation_matrix(spark, sf_dir):
    """All features, zeros counting as missing, so that pairs differ in their rows."""
    rows = _features(spark, sf_dir).select(*[F.nullif(name, F.lit(0.0)).alias(name) for name in ALL_FEATURES])
    return reports.correlation_matrix(rows, ALL_FEATURES)


@query("correlation_matrix_complete", f"""{_FEATS},
whole AS MATERIALIZED (SELECT {', '.join(ALL_FEATURES)} FROM feats)
{_correlations('whole')}""")
def correlation_matrix_complete(spark, sf_dir):
    return reports.correlation_matrix(sanitize_numeric(_features(spark, sf_dir), ALL_FEATURES), ALL_FEATURES)


@query("feature_pairs", f"{_FEATS}\nSELECT label, {sql.rounded(['avg_word_length', 'vocabulary_richness'])} FROM feats")
def feature_pairs(spark, sf_dir):
    return reports.feature_pairs(_features(spark, sf_dir), "avg_word_length", "vocabulary_richness")


_GAPS = f"""{_LONG},
gaps AS (
  SELECT feature, avg(value) FILTER (label = 1) - avg(value) FILTER (label = 0) AS coefficient FROM long GROUP BY feature
)"""


def _gaps(spark, sf_dir):
    """The difference of class means stands in for a coefficient."""
    means = reports.class_feature_means(_rounded(spark, sf_dir), ALL_FEATURES)
    sign = F.when(F.col("label") == 1, F.col("mean")).otherwise(-F.col("mean"))
    return means.groupBy("feature").agg(F.round(F.sum(sign), 9).alias("coefficient"))


@query("topn_importance", f"""{_GAPS}
SELECT feature, round(abs(round(coefficient, 9)), 6) AS importance FROM gaps ORDER BY abs(round(coefficient, 9)) DESC, feature LIMIT 10""")
def topn_importance(spark, sf_dir):
    importances = _gaps(spark, sf_dir).select("feature", F.abs("coefficient").alias("importance"))
    return ev.topn_importance(importances, 10)


@query("topn_signed", f"""{_GAPS},
both_ends AS (
  SELECT feature, coefficient, 'positive' AS direction,
    row_number() OVER (ORDER BY round(coefficient, 9) DESC, feature) AS rank FROM gaps
  UNION ALL SELECT feature, coefficient, 'negative', row_number() OVER (ORDER BY round(coefficient, 9), feature) FROM gaps
)
SELECT feature, round(round(coefficient, 9), 6) AS coefficient, direction, rank FROM both_ends WHERE rank <= 5""")
def topn_signed(spark, sf_dir):
    return ev.topn_signed(_gaps(spark, sf_dir), 5)
