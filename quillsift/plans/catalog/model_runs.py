"""Training, tuning, cross-validation and the two closing reports, on conversation turns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from quillsift.operators import bayes, evaluation as ev, models, splits
from quillsift.plans.catalog import bindings as bind, sql
from quillsift.plans.catalog.registry import query
from quillsift.plans.detection import detection_report, run_detection
from quillsift.plans.stability import run_stability
from quillsift.schemas import ALL_FEATURES
from quillsift.session import materialise


def _split(spark, sf_dir):
    rows = materialise(splits.stratified_split(bind.turn_features(spark, sf_dir)))
    return rows.filter(~F.col("is_test")), rows.filter("is_test")


def _folded(spark, sf_dir):
    return materialise(splits.stratified_folds(bind.turn_features(spark, sf_dir)))


def _tested(spark, sf_dir, trainer):
    """Test metrics of one model."""
    train, test = _split(spark, sf_dir)
    scored = models.predict(trainer(train, ALL_FEATURES), test)
    return ev.classification_metrics(scored)


@query("train_lr")
def train_lr(spark, sf_dir):
    return _tested(spark, sf_dir, models.train_lr)


# Feature values at nine decimals, so that both sides start from the same numbers; rows in hash order give splits and folds.
_RANKED = f"""{sql.all_features(sql.TURNS)},
ranked AS MATERIALIZED (SELECT id, label, {', '.join(f'round({name}, 9) AS {name}' for name in ALL_FEATURES)},
  row_number() OVER (PARTITION BY label ORDER BY {sql.hash_key('id')}, id) AS r, count(*) OVER (PARTITION BY label) AS size FROM feats),
long AS (UNPIVOT (SELECT id, label, r, size, {', '.join(ALL_FEATURES)} FROM ranked) ON COLUMNS(* EXCLUDE (id, label, r, size)) INTO NAME feature VALUE value)"""


def _nine(df: DataFrame) -> DataFrame:
    return df.withColumns({name: F.round(name, 9) for name in ALL_FEATURES})


def _cells(spark, model, **matrices) -> DataFrame:
    rows = [
        (label, feature, *[float(matrix[label, i]) for matrix in matrices.values()])
        for label in range(model.numClasses) for i, feature in enumerate(ALL_FEATURES)
    ]
    return spark.createDataFrame(rows, "label int, feature string, " + ", ".join(f"{name} double" for name in matrices))


@query("train_nb_gaussian", f"""{_RANKED},
least AS (SELECT max(v) * 1e-9 AS eps FROM (SELECT var_pop(value) AS v FROM long GROUP BY feature))
SELECT label, feature, round(avg(value), 6) AS mean, round(var_pop(value) + any_value(eps), 6) AS variance FROM long, least GROUP BY label, feature""")
def train_nb_gaussian(spark, sf_dir):
    """The fitted class means and variances."""
    model = models.train_nb(_nine(bind.turn_features(spark, sf_dir)), ALL_FEATURES).stages[-1]
    return _cells(spark, model, mean=model.theta, variance=model.sigma)


@query("train_nb_multinomial", f"""{_RANKED},
mass AS (SELECT label, sum(abs(value)) AS m FROM long GROUP BY label)
SELECT label, feature, round(ln((sum(abs(value)) + 1) / (any_value(m) + {len(ALL_FEATURES)})), 6) AS log_weight FROM long JOIN mass USING (label) GROUP BY label, feature""")
def train_nb_multinomial(spark, sf_dir):
    """The fitted weights of the features, on absolute values."""
    model = models.train_nb(_nine(bind.turn_features(spark, sf_dir)), ALL_FEATURES, "multinomial").stages[-1]
    return _cells(spark, model, log_weight=model.theta)


@query("nb_multinomial_metrics")
def nb_multinomial_metrics(spark, sf_dir):
    return _tested(spark, sf_dir, lambda train, columns: models.train_nb(train, columns, "multinomial"))


@query("train_rf")
def train_rf(spark, sf_dir):
    return _tested(spark, sf_dir, models.train_rf)


@query("tune_lr")
def tune_lr(spark, sf_dir):
    return models.tune_lr(_folded(spark, sf_dir), ALL_FEATURES)[1]


def _gaussian_sql(train: str, test: str, keys: str) -> str:
    """CTEs up to ``scored`` (keys, id, label, prediction, score): rows of ``long`` scored by models fitted where ``train`` holds."""
    return f"""
least AS (SELECT {keys}, max(v) * 1e-9 AS eps FROM (SELECT {keys}, feature, var_pop(value) AS v FROM long, parts WHERE {train} GROUP BY {keys}, feature) GROUP BY {keys}),
cells AS (SELECT {keys}, label AS class, feature, avg(value) AS m, var_pop(value) + any_value(eps) AS v FROM long JOIN parts ON {train} JOIN least USING ({keys}) GROUP BY {keys}, label, feature),
priors AS (SELECT {keys}, label AS class, ln(count(*) / sum(count(*)) OVER (PARTITION BY {keys})) AS p FROM ranked JOIN parts ON {train} GROUP BY {keys}, label),
fits AS (
  SELECT {keys}, id, label, class, any_value(p) + sum(-0.5::DOUBLE * (ln(2 * pi() * v) + (value - m) ** 2 / v)) AS fit
  FROM long JOIN parts ON {test} JOIN cells USING ({keys}, feature) JOIN priors USING ({keys}, class) GROUP BY {keys}, id, label, class),
scored AS (
  SELECT {keys}, id, label, first(class ORDER BY fit DESC, class)::BIGINT AS prediction,
    round(sum(exp(fit - top)) FILTER (class = 1) / sum(exp(fit - top)), 6) AS score
  FROM (SELECT *, max(fit) OVER (PARTITION BY {keys}, id) AS top FROM fits) GROUP BY {keys}, id, label)"""


@query("cross_validate", f"""{_RANKED},
parts AS (SELECT unnest(range(5)) AS fold),{_gaussian_sql('(r - 1) % 5 <> fold', '(r - 1) % 5 = fold', 'fold')},
counts AS (SELECT fold, count(*) AS n, count(*) FILTER (prediction = label) AS good, count(*) FILTER (prediction = 1 AND label = 1) AS tp,
  count(*) FILTER (prediction = 1) AS said, count(*) FILTER (label = 1) AS real FROM scored GROUP BY fold)
SELECT 'Naive Bayes' AS model, fold, unnest(['accuracy', 'precision', 'recall', 'f1_score']) AS metric,
  round(unnest([good / n, coalesce(tp / nullif(said, 0), 0), coalesce(tp / nullif(real, 0), 0), coalesce(2 * tp / nullif(said + real, 0), 0)]), 6)::DOUBLE AS value
FROM counts""")
def cross_validate(spark, sf_dir):
    """All folds from one aggregate."""
    return bayes.cross_validate_nb(_nine(_folded(spark, sf_dir)), ALL_FEATURES)


@query("cross_validate_models")
def cross_validate_models(spark, sf_dir):
    """All three models, a fit per fold."""
    rows = _folded(spark, sf_dir)
    return reduce(DataFrame.unionByName, [
        models.cross_validate(rows, ALL_FEATURES, trainer, model=name) for name, trainer in models.DEFAULT_TRAINERS.items()
    ])


@query("model_suite")
def model_suite(spark, sf_dir):
    """Test metrics and cross-validated accuracy of all three models."""
    train, test = _split(spark, sf_dir)
    return models.suite_summary(train, test, ALL_FEATURES)


@query("split_and_scale", f"""{_RANKED},
moments AS (SELECT feature, avg(value) AS m, stddev_pop(value) AS s FROM long WHERE r > round(0.2 * size) GROUP BY feature)
SELECT id AS text_id, r <= round(0.2 * size) AS is_test, feature, round(CASE WHEN s > 0 THEN (value - m) / s ELSE 0 END, 6)::DOUBLE AS value
FROM long JOIN moments USING (feature)""")
def split_and_scale(spark, sf_dir):
    """Both parts of the split, scaled by the training rows."""
    parts = models.split_and_scale(_nine(bind.turn_features(spark, sf_dir)), ALL_FEATURES)
    rows = parts.train.withColumn("is_test", F.lit(False)).unionByName(parts.test.withColumn("is_test", F.lit(True)))
    return rows.unpivot(["text_id", "is_test"], ALL_FEATURES, "feature", "value")


@query("seed_suite")
def seed_suite(spark, sf_dir):
    return models.lr_seed_suite(bind.turn_features(spark, sf_dir), ALL_FEATURES, splits.STABILITY_SEEDS)


@query("predict", f"""{_RANKED},
parts AS (SELECT 0 AS part),{_gaussian_sql('r > round(0.2 * size)', 'r <= round(0.2 * size)', 'part')}
SELECT id AS text_id, label, prediction, score FROM scored""")
def predict(spark, sf_dir):
    """The test rows as naive Bayes sees them."""
    train, test = _split(spark, sf_dir)
    return models.predict(models.train_nb(_nine(train), ALL_FEATURES), _nine(test), "text_id")


@query("predict_models")
def predict_models(spark, sf_dir):
    """The test rows as each of the three models sees them."""
    train, test = _split(spark, sf_dir)
    return models.model_suite(train, test, ALL_FEATURES, models.DEFAULT_TRAINERS, "text_id")[1]


@query("lr_abs_importance")
def lr_abs_importance(spark, sf_dir):
    rows = bind.turn_features(spark, sf_dir)
    return ev.topn_importance(models.lr_abs_importance(models.train_lr_unscaled(rows, ALL_FEATURES), ALL_FEATURES), 20)


@query("lr_signed_importance")
def lr_signed_importance(spark, sf_dir):
    rows = bind.turn_features(spark, sf_dir)
    return ev.topn_signed(models.lr_coefficients(models.train_lr_unscaled(rows, ALL_FEATURES), ALL_FEATURES), 20)


@query("rf_importance")
def rf_importance(spark, sf_dir):
    rows = bind.turn_features(spark, sf_dir)
    return ev.topn_importance(models.rf_importance(models.train_rf(rows, ALL_FEATURES), ALL_FEATURES), 20)


@query("detection_report")
def detection(spark, sf_dir):
    return detection_report(run_detection(bind.turn_features(spark, sf_dir, unseen_test=True)))


@query("stability_report")
def stability(spark, sf_dir):
    return run_stability(bind.turn_features(spark, sf_dir), bind.attempts(spark, sf_dir))
