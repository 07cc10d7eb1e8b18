"""Matrix steps, quantiles, metrics, TF-IDF, SVD and classifiers on small generated tables."""

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from quillsift.operators import bayes, evaluation, forest, logistic, matrix, models, reports, splits, tfidf
from quillsift.operators.quantiles import exact_quantiles
from quillsift.plans.detection import detection_report, run_detection
from quillsift.plans.stability import run_stability
from quillsift.sources import files

NAN, INF = float("nan"), float("inf")


def test_sanitize_and_assemble(spark):
    df = spark.createDataFrame([(1, NAN, "x", 0), (2, INF, "y", 1), (3, -INF, "z", 1), (4, None, "z", 0)],
                               "n int, a double, s string, label int")
    out, names = matrix.assemble_features(df)
    assert names == ["n", "a"]
    got = [list(r.v) for r in out.orderBy("n").select(vector_to_array("features").alias("v")).collect()]
    assert got == [[1, 0], [2, 1e10], [3, -1e10], [4, 0]]


def test_scaler_and_imputer(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (4.0, 5.0)], "a double, b double")
    got = np.array([[r.a, r.b] for r in matrix.standard_scaler(df, ["a", "b"]).transform(df).collect()])
    a = np.array([1.0, 2.0, 4.0])
    assert np.allclose(np.sort(got[:, 0]), (a - a.mean()) / a.std()) and np.all(got[:, 1] == 0)
    gaps = spark.createDataFrame([(1.0,), (None,), (NAN,), (2.0,), (10.0,), (3.0,)], "a double")
    assert sorted(r.a for r in matrix.median_imputer(gaps, ["a"]).transform(gaps).collect()) == [1, 2, 2.5, 2.5, 3, 10]


def test_exact_quantiles_on_a_skewed_column(spark):
    """A third of the rows share one value; the rest are distinct, with far outliers."""
    n = 60_000
    rng = np.random.default_rng(1)
    values = np.where(np.arange(n) % 3 == 0, 0.0, rng.lognormal(sigma=3, size=n) * np.where(np.arange(n) % 2, 1, -1))
    labels = np.arange(n) % 5 == 0
    df = spark.createDataFrame([(int(l), float(v)) for l, v in zip(labels, values)], "label int, x double").repartition(8)
    probabilities = [0.0, 0.01, 0.25, 0.4, 0.5, 0.75, 0.999, 1.0]
    got = {(r.label, r.probability): r.value for r in exact_quantiles(df, ["x"], probabilities, ["label"]).collect()}
    for label in (0, 1):
        expected = np.quantile(values[labels == bool(label)], probabilities)
        assert [got[(label, p)] for p in probabilities] == pytest.approx(list(expected), rel=1e-12)


def test_constant_columns(spark):
    df = spark.createDataFrame([(0, 1.0, 1.0), (0, 1.0, 2.0), (1, 1.0, NAN)], "label int, a double, b double")
    cells = {(r.feature_x, r.feature_y): r.correlation for r in reports.correlation_matrix(df, ["a", "b"]).collect()}
    assert cells == {("a", "a"): None, ("a", "b"): None, ("b", "a"): None, ("b", "b"): 1.0}
    bins = {(r.label, r.feature, r.bin): r.n for r in reports.feature_histogram(df, ["a"]).collect()}
    assert bins == {(0, "a", 15): 2, (1, "a", 15): 1}


def test_correlations_with_gaps(spark):
    rng = np.random.default_rng(4)
    values = rng.normal(size=(400, 5)) @ rng.normal(size=(5, 5)) * [1, 1e-6, 1e6, 1, 1] + [0, 0, 1e9, 1e5, 0]
    values[rng.random(values.shape) < [0.0, 0.3, 0.3, 0.0, 0.6]] = np.nan
    values[:, 4] = np.where(np.isnan(values[:, 4]), np.nan, 7.5)
    values = np.column_stack([values, np.where(values[:, 1] > 0, 3.25, values[:, 0]), np.full(400, np.nan)])
    names = [f"c {i}" for i in range(values.shape[1])]
    rows = [[None if np.isnan(v) and i % 2 else float(v) for v in row] for i, row in enumerate(values)]
    df = spark.createDataFrame(rows, ", ".join(f"`{n}` double" for n in names)).repartition(7)
    got = {(r.feature_x, r.feature_y): r.correlation for r in reports.correlation_matrix(df, names).collect()}
    assert len(got) == len(names) ** 2
    for i, x in enumerate(names):
        for j, y in enumerate(names):
            both = ~np.isnan(values[:, i]) & ~np.isnan(values[:, j])
            a, b = values[both, i], values[both, j]
            if not len(a) or a.min() == a.max() or b.min() == b.max():
                assert got[x, y] is None
            else:
                assert got[x, y] == pytest.approx(np.corrcoef(a, b)[0, 1], abs=1e-9)
    assert {r.correlation for r in reports.correlation_matrix(df.limit(0), names).collect()} <= {None}


def scored(spark, rows):
    return spark.createDataFrame(rows, "label int, prediction int, score double")


def brute_auc(rows):
    positives = [s for y, _, s in rows if y == 1]
    negatives = [s for y, _, s in rows if y == 0]
    return sum((p > q) + 0.5 * (p == q) for p in positives for q in negatives) / (len(positives) * len(negatives))


def test_auc_and_curve_with_ties(spark):
    rng = np.random.default_rng(0)
    rows = [(int(rng.random() < 0.4), 0, float(rng.integers(0, 12)) / 12) for _ in range(400)]
    rows += [(1, 1, 0.5)] * 200  # a hot score
    df = scored(spark, rows)
    assert evaluation.roc_auc(df).first().roc_auc == pytest.approx(brute_auc(rows))
    curve = sorted(((r.fpr, r.tpr, r.threshold) for r in evaluation.roc_curve(df).collect()), key=lambda p: (p[0], p[1]))
    assert curve[0][:2] == (0.0, 0.0) and curve[0][2] == INF and curve[-1][:2] == (1.0, 1.0)
    area = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(curve, curve[1:]))
    assert area == pytest.approx(brute_auc(rows))


def test_undefined_metrics_are_zero(spark):
    row = evaluation.classification_metrics(scored(spark, [(1, 0, 0.1), (0, 0, 0.2)])).first()
    assert (row.accuracy, row.precision, row.recall, row.f1_score) == (0.5, 0.0, 0.0, 0.0)
    one_class = scored(spark, [(0, 0, 0.1), (0, 1, 0.7)])
    assert evaluation.roc_auc(one_class).first().roc_auc is None
    cells = {(r.label, r.prediction): r.n for r in evaluation.confusion_matrix(one_class).collect()}
    assert cells == {(0, 0): 1, (0, 1): 1, (1, 0): 0, (1, 1): 0}


def test_a_null_group_has_its_curve(spark):
    rows = spark.createDataFrame([(None, 1, 0.9), (None, 0, 0.4), ("g", 1, 0.8), ("g", 0, 0.8)], "g string, label int, score double")
    curve = evaluation.roc_curve(rows, ["g"]).collect()
    assert sorted((r.threshold, r.fpr, r.tpr) for r in curve if r.g is None) == [(0.4, 1.0, 1.0), (0.9, 0.0, 1.0), (INF, 0.0, 0.0)]
    assert sorted((r.threshold, r.fpr, r.tpr) for r in curve if r.g == "g") == [(0.8, 1.0, 1.0), (INF, 0.0, 0.0)]


CORPUS = ["red fox runs fast", "red fox sleeps", "blue whale swims fast fast", "blue fox jumps a fox", "the red whale"]


def test_terms_are_counted_as_numbers(spark, monkeypatch):
    """Each occurrence was a string of its own, sorted and sent on; now a task sends a term once for some documents."""
    monkeypatch.setattr(tfidf, "SLICE_WORDS", 5)
    texts = ["a1 b1 a1 b1 c1", "", None, "a1 b1", "x1", "b1 a1 b1 a1 b1 a1 b1 a1"]
    words = pa.array([None if text is None else text.split() for text in texts])
    made = Counter()
    for part in tfidf._slices(words):
        for terms, number, document in tfidf._occurrences(part, 3):
            assert len(set(terms.to_pylist())) == len(terms)
            made.update(terms[int(i)].as_py() for i in number)
    wanted = Counter(" ".join(text.split()[i:i + n]) for text in texts if text for n in (1, 2, 3) for i in range(len(text.split()) - n + 1))
    assert made == wanted

    df = spark.createDataFrame(list(enumerate(texts)), "text_id long, normalized_text string")
    rows = {r.term: (r.tf, r.df, r.n_docs) for r in tfidf.tfidf_vocabulary(df.coalesce(1), max_n=3).collect()}
    holders = {term: sum(f" {term} " in f" {text} " for text in texts if text) for term in wanted}
    assert rows == {term: (wanted[term], n, 6) for term, n in holders.items() if n >= 2}
    plan = tfidf.tfidf_vocabulary(df)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Generate" not in plan
    vectors, names = tfidf.tfidf_vectors(df, tfidf.tfidf_vocabulary(df))
    assert [r.tfidf.indices for r in vectors.filter("text_id in (1, 2, 4)").collect()] == [[], [], []]
    assert tfidf.tfidf_vocabulary(df.filter("false")).collect() == []


def test_longer_terms_are_counted_among_frequent_words_only(spark):
    rng = np.random.default_rng(7)
    texts = [" ".join(f"w{min(int(x), 60)}" for x in rng.zipf(1.4, 40)) for _ in range(60)]
    among = pa.array(["w1", "w2"])
    for terms, number, _ in tfidf._occurrences(pa.array([text.split() for text in texts]), 3, among):
        assert {word for i in set(number.tolist()) for word in terms[i].as_py().split()} <= {"w1", "w2"}

    df = spark.createDataFrame(list(enumerate(texts)), "text_id long, normalized_text string")
    split = [text.split() for text in texts]
    tf, holders = Counter(), Counter()
    for words in split:
        grams = [" ".join(words[i:i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]
        tf.update(grams)
        holders.update(set(grams))
    fits = [term for term, n in holders.items() if 2 <= n <= 0.95 * 60]
    for size in (1, 5, 20, 45, 1000):  # the words alone fill all but the last
        wanted = sorted(fits, key=lambda term: (-tf[term], term))[:size]
        found = tfidf.tfidf_vocabulary(df, max_features=size, max_n=3).collect()
        assert [(r.term, r.tf, r.df, r.n_docs) for r in found] == [(term, tf[term], holders[term], 60) for term in wanted]


def test_neighbours_are_joined_by_their_weights(spark):
    """The coordinates of a document are many times wider than its weights: none are staged or shuffled."""
    rows = [(i, f"common word{i % 3} word{i % 5} other{i % 2}") for i in range(40)]
    texts = spark.createDataFrame(rows, "text_id long, normalized_text string")
    vectors, names = tfidf.tfidf_vectors(texts, tfidf.tfidf_vocabulary(texts))
    vectors = vectors.select("text_id", "tfidf").localCheckpoint()
    after = vectors.select((F.col("text_id") - 1).alias("text_id"), F.col("tfidf").alias("_after"))
    pairs = vectors.join(after, "text_id", "left")
    reduced, basis = tfidf.svd_reduce(pairs, len(names), len(names), learn=vectors, also={"_after": "_next"})
    plan = reduced._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan.split("Join")[0] and "MapInArrow" not in plan.split("Join", 1)[1]
    alone = {r.text_id: r.svd for r in tfidf.svd_reduce(vectors, len(names), len(names))[0].collect()}
    for row in reduced.collect():
        assert row.svd == pytest.approx(alone[row.text_id], abs=1e-12)
        assert row._next == pytest.approx(alone.get(row.text_id + 1, [0.0] * len(names)), abs=1e-12)
    spread = tfidf.svd_explained_variance(reduced)
    assert spread._jdf.queryExecution().executedPlan().toString().count("MapInArrow") <= 2  # read once; three times before
    row = spread.first()
    table = np.array([alone[i] for i in range(40)])
    assert row.kept_variance == pytest.approx(table.var(axis=0, ddof=1).sum())
    assert row.total_variance == pytest.approx(row.kept_variance)


def test_tfidf_and_svd_against_numpy(spark):
    df = spark.createDataFrame(list(enumerate(CORPUS)), "text_id int, normalized_text string")
    docs = []
    for text in CORPUS:
        words = [w for w in text.split() if len(w) > 1]
        docs.append(words + [f"{a} {b}" for a, b in zip(words, words[1:])])
    n = len(docs)
    frequency = {t: sum(t in d for d in docs) for d in docs for t in d}
    names = sorted(t for t, c in frequency.items() if 2 <= c <= 0.95 * n)
    dense = np.array([
        [(1 + math.log(d.count(t))) * (math.log((1 + n) / (1 + frequency[t])) + 1) if t in d else 0.0 for t in names]
        for d in docs
    ])
    dense = dense / np.linalg.norm(dense, axis=1, keepdims=True)
    vocabulary = tfidf.tfidf_vocabulary(df)
    vectors, got_names = tfidf.tfidf_vectors(df, vocabulary)
    assert got_names == names
    got = np.zeros_like(dense)
    for row in vectors.collect():
        got[row.text_id, row.tfidf.indices] = row.tfidf.values
    assert np.allclose(got, dense)
    reduced, basis = tfidf.svd_reduce(vectors, len(names), 2)
    projected = np.array([r.svd for r in reduced.orderBy("text_id").collect()])
    u, s, _ = np.linalg.svd(dense, full_matrices=False)
    assert np.allclose(np.abs(projected), np.abs(u[:, :2] * s[:2]), atol=1e-8)
    share = tfidf.svd_explained_variance(reduced).first().explained_variance
    assert share == pytest.approx(projected.var(axis=0).sum() / dense.var(axis=0).sum())
    assert basis.shape == (len(names), 2)


@pytest.fixture(scope="module")
def separable(spark):
    rng = np.random.default_rng(3)
    rows = [(f"t{i}", i % 2, float(rng.normal(4 * (i % 2), 0.4)), float(rng.normal())) for i in range(200)]
    return spark.createDataFrame(rows, "text_id string, label int, a double, b double").coalesce(2).cache()


COLUMNS = ["a", "b"]


@pytest.mark.parametrize("variant", ["gaussian", "multinomial"])
def test_bayes_tables_are_the_models_of_the_folds(spark, variant):
    rng = np.random.default_rng(8)
    rows = [(f"t{i}", i % 3 % 2, i % 4, *map(float, rng.normal([i % 2, 100 + 3 * (i % 3), 0, 7], [1, 20, 1e-2, 0]))) for i in range(300)]
    columns = ["a", "b", "c", "d"]
    df = spark.createDataFrame(rows, "text_id string, label int, fold int, a double, b double, c double, d double").repartition(5)
    sums = bayes.class_sums(df, columns, ["fold"]).cache()
    tables = bayes.MODELS[variant](bayes.without_part(sums, ["fold"]), ["fold"])
    got = {r.text_id: r for r in bayes.score_rows(df, tables, columns, ["fold"], "text_id").collect()}
    trainer = lambda train, names: models.train_nb(train, names, variant)
    for k in range(4):
        fitted = trainer(df.filter(F.col("fold") != k), columns)
        for r in models.predict(fitted, df.filter(F.col("fold") == k), "text_id").collect():
            mine = got.pop(r.text_id)
            assert (mine.label, mine.prediction) == (r.label, r.prediction) and mine.score == pytest.approx(r.score, abs=1e-7)
    assert got == {}
    by = lambda r: (r.fold, r.metric)
    slow = sorted(models.cross_validate(df, columns, trainer, range(4)).collect(), key=by)
    fast = sorted(bayes.cross_validate_nb(df, columns, variant).collect(), key=by)
    assert [(by(r), round(r.value, 9)) for r in fast] == [(by(r), round(r.value, 9)) for r in slow]


def test_newton_fits_are_the_optimum(spark):
    rng = np.random.default_rng(5)
    n = 500
    x = np.column_stack([rng.normal(size=n) * 1e-3, rng.normal(50, 30, n), rng.normal(size=n), np.full(n, 4.0)])
    x = np.column_stack([x, x[:, 1] * 3 + rng.normal(size=n)])
    label = (x[:, 1] / 30 + x[:, 2] + rng.normal(size=n) > 1.5).astype(int)
    columns = ["a", "b", "c", "d", "e"]
    rows = [(f"t{i}", None if i == 7 else int(label[i]), i % 5, *map(float, x[i])) for i in range(n)]
    df = spark.createDataFrame(rows, "text_id string, label int, fold int, a double, b double, c double, d double, e double").repartition(6).cache()
    fits = logistic.fit_logistic(df, columns, [F.lit(True), F.col("fold") != 2, F.col("fold") == 1], c=2.0)
    for fit, used in zip(fits, (np.arange(n) >= 0, np.arange(n) % 5 != 2, np.arange(n) % 5 == 1)):
        used = used & (np.arange(n) != 7)
        away = 1 / (1 + np.exp(-(x[used] @ fit.coefficients + fit.intercept))) - label[used]
        gradient = x[used].T @ away + fit.coefficients / 2.0
        assert np.abs(gradient[:3] / x[used, :3].std(axis=0)).max() < 1e-4 and abs(away.sum()) < 1e-6 and fit.coefficients[3] == 0 and fit.steps < 25
    slow = models.train_lr(df.filter("label is not null"), columns, scale=False, c=2.0)
    assert np.allclose(slow.stages[-1].coefficients.toArray(), fits[0].coefficients, rtol=0.05, atol=0.02)
    labelled = df.filter("label is not null")
    by = lambda r: (r.fold, r.metric)
    one = sorted(models.cross_validate(labelled, columns, models.train_lr_unscaled).collect(), key=by)
    together = sorted(models.lr_cross_validate(labelled, columns).collect(), key=by)
    assert [(by(r), round(r.value, 9)) for r in one] == [(by(r), round(r.value, 9)) for r in together]
    apart = models.seed_suite(labelled, columns, [1, 2], models.train_lr_unscaled).collect()
    assert sorted(map(tuple, apart)) == sorted(map(tuple, models.lr_seed_suite(labelled, columns, [1, 2]).collect()))


def test_separable_rows_have_a_finite_fit(spark):
    df = spark.createDataFrame([(i, int(i > 20), float(i)) for i in range(40)], "id int, label int, x double")
    (fit,) = logistic.fit_logistic(df, ["x"], [F.lit(True)])
    assert fit.steps < 60 and 0 < fit.coefficients[0] < 100
    assert [f.steps for f in logistic.fit_logistic(df.limit(0), ["x"], [F.lit(True)])] == [1]


def test_a_class_that_a_fold_lacks(spark):
    rows = [(0, 0, 1.0), (0, 0, 2.0), (1, 0, 3.0), (1, 1, 9.0), (2, 1, 8.0), (2, 1, 10.0), (2, None, 5.0)]
    df = spark.createDataFrame(rows, "fold int, label int, x double")
    left = {(r.fold, r.label): (r.n, r.mean) for r in bayes.without_part(bayes.class_sums(df, ["x"], ["fold"]), ["fold"]).collect()}
    assert left == {(0, 0): (1, 3.0), (0, 1): (3, 9.0), (1, 0): (2, 1.5), (1, 1): (2, 9.0), (2, 0): (3, 2.0), (2, 1): (1, 9.0)}


@pytest.mark.parametrize("name, trainer", [
    ("lr", models.train_lr), ("lr_l1", lambda d, c: models.train_lr(d, c, "l1", scale=False)),
    ("nb", models.train_nb), ("rf", lambda d, c: models.train_rf(d, c, n_trees=5)),
])
def test_separable_classes_and_saved_models(separable, tmp_path, name, trainer):
    model = trainer(separable, COLUMNS)
    predictions = models.predict(model, separable, "text_id")
    row = evaluation.classification_metrics(predictions).first()
    assert (row.accuracy, row.precision, row.recall, row.f1_score) == (1.0, 1.0, 1.0, 1.0)
    files.save_model(model, str(tmp_path / name))
    again = models.predict(files.load_model(str(tmp_path / name)), separable, "text_id")
    assert predictions.exceptAll(again).count() == 0


def test_multinomial_takes_absolute_values_when_predicting(separable):
    model = models.train_nb(separable, COLUMNS, "multinomial")
    mirrored = separable.withColumn("a", -F.col("a"))
    assert models.predict(model, separable, "text_id").exceptAll(models.predict(model, mirrored, "text_id")).count() == 0


def test_lr_matches_gradient_descent(separable):
    model = models.train_lr(separable, COLUMNS, c=1.0)
    rows = np.array([[r.a, r.b, r.label] for r in separable.collect()])
    x, y = rows[:, :2], rows[:, 2]
    x = (x - x.mean(axis=0)) / x.std(axis=0)
    w, bias, n = np.zeros(2), 0.0, len(y)
    for _ in range(20_000):
        p = 1 / (1 + np.exp(-(x @ w + bias)))
        w -= 0.5 * (x.T @ (p - y) / n + w / n)
        bias -= 0.5 * (p - y).mean()
    assert np.allclose(model.stages[-1].coefficients.toArray(), w, atol=0.02)


def test_tuning_and_cross_validation(separable):
    folded = splits.stratified_folds(separable, k=3).cache()
    best, grid = models.tune_lr(folded, COLUMNS, grid_c=[0.1, 1.0], max_iter=20)
    assert grid.count() == 4 and evaluation.classification_metrics(models.predict(best, folded)).first().f1_score == 1.0
    folds = models.cross_validate(folded, COLUMNS, models.train_nb, range(3))
    assert folds.count() == 12 and folds.filter("value < 1").count() == 0
    assert evaluation.cv_summary(folds).filter("std > 0").count() == 0


def test_seed_suite_uses_the_multi_seed_splits(spark):
    """A model that always says 1 scores the share of ones among each seed's test rows."""
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(f"t{i}", int(rng.random() < 0.3), float(i)) for i in range(300)],
                               "text_id string, label int, a double").cache()
    seen = {}

    def trainer(train, columns):
        seen[train.first().seed] = {r.text_id for r in train.collect()}
        return models.train_nb(train, columns)

    assert models.seed_suite(df, ["a"], [1, 2], trainer).count() == 2
    split = splits.multi_seed_split(df, seeds=[1, 2]).filter(~F.col("is_test"))
    assert {s: {r.text_id for r in split.filter(F.col("seed") == s).collect()} for s in (1, 2)} == seen


def test_detection_and_stability_reports(separable):
    trainers = {"Logistic Regression": models.train_lr, "Naive Bayes": models.train_nb}
    result = run_detection(separable, COLUMNS, trainers=trainers, k=2)
    assert result.best.first().model == "Logistic Regression"  # the first of equals
    report = {(r.section, r.metric): r.value for r in detection_report(result).collect()}
    assert report[("test accuracy", "Naive Bayes")] == 1.0 and report[("features", "total")] == 2
    table = run_stability(separable, columns=COLUMNS, seeds=[1, 2], k=2, impute="median")
    cells = {(r.section, r.metric): r.value for r in table.collect()}
    assert cells[("seeds", "mean")] == 1.0 and cells[("cross-validation", "std")] == 0.0
    assert ("importance", "a") in cells


def test_a_forest_keeps_node_ids_with_the_rows_and_stays_the_same(spark):
    rows = spark.range(300).select((F.col("id") % 2).cast("int").alias("label"), F.rand(1).alias("a"), F.rand(2).alias("b")).cache()
    made = models.train_rf(rows, COLUMNS, n_trees=5).stages[-1]
    assert made.getCacheNodeIds()
    plain = RandomForestClassifier(numTrees=5, maxDepth=30, featureSubsetStrategy="sqrt", seed=42).fit(models._assembler(COLUMNS).transform(rows))
    assert made.toDebugString.split("\n", 1)[1] == plain.toDebugString.split("\n", 1)[1]


@pytest.fixture(scope="module")
def noisy(spark):
    """Three noisy features, one constant and one of few values."""
    rng = np.random.default_rng(11)
    x = np.column_stack([rng.normal(size=3000), rng.lognormal(size=3000), rng.random(3000), np.full(3000, 2.0), rng.integers(0, 3, 3000)])
    label = (x[:, 0] + 0.3 * x[:, 1] + (x[:, 4] == 1) + rng.normal(0, 0.7, 3000) > 0.8).astype(int)
    rows = [(f"t{i}", int(label[i]), *map(float, x[i])) for i in range(3000)]
    return spark.createDataFrame(rows, "text_id string, label int, a double, b double, c double, d double, e double").repartition(4).cache()


FIVE = list("abcde")


def test_nodes_of_a_large_forest_stay_in_a_table(noisy, monkeypatch, tmp_path):
    """All nodes lay on the driver and grew with the rows."""
    train, test = noisy.filter("crc32(text_id) % 4 > 0"), noisy.filter("crc32(text_id) % 4 = 0")
    plain = models.train_rf(train, FIVE, n_trees=30)
    assert isinstance(plain.stages[-1], RandomForestClassificationModel)
    monkeypatch.setattr(models, "DRIVER_ROWS", 1000)
    model = models.train_rf(train, FIVE, n_trees=30)
    made = model.stages[-1]
    assert isinstance(made, forest.ForestModel) and made.getNumTrees() == 30
    assert made.pieces.count() == 30 and sum(len(head.feature) for head in made.heads) == 30
    trees = [forest.Nodes.load(bytes(r.payload), 2) for r in made.pieces.collect()]
    assert sum(len(tree.feature) for tree in trees) == pytest.approx(plain.stages[-1].totalNumNodes, rel=0.1)
    for tree in trees:
        inner = np.flatnonzero(tree.feature >= 0)
        assert np.array_equal(tree.counts[inner], tree.counts[tree.left[inner]] + tree.counts[tree.left[inner] + 1])
        assert tree.counts[0].sum() == pytest.approx(train.count(), rel=0.1)
    got, other = (evaluation.classification_metrics(models.predict(m, test)).first() for m in (model, plain))
    assert got.accuracy == pytest.approx(other.accuracy, abs=0.03) and got.accuracy > 0.75
    shares, wanted = made.featureImportances.toArray(), plain.stages[-1].featureImportances.toArray()
    assert shares.sum() == pytest.approx(1) and np.allclose(shares, wanted, atol=0.04) and shares[3] == 0
    # The votes are the shares in the leaves of all trees.
    said = {r.text_id: r for r in model.transform(test).collect()}
    assert len(said) == test.count()
    x = np.array([[r[name] for name in FIVE] for r in said.values()])
    bins = np.array([np.searchsorted(cuts, x[:, i]) for i, cuts in enumerate(made.thresholds)], dtype=np.uint8)
    raw = sum(tree.votes(tree.place(bins)) for tree in trees)
    assert np.allclose([r.rawPrediction.toArray() for r in said.values()], raw) and np.allclose([r.probability[1] for r in said.values()], raw[:, 1] / 30)
    assert [r.prediction for r in said.values()] == list((raw[:, 1] > raw[:, 0] + 1e-9).astype(float))
    files.save_model(model, str(tmp_path / "forest"))
    again = files.load_model(str(tmp_path / "forest"))
    assert models.predict(model, test, "text_id").exceptAll(models.predict(again, test, "text_id")).count() == 0
    assert np.array_equal(models.rf_importance(again, FIVE).toPandas().importance, shares)


def test_a_tree_is_the_same_wherever_it_is_cut(noisy):
    whole = forest.fit_forest(noisy, FIVE, 4, 30, 42)
    cut = forest.fit_forest(noisy.repartition(9), FIVE, 4, 30, 42, piece_rows=200)
    assert min(len(head.feature) for head in cut.heads) > 15 and cut.pieces.count() > 40
    assert np.allclose(whole.featureImportances.toArray(), cut.featureImportances.toArray(), atol=1e-12)
    one, two = ({r.text_id: (r.prediction, tuple(np.round(r.probability.toArray(), 12))) for r in m.transform(noisy).collect()} for m in (whole, cut))
    assert len(one) == 3000 and one == two
    flat = forest.fit_forest(noisy, FIVE, 4, 3, 42, piece_rows=200)
    assert {r.text_id: r.prediction for r in flat.transform(noisy).collect()} == {
        r.text_id: r.prediction for r in forest.fit_forest(noisy, FIVE, 4, 3, 42).transform(noisy).collect()}


def test_a_forest_of_one_class_and_of_bad_rows(spark, noisy):
    one = forest.fit_forest(noisy.filter("label = 0"), FIVE, 3, 30, 1)
    assert {(r.prediction, r.probability[0]) for r in one.transform(noisy).collect()} == {(0.0, 1.0)}
    assert one.featureImportances.toArray().sum() == 0 and one.transform(noisy.limit(0)).count() == 0
    with pytest.raises(ValueError):
        forest.fit_forest(noisy.withColumn("label", F.lit(None).cast("int")), FIVE, 3, 30, 1)
    three = forest.fit_forest(noisy.withColumn("label", F.col("e").cast("int")), FIVE, 3, 30, 1)
    assert three.transform(noisy).filter("prediction = e").count() == 3000


def test_a_grid_of_points_shares_its_passes(spark, noisy):
    """Each point and fold took passes of its own, thousands in all; fits are the least values of their objectives."""
    folded = splits.stratified_folds(noisy, k=3).cache()
    columns = FIVE[:3]
    uses = [F.col("fold") != i for i in range(3)]
    points = [(i, *w) for i in range(3) for w in ((40.0, 0.0), (0.0, 9.0), (5.0, 5.0), (1e6, 0.0))]
    fits = logistic.fit_logistic(folded, columns, uses, points=points)
    rows = folded.select("fold", "label", *columns).toPandas()
    for fit, (i, l1, l2) in zip(fits, points):
        mine = rows[rows.fold != i]
        x = mine[columns].to_numpy()
        away = 1 / (1 + np.exp(-(x @ fit.coefficients + fit.intercept))) - mine.label.to_numpy()
        gradient, zero = x.T @ away + l2 * fit.coefficients, fit.coefficients == 0
        assert abs(away.sum()) < 1e-3 and np.all(np.abs(gradient[zero]) <= l1 + 1e-3) and fit.steps < 25
        assert np.allclose(gradient[~zero], -l1 * np.sign(fit.coefficients[~zero]), atol=1e-3) and (l1 < 1e6 or zero.all())
    spark.sparkContext.setJobGroup("grid", "grid")
    model, grid = models.tune_lr(folded, FIVE, grid_c=[0.001, 1.0])
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("grid"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs < 150, jobs
    got = {(r.c, r.penalty): r.f1 for r in grid.collect()}
    slow = models.train_lr(folded, FIVE, *max(got, key=got.get)[::-1])
    assert np.allclose(model.stages[-1].coefficients.toArray(), slow.stages[-1].coefficients.toArray(), atol=0.03)
    for (c, penalty), f1 in got.items():
        one = [evaluation.classification_metrics(models.predict(models.train_lr(folded.filter(F.col("fold") != i), FIVE, penalty, c), folded.filter(F.col("fold") == i))).first().f1_score for i in range(3)]
        assert f1 == pytest.approx(np.mean(one), abs=0.005)
    with pytest.raises(ValueError):
        models.tune_lr(folded.withColumn("fold", F.lit(None).cast("int")), FIVE)
