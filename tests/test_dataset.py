"""Copies, length limits, chunks, log summaries and sources on hand-written rows."""

import json
import re

import pytest
from pyspark.sql import functions as F

from quillsift import session
from quillsift.operators import dataset, summaries
from quillsift.plans import build
from quillsift.sources import articles, files
from quillsift.streaming.stateless import featurise_stream
from quillsift.schemas import ALL_FEATURES, COMBINED_TEXT


def test_first_copy_wins(spark):
    rows = [(3, "same", 1), (1, "same", 0), (2, "other", 1), (4, None, 0), (5, "same", 1)]
    df = spark.createDataFrame(rows, "ingest_order int, content string, label int")
    kept = {tuple(r) for r in dataset.dedup_exact(dataset.filter_not_null(df, "content")).collect()}
    assert kept == {(1, "same", 0), (2, "other", 1)}
    report = dataset.dedup_report(dataset.filter_not_null(df, "content")).first()
    assert (report.n_rows, report.n_distinct, report.n_removed) == (4, 2, 2)


def test_hot_text_is_merged_before_the_shuffle(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(dataset, "materialise", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or session.materialise(df))
    df = spark.createDataFrame([(i, "hot" if i % 3 == 0 else f"t{i}") for i in range(900)], "ingest_order int, content string")
    kept = dataset.dedup_exact(df)
    assert kept.count() == 601
    assert len(plans) == 1 and "partial_min_by" in plans[0]
    for plan in (plans[0], kept._jdf.queryExecution().executedPlan().toString()):
        keys = re.findall(r"(?:Sort \[|keys=\[|hashpartitioning\()([^\])]*)", plan)
        assert keys and not any("content" in key for key in keys)


@pytest.mark.parametrize("digest", [F.length, lambda text: F.lit(1), lambda text: F.substring(text, 1, 1), dataset.text_digest])
def test_texts_that_share_a_digest_are_told_apart(spark, digest):
    texts = ["a", "b", None, "", "a", "ab", "ac", None, "ab", "b", "zz", "", "a"]
    df = spark.createDataFrame([(i, t, 7, "clash") for i, t in enumerate(texts)], "ingest_order int, content string, _rows int, `a b` string").repartition(3)
    got = {(r.ingest_order, r.content) for r in dataset.dedup_exact(df, digest=digest).collect()}
    assert got == {(i, t) for i, t in enumerate(texts) if t not in texts[:i]}
    assert dataset.dedup_exact(df, digest=digest).columns == df.columns
    assert dataset.dedup_exact(df.limit(0), digest=digest).count() == 0


def test_length_limits(spark):
    df = spark.createDataFrame([("x" * n,) for n in (299, 300, 301, 2000, 2001)], "content string")
    assert sorted(len(r.content) for r in dataset.filter_char_range(df).collect()) == [300, 301, 2000]
    assert sorted(len(r.content) for r in dataset.filter_min_chars(df).collect()) == [301, 2000, 2001]
    words = spark.createDataFrame([("w " * n,) for n in (299, 300, 1000, 1001)], "content string")
    assert sorted(r.word_count for r in dataset.filter_word_range(words).collect()) == [300, 1000]
    short = spark.createDataFrame([(" " * 9 + "x" * n,) for n in (99, 100)], "content string")
    assert dataset.filter_short_response(short).count() == 1


def chunks_in_python(text):
    parts = [p.strip() for p in text.split("\n\n") if len(p.strip()) > 200]
    if len(parts) < 3:
        parts += [p.strip() for p in text.split("\n") if len(p.strip()) > 200]
    flat = [p.replace("\n", " ").strip() for p in parts[:5]]
    return [p for p in flat if len(p) >= 200]


@pytest.mark.parametrize("n", [0, 2, 3, 6])
def test_chunks(spark, n):
    text = "\n\n".join(["short", *[f"{i}" * 201 + "\n" + "y" * 250 for i in range(n)], "z" * 200])
    df = spark.createDataFrame([(1, text)], "id int, content string")
    got = [r.content for r in dataset.chunk_pages(df).orderBy("chunk_pos").collect()]
    assert got == chunks_in_python(text)


def test_funnel_matches_steps(spark):
    rows = [(1, "a" * 300, 0), (2, "a" * 300, 1), (3, None, 1), (4, "b" * 10, 1), (5, "c" * 400, 1), (6, "d" * 500, 1)]
    df = spark.createDataFrame(rows, "ingest_order int, content string, label int")
    got = {r.stage: r["rows"] for r in summaries.cleaning_funnel(df).collect()}
    assert got == {"initial": 6, "not_null": 5, "distinct": 4, "length_ok": 3, "human": 1, "ai": 2, "balanced": 2}


def test_api_errors_and_bands(spark):
    messages = ["Prompt BLOCKED", "safety stop", "HTTP 429", "Quota exceeded", "timeout"]
    df = spark.createDataFrame([(m,) for m in messages], "m string")
    kinds = [r.k for r in df.select(summaries.classify_api_error(F.col("m")).alias("k")).collect()]
    assert kinds == ["blocked", "blocked", "rate_limit", "rate_limit", "other"]
    rates = spark.createDataFrame([(0.186,), (0.25,), (0.899,), (0.903,)], "r double")
    assert [r.b for r in rates.select(summaries.rate_band(F.col("r")).alias("b")).collect()] == ["red", "orange", "orange", "green"]


def test_nan_counts(spark):
    nan = float("nan")
    df = spark.createDataFrame([(nan, 1.0, 1.0), (None, nan, 2.0), (1.0, 1.0, 3.0)], "a double, b double, c double")
    got = [(r.feature, r.nan_count) for r in summaries.nan_counts(df, ["a", "b", "c"]).collect()]
    assert got == [("total", 3), ("a", 2), ("b", 1)]


def test_article_defaults(spark):
    body = {"status": "ok", "articles": [
        {"title": "T", "content": "C"}, {"title": "T", "description": None, "content": "C", "source": {"name": "S"}},
    ]}
    rows = [("q", json.dumps(body)), ("q", json.dumps({"status": "error"})), ("q", json.dumps({"message": "m"}))]
    parsed = articles.parse_responses(spark.createDataFrame(rows, "query string, body string"))
    flat = articles.flatten_articles(parsed).orderBy("rank").collect()
    assert [(r.content, r.source, r.url, r.published_at) for r in flat] == [("T.  C", "unknown", "", ""), ("T.  C", "S", "", "")]
    assert sorted(r.message for r in articles.rejected_responses(parsed).collect()) == ["Unknown error", "m"]


def test_csv_round_trip(spark, tmp_path):
    row = ("id", 'comma, "quote"\nline\n\n  blank ', 1, "", None, None, None, None, None, None, None, None)
    df = spark.createDataFrame([row], COMBINED_TEXT)
    files.write_csv(df, str(tmp_path / "c"))
    back = files.read_csv(spark, str(tmp_path / "c")).first()
    assert (back.text_id, back.content, back.label, back.title) == ("id", row[1], 1, None)
    with pytest.raises(ValueError):
        files.read_csv(spark, str(tmp_path / "c"), text_column="nothing")


def test_build_dataset_writes_stages(spark, tmp_path):
    human = spark.createDataFrame([(f"h{i}", str(i) * 300, 0, i) for i in range(1, 8)], "text_id string, content string, label int, ingest_order int")
    ai = spark.createDataFrame([(f"a{i}", chr(96 + i) * 300, 1, 100 + i) for i in range(1, 5)], "text_id string, content string, label int, ingest_order int")
    final = build.build_dataset(human, ai, date="2024-05-01", output_dir=str(tmp_path))
    assert {r["label"]: r["count"] for r in final.groupBy("label").count().collect()} == {0: 4, 1: 4}
    assert spark.read.parquet(str(tmp_path / "human")).count() == 7
    view = build.overview(final)
    assert view.summary.first().total == 8 and view.previews.count() == 2


def test_stream_equals_batch(spark, tmp_path):
    source = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", F.col("text").alias("content"))
    source.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run = (
        featurise_stream(stream, ["the", "and"]).select("doc_id", *ALL_FEATURES).writeStream.format("parquet")
        .option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start(str(tmp_path / "out"))
    )
    run.awaitTermination(120)
    streamed = spark.read.parquet(str(tmp_path / "out"))
    batch = featurise_stream(source, ["the", "and"]).select("doc_id", *ALL_FEATURES)
    assert streamed.count() == source.count()
    assert streamed.exceptAll(batch).count() == 0


def test_human_text_wins_when_both_corpora_count_from_zero(spark):
    human = spark.createDataFrame([("h0", "x", 0), ("h1", "same", 1)], "text_id string, content string, ingest_order long")
    generated = spark.createDataFrame([("a0", "y", 0), ("a1", "same", 1)], "text_id string, content string, ingest_order long")
    both = dataset.union_corpora(human, generated)
    kept = {r.text_id for r in dataset.dedup_exact(both, order=dataset.corpus_order(both)).collect()}
    assert kept == {"h0", "h1", "a0"}


def test_labels_are_bound_and_audited(spark):
    texts = spark.createDataFrame([(1, "a", 9), (2, "b", 9), (2, "bb", 9), (3, "c", 9), (None, "n", 9)], "id int, content string, label int").repartition(3)
    labels = spark.createDataFrame([(1, 0), (2, 1), (7, 1), (8, 0), (3, None), (None, 1)], "id int, label int").repartition(2)
    bound = dataset.bind_labels(texts, labels, "id")
    assert sorted(map(tuple, bound.rows.collect())) == [(1, "a", 0), (2, "b", 1), (2, "bb", 1)]
    assert bound.counts() == {"matched": 3, "without_label": 2, "without_text": 3}
    empty = dataset.bind_labels(texts.limit(0), labels, "id")
    assert empty.rows.count() == 0 and empty.counts()["without_text"] == 5
