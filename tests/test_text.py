"""Branches of the text functions that the supplied tables do not reach, against plain Python."""

import math
import re
import statistics
import tracemalloc
import unicodedata
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillsift.functions import cleaning, features, lexicon, tokens
from quillsift.operators.features import easy_word_list, extract_all_features
from quillsift.operators.preprocess import preprocess_dataset
from quillsift.schemas import ALL_FEATURES

TEXTS = [
    None, "", "   ", "one", "Two tokens", "Just one sentence without end",
    "See http://a.b/c?d=e and www.x.org now, or https://q",
    "Mail me@here.org or @nobody, x@ and @@@ and a@b@c done",
    "It won't, can't, shouldn't; they're we've I'll he'd I'm ’s fine. It's Bob's!",
    'He said "hello" (twice) — café naïve ﬁne ½',
    "Blank space line　wide\x1cunit\n\nnew paragraph\r\n\tend.",
    "A. B! C? D... e -- f. 3.14 and 1,000 well-known x.y",
    "cannot cannot. Same same same words words. Third sentence here.",
    "\U0001f600 emoji and _under_score",
]


def py_clean(text):
    if text is None:
        return ""
    text = re.sub(r"http\S+|www\S+", "", text)
    text = re.sub(r"\S+@\S+", "", text)
    text = re.sub(r"[^\w\s.,!?;:'-]", " ", text)
    return re.sub(r"\s+", " ", text).strip()


def py_normal(text):
    text = unicodedata.normalize("NFKD", py_clean(text)).lower()
    for short, full in cleaning.CONTRACTIONS.items():
        text = text.replace(short, full)
    return text


@pytest.fixture(scope="module")
def prepared(spark):
    rows = list(enumerate(TEXTS))
    df = spark.createDataFrame(rows, "id int, content string")
    return {row.id: row for row in preprocess_dataset(df).orderBy("id").collect()}


@pytest.mark.parametrize("i", range(len(TEXTS)))
def test_cleaning(prepared, i):
    assert prepared[i].cleaned_text == py_clean(TEXTS[i])
    assert prepared[i].normalized_text == py_normal(TEXTS[i])
    assert prepared[i].word_count == len((TEXTS[i] or "").split())


def test_whitespace_is_pythons(spark):
    points = [c for c in range(1, 0x3100) if not 0xD800 <= c < 0xE000]
    df = spark.createDataFrame([(c, chr(c)) for c in points], "c int, s string")
    matched = {row.c for row in df.filter(F.col("s").rlike(f"[{cleaning.WHITESPACE}]")).collect()}
    assert matched == {c for c in points if chr(c).isspace()}
    assert set(cleaning.WHITESPACE_CHARS) == {chr(c) for c in points if chr(c).isspace()}


def test_tokens(prepared):
    assert prepared[11].tokens == ["a.b"] or "..." in prepared[11].tokens
    assert "3.14" in prepared[11].tokens and "1,000" in prepared[11].tokens and "--" in prepared[11].tokens
    assert "well-known" in prepared[11].tokens and "x.y" in prepared[11].tokens
    assert prepared[12].tokens[:2] == ["can", "not"]
    assert "'s" in prepared[8].tokens
    assert prepared[0].tokens == [] and prepared[0].sentences == []
    assert prepared[12].sentences == ["cannot cannot.", "same same same words words.", "third sentence here."]


def test_abbreviations_and_stop_words(spark):
    df = spark.createDataFrame([("dr. who met mr. x. the end of it.",)], "t string")
    row = df.select(
        tokens.tokenize_sentences(F.col("t"), ["mr", "dr"]).alias("s"),
        tokens.drop_stop_words(F.split("t", " "), lexicon.DEFAULT_STOP_WORDS).alias("w"),
    ).first()
    assert row.s == ["dr. who met mr. x.", "the end of it."]
    assert row.w == ["dr.", "met", "mr.", "x.", "end", "it."]


def test_sentence_fallback(spark):
    df = spark.createDataFrame([("One. Two!!  Three?",), ("...",)], "t string")
    rows = [r.s for r in df.select(tokens.split_sentences_fallback(F.col("t")).alias("s")).collect()]
    assert rows == [["One", "Two", "Three"], []]


@pytest.fixture(scope="module")
def feature_rows(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id int, content string")
    rows = extract_all_features(preprocess_dataset(df), easy_words=["and", "it's", "same"])
    return {row.id: row for row in rows.collect()}


@pytest.mark.parametrize("i", range(len(TEXTS)))
def test_features_against_python(feature_rows, i):
    row = feature_rows[i]
    words, text, sentences = row.tokens, row.normalized_text, row.sentences
    n = len(words)
    assert row.unique_word_count == len(set(words))
    for name in ("vocabulary_richness", "lexical_diversity", "unique_word_ratio"):
        assert row[name] == pytest.approx(len(set(words)) / n if n else 0)
    assert row.avg_word_length == pytest.approx(sum(map(len, words)) / n if n else 0)
    assert row.avg_sentence_length == pytest.approx(n / len(sentences) if sentences else 0)
    assert row.punctuation_ratio == pytest.approx(sum(c in ".,!?;:'\"" for c in text) / len(text) if text else 0)
    lengths = [len(s.split()) for s in sentences]
    assert row.sentence_length_std == pytest.approx(statistics.pstdev(lengths) if len(lengths) > 1 else 0)
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(words).values()) if n else 0
    assert row.word_entropy == pytest.approx(entropy, abs=1e-9)
    for size, name in ((2, "bigram_diversity"), (3, "trigram_diversity")):
        grams = list(zip(*[words[k:] for k in range(size)]))
        assert row[name] == pytest.approx(len(set(grams)) / len(grams) if grams else 0)
    for name in ALL_FEATURES:
        assert row[name] is not None and math.isfinite(row[name])
        if name.endswith(("_ratio", "_diversity", "_richness")):
            assert 0 <= row[name] <= 1
    if not n:
        assert all(row[name] == 0 for name in ALL_FEATURES)


def test_readability_formulas(spark):
    df = spark.createDataFrame([("the table is here. an elephant eats bananas. we go.",)], "content string")
    row = extract_all_features(preprocess_dataset(df), easy_words=["the", "is", "here", "an", "we", "go"]).first()
    words, sents, syll, poly, hard, letters = 10, 3, 15, 2, 4, 42
    assert row.flesch_reading_ease == pytest.approx(206.835 - 1.015 * words / sents - 84.6 * syll / words)
    assert row.flesch_kincaid_grade == pytest.approx(0.39 * words / sents + 11.8 * syll / words - 15.59)
    assert row.automated_readability_index == pytest.approx(4.71 * letters / words + 0.5 * words / sents - 21.43)
    assert row.dale_chall_readability == pytest.approx(0.1579 * 100 * hard / words + 0.0496 * words / sents + 3.6365)
    assert row.gunning_fog == pytest.approx(0.4 * (words / sents + 100 * poly / words))
    assert row.smog_index == pytest.approx(1.0430 * math.sqrt(30 * poly / sents) + 3.1291)


def test_paragraphs_of_original_text(spark):
    df = spark.createDataFrame([("a\n\nb\n\n \n\nc",), ("",)], "t string")
    assert [r.n for r in df.select(features.paragraph_count(F.col("t")).alias("n")).collect()] == [3.0, 0.0]


def test_easy_words_tie_by_word(spark):
    df = spark.createDataFrame([("b b a a c",)], "normalized_text string")
    assert easy_word_list(df, size=2) == ["a", "b"]
    with pytest.raises(ValueError):
        easy_word_list(df, size=10**6)


def test_features_need_no_shuffle(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumnRenamed("text", "content")
    plan = extract_all_features(preprocess_dataset(df), easy_words=["the"])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    assert plan.count("ArrowEvalPython") == 1


def test_nfkd_holds_few_texts_of_a_batch_at_a_time():
    texts = [None, "", "plain", "é́ﬁẛ̣", *["é a" * 3000] * 4000]
    batch = pa.array(texts)
    tracemalloc.start()
    made = cleaning._nfkd_batch.func(batch)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert made.to_pylist() == [text and unicodedata.normalize("NFKD", text) for text in texts]
    assert peak < 10e6  # all of them are 100 MB and more as Python strings
    assert cleaning._nfkd_batch.func(pa.array([], pa.string())).to_pylist() == []
    assert cleaning._nfkd_batch.func(pa.nulls(3, pa.string())).to_pylist() == [None] * 3


def test_nfkd_of_assigned_characters_stays_out_of_python(spark, monkeypatch):
    """Texts went to Python by the batch; only characters newer than Java's tables do now, and no form differs."""
    points = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    marked = [f"e{c}\u0323\u0301" for c in points if unicodedata.combining(c)]
    df = spark.createDataFrame(pa.table({"t": [None, "", *points, *marked]}))
    made = df.select("t", cleaning.nfkd(F.col("t")).alias("n")).collect()
    assert [row.t for row in made if row.n != (row.t and unicodedata.normalize("NFKD", row.t))] == []

    crossed = F.arrow_udf(lambda texts: pa.array([text and "python" for text in texts.to_pylist()], pa.string()), "string")
    monkeypatch.setattr(cleaning, "_nfkd_batch", crossed)
    df = spark.createDataFrame([(0, "plain"), (1, "é ﬁ 한"), (2, "é \U0010fffe"), (3, None)], "i int, t string")
    made = [row.n for row in df.select("i", cleaning.nfkd(F.col("t")).alias("n")).orderBy("i").collect()]
    assert made == ["plain", unicodedata.normalize("NFKD", "é ﬁ 한"), "python", None]


def test_contractions_are_sought_only_behind_an_apostrophe(spark):
    texts = [*TEXTS, "can't won't", "wont", "n't", "i'd've", "'", "they're we'll i'm", "", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", cleaning.expand_contractions(F.col("t")).alias("e"))
    assert "Contains" in rows._jdf.queryExecution().executedPlan().toString()

    def plain(text):
        for short, full in cleaning.CONTRACTIONS.items():
            text = text.replace(short, full)
        return text

    assert [row.e for row in rows.collect()] == [text and plain(text) for text in texts]


def test_cleaning_searches_only_texts_that_hold_something(spark):
    """The patterns for addresses cost most where there are none; results stay those of the patterns alone."""
    texts = [*TEXTS, "a  b", " a b ", "a \n b\n c", "@", "a@b", "x@ @y", "http", "http:", "wwww", "cannot", "cannots 's", "dog's's"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    plain = {
        "u": lambda t: re.sub(r"(?:http|www)\S+", "", t), "e": lambda t: re.sub(r"(?<!\S)\S+@\S+", "", t),
        "s": lambda t: re.sub(r"\s+", " ", t).strip(" "),
    }
    made = df.select("t", cleaning.strip_urls(F.col("t")).alias("u"), cleaning.strip_emails(F.col("t")).alias("e"),
                     cleaning.collapse_spaces(F.col("t")).alias("s"), tokens.tokenize_words(F.col("t")).alias("w"))
    for row in made.collect():
        for name, rule in plain.items():
            assert row[name] == (None if row.t is None else rule(row.t)), (name, row.t)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.lower().count("contains(") >= 5
