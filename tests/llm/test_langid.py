"""Byte context trees against a plain prediction by partial matching, held-out accuracy, odd texts."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillsift.llm import langid

ODD = [None, "", "12 !?", "x", "é", "\x00\x01", "the 日本語", "ab" * 400_000]


def counts_of(texts, order):
    tables = [defaultdict(Counter) for _ in range(order + 1)]
    for text in texts:
        data = b"\0" * order + text.encode()
        for i in range(order, len(data)):
            for k in range(order + 1):
                tables[k][data[i - k:i]][data[i]] += 1
    return tables


def plain_probability(tables, context, byte, order):
    """Escape method C with exclusion, symbol by symbol."""
    p, gone = 1.0, set()
    for k in range(order, -1, -1):
        seen = tables[k].get(context[len(context) - k:])
        if not seen:
            continue
        left = {b: n for b, n in seen.items() if b not in gone}
        escape = len(left) if len(seen) < 256 else 0
        if byte in left:
            return p * left[byte] / (sum(left.values()) + escape)
        if left:
            p *= escape / (sum(left.values()) + escape)
        gone |= set(left)
    return p / (256 - len(gone))


@pytest.mark.parametrize("order", [1, 3, 4])
def test_costs_equal_plain_matching(spark, order):
    rng = random.Random(order)
    texts = {"a": ["".join(rng.choice("abc é") for _ in range(rng.randint(0, 60))) for _ in range(20)], "b": ["abracadabra" * 3, "", "zyx"]}
    rows = [(lang, t) for lang, many in texts.items() for t in many] + [(None, "q" * 50), ("a", None)]
    tree = langid.learn_tree(spark.createDataFrame(rows, "lang string, text string"), order)
    assert tree.langs == ["a", "b"]
    for lang, many in texts.items():
        tables, code = counts_of(many, order), tree.langs.index(lang)
        for text in ("abcab", "é!zyxab", "q", "cadabé"):
            data = b"\0" * order + text.encode()
            found = np.array([int.from_bytes(data[i - order:i + 1], "big") for i in range(order, len(data))], np.uint64)
            expected = [-math.log2(plain_probability(tables, data[i - order:i], data[i], order)) for i in range(order, len(data))]
            assert np.allclose(tree.cost(code, found), expected, rtol=1e-12)
            assert np.allclose(langid.Costs(tree).of(found)[:, code], expected) and np.allclose(langid.Costs(tree, 4).of(found)[:, code], expected)
        for context in (b"\0" * order, b"abca"[:order], b"zzzz"[:order]):
            head = int.from_bytes(context, "big") << 8
            assert np.exp2(-tree.cost(code, np.arange(head, head + 256, dtype=np.uint64))).sum() == pytest.approx(1)


def test_pieces_hold_every_byte_with_its_context():
    rng = random.Random(1)
    texts = [None if rng.random() < 0.2 else "".join(rng.choice("abé") for _ in range(rng.choice([0, 1, 2, 5, 40]))) for _ in range(60)]
    expected = []
    for row, text in enumerate(texts):
        data = b"\0\0\0" + (text or "").encode()
        expected += [(row, int.from_bytes(data[i - 3:i + 1], "big")) for i in range(3, len(data))]
    for size in (1, 2, 3, 7, 64, 1 << 20):
        for column in (pa.array(texts), pa.array(["zz", *texts, "zz"]).slice(1, len(texts))):
            got = [(int(r), int(w)) for rows, found in langid.text_pieces(column, 3, size) for r, w in zip(rows, found)]
            assert got == expected


def test_a_share_bounds_the_tree_and_keeps_it_normalised(spark):
    rng = random.Random(3)
    rows = [("a", "".join(chr(rng.randint(32, 500)) for _ in range(300))) for _ in range(50)]
    tree = langid.learn_tree(spark.createDataFrame(rows, "lang string, text string"), 3, share=1 / 200)
    assert all(len(keys) <= 200 for keys in tree.keys) and len(tree.keys[0]) > 5
    for context in tree.contexts[3][:3].tolist() + [0, 77]:
        head = (context & 0xFFFFFF) << 8
        assert np.exp2(-tree.cost(0, np.arange(head, head + 256, dtype=np.uint64))).sum() == pytest.approx(1)


def test_odd_texts_ties_repeats_and_clashing_columns(spark):
    rows = [(1, "en", "the cat and the dog", True), (2, "fr", "le chat et le chien", True), (3, None, "xx yy", True), (3, "en", None, True)]
    rows += [(10 + k, "en", text, False) for k, text in enumerate(ODD)] + [(30, None, "le chien et le chat", False)] * 2
    df = spark.createDataFrame([(*r, 5, "clash") for r in rows], "doc_id long, lang string, text string, train boolean, score int, lang_pred string")
    got = {r.doc_id: r for r in langid.identify_languages(df, "train").collect()}
    assert set(got[1].asDict()) == set(df.columns) and got[1].text == rows[0][2] and got[1].lang == "en"
    assert [got[10 + k].lang_pred for k in range(3)] == ["und"] * 3 and got[10].score == 0
    assert got[15].lang_pred == "und" and got[16].lang_pred in ("en", "fr") and got[17].lang_pred in ("en", "fr")
    assert got[30].lang_pred == "fr" and 0.9 < got[30].score <= 1
    same = df.withColumn("lang", F.when(F.col("train"), F.lit("zz")))
    assert {r.score for r in langid.identify_languages(same, "train", keep=["doc_id"]).filter("lang_pred = 'zz'").collect()} == {1.0}
    twins = df.select("doc_id", "text", "train").withColumn("lang", F.explode(F.array(F.lit("b"), F.lit("a"))))
    assert {r.lang_pred for r in langid.identify_languages(twins, "train").collect()} == {"a", "und"}
    assert langid.identify_languages(df.limit(0), "train").count() == 0
    assert {(r.lang_pred, r.score) for r in langid.identify_languages(df.withColumn("train", F.lit(False)), "train").collect()} == {("und", 0.0)}


def test_held_out_accuracy(spark):
    from quillsift.llm.queries import QUERIES
    sf_dir = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang")
    got = QUERIES["op12_language_id"](spark, sf_dir).join(docs, "doc_id")
    held = got.filter("held_out")
    assert got.count() == docs.count() and 0.2 < held.count() / docs.count() < 0.3
    assert held.filter("lang_pred = lang").count() / held.filter("lang_pred <> 'und'").count() > 0.97
