"""Phrases against brute force: any chunk, partition and filter size; summaries that overflow; odd texts."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillsift.llm import phrases

TEXT = "doc_id long, lang string, text string, phrase string, f int, k int"


def words_of(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [[w for w in re.split("[ \t]+", piece) if w] for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", lowered)]


def brute(rows, least, top):
    counts, totals = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for ws in words_of(text):
            totals[lang] += len(ws)
            for k in range(1, 5):
                for s in range(len(ws) - k + 1):
                    counts.setdefault(lang, Counter())[tuple(ws[s:s + k])] += 1
    out = set()
    for lang, f in counts.items():
        scored = {}
        for p, a in f.items():
            if len(p) > 1 and a >= least:
                scored[p] = (a, *min(((2_000_000 * a // (f[p[:c]] + f[p[c:]]), c, f[p[:c]], f[p[c:]]) for c in range(1, len(p)))))
        kept = [(p, v) for p, v in scored.items() if not any(
            len(q) > len(p) and 100 * w[0] >= 80 * v[0] and any(q[s:s + len(p)] == p for s in range(len(q))) for q, w in scored.items())]
        kept.sort(key=lambda x: (-x[1][1], -x[1][0], " ".join(x[0]).encode()))
        for rank, (p, (a, score, _, l, r)) in enumerate(kept[:top], 1):
            out.add((lang, rank, " ".join(p), a, l, r, totals[lang], score))
    return out


def rows_of(df, **options):
    return {tuple(r[n] for n in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in phrases.mine_phrases(df, **options).collect()}


def corpus(seed, n=120):
    rng = random.Random(seed)
    vocabulary = ["The", "the", "É", "é", "a b", "x\x1cy", "z", "cat", "dog", "日本", "1-2"]
    texts = []
    for _ in range(n):
        words = [rng.choice(vocabulary) if rng.random() < 0.7 else rng.choice(["new york city", "New  York\tcity", "of the"]) for _ in range(rng.randint(0, 40))]
        texts.append((rng.choice(["en", "en", "fr", None, ""]), "".join(w + rng.choice([" ", " ", "  ", "\t", ". ", ",", "\n", "\x0b"]) for w in words)))
    return texts + [("en", None), ("en", ""), ("en", " . , "), ("xx", "lone words only"), ("fr", "go go go go go " * 20), *[("en", "same row twice")] * 6]


@pytest.mark.parametrize("options", [
    {}, {"chunk_words": 7, "partition_bytes": 400, "filter_bits": 32}, {"chunk_words": 100, "partition_bytes": 3000, "filter_bits": 1 << 10}])
def test_phrases(spark, options):
    rows = corpus(len(options))
    df = spark.createDataFrame([(i, *r, "clash", 1, 2) for i, r in enumerate(rows)], TEXT)
    for least, top in ((5, 2000), (3, 4)):
        assert rows_of(df, least=least, top=top, **options) == brute(rows, least, top)
    assert rows_of(df.limit(0), **options) == set()


def test_a_long_text_goes_on_in_the_next_chunk(spark, monkeypatch):
    rng = random.Random(5)
    long = " ".join(rng.choice(["alpha", "beta", "gamma", "delta."]) for _ in range(30_000))
    text = pa.RecordBatch.from_pydict({"lang": ["a", "b", "a"], "text": [long, "x y " * 50, "w" * 5000]})
    whole = Counter(tuple(ws[s:s + k]) for ws in words_of(long) for k in range(1, 5) for s in range(len(ws) - k + 1))
    for size, slice_ in ((10 ** 9, 1 << 22), (501, 1000), (64, 7)):
        monkeypatch.setattr(phrases._slices, "__defaults__", (slice_,))
        got = Counter()
        for lang, chunk in phrases.chunks(iter([text]), size):
            assert size > 10 ** 8 or len(chunk.ids) < size + slice_ + 10
            for k, place, found in chunk.hashes(lang):
                if lang == "a":
                    for phrase, n in zip(*chunk.counted(k, place, found)):
                        got[tuple(phrase.decode().split(" "))] += int(n)
        got.pop(("w" * 5000,))
        assert got == whole


def test_phrases_that_share_a_hash_are_told_apart():
    ids = np.array([1, 2, 0, 1, 3, 0, 1, 2])
    chunk = phrases.Chunk([b".", b"a", b"b", b"c"], ids, 0)
    found = chunk.counted(2, np.array([1, 4, 7]), np.array([9, 9, 9], np.uint64))
    assert dict(zip(found[0], found[1].tolist())) == {b"a b": 2, b"a c": 1}


@pytest.mark.parametrize("capacity", [1, 5, 40, 10_000])
def test_a_summary_keeps_all_that_is_frequent(capacity):
    rng = np.random.default_rng(capacity)
    keys = np.minimum(rng.zipf(1.3, 6000), 900).astype(np.uint64)
    truth = Counter(keys.tolist())
    one, least = phrases.Summary(capacity, 30), 30
    for part in np.array_split(keys, 60):
        one.merge(*np.unique(part, return_counts=True))
    kept = set(one.survivors().tolist())
    assert {k for k, n in truth.items() if n >= least} <= kept and one.lost < least
    if capacity > len(keys) / least:
        assert len(one.keys) <= capacity
    assert all(truth[k] >= least - one.lost for k in kept)


def test_scores_beyond_64_bits(spark):
    big = 9_000_000_000_000
    rows = [("a", 2, "x y", big), ("a", 1, "x", big + 1), ("a", 1, "y", big), ("a", 0, "", 3 * big)]
    got = phrases.phrase_scores(spark.createDataFrame(rows, "lang string, k int, phrase string, f long")).first()
    assert got.score == 2_000_000 * big // (2 * big + 1) == 999_999


def test_survivors_are_few(spark):
    df = spark.range(400).select(F.lit("a").alias("lang"), F.concat(F.lit("often seen "), F.col("id").cast("string"), F.lit(" "), F.md5(F.col("id").cast("string"))).alias("text"))
    parts, capacity = phrases.hash_partitions(df, 4000)
    assert parts > 3 and capacity > 10
    assert 3 <= phrases.surviving_hashes(df, parts, capacity).count() < 10
